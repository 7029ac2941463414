"""Differences between two copies of a dataset, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def diff_tagged(
    rows: DataFrame,
    side: str,
    keys: Sequence[str],
    fields: Sequence[str],
    left: str = "left",
    right: str = "right",
    only_left: str = "only_left",
    only_right: str = "only_right",
) -> DataFrame:
    """Differences between the rows tagged ``left`` and ``right`` in the column ``side``: ``keys`` and ``field``.

    Rows are grouped once by key into one struct per side, aggregated before the
    shuffle, so that a key repeated without end stays one struct per task. ``field``
    is ``only_left`` or ``only_right`` for a key that one side lacks, else the name
    of each of ``fields`` that differs.

    * Null differs from every value and equals null, in keys as well.
    * Copies of a row count once. If rows of one side and key differ, the greatest
      (nulls first, then by ``fields`` in order) stands for that side.
    * Rows with another or null tag have no effect; an empty side makes every key of
      the other one a difference. Other columns are ignored.
    * Fields must be of orderable types; turn maps into sorted arrays first.
    """
    keys, fields = list(keys), list(fields)
    names = [f"_k{i}" for i in range(len(keys))]
    # With the flag in front a struct is never null, even if all its fields are.
    row = F.struct(F.lit(True).alias("there"), *(F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)))
    tag = F.col(f"`{side}`")
    grouped = (
        rows.where(tag.isin(left, right))
        .select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)), tag.alias("_side"), row.alias("_row"))
        .groupBy(*names)
        .agg(
            F.max(F.when(F.col("_side") == left, F.col("_row"))).alias("_l"),
            F.max(F.when(F.col("_side") == right, F.col("_row"))).alias("_r"),
        )
    )
    candidates = ", ".join(f"struct({_quoted(f)} AS name, NOT (_l.f{i} <=> _r.f{i}) AS differs)" for i, f in enumerate(fields))
    differing = f"transform(filter(array({candidates}), x -> x.differs), x -> x.name)" if fields else "cast(array() AS array<string>)"
    found = f"CASE WHEN _r IS NULL THEN array({_quoted(only_left)}) WHEN _l IS NULL THEN array({_quoted(only_right)}) ELSE {differing} END"
    return grouped.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), F.explode(F.expr(found)).alias("field"))


def diff_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], **options: str) -> DataFrame:
    """:func:`diff_tagged` of two DataFrames that hold ``keys`` and ``fields``."""
    tagged = [df.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate([*keys, *fields])), F.lit(t).alias("_tag")) for df, t in ((left, "left"), (right, "right"))]
    named = tagged[0].unionByName(tagged[1]).withColumnsRenamed({f"_{i}": c for i, c in enumerate([*keys, *fields])})
    return diff_tagged(named, "_tag", keys, fields, **options)
