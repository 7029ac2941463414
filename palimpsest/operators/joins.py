"""Joins with a lookup side that is usually small, safe when it isn't and when keys are hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of them, that a lookup side may have to be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32_000_000
SALTS = 16


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: of texts as they are, 8 for a number or time, of nested values as JSON."""
    total = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + 8
    return total


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` is within the bounds of a broadcast: counted and summed where its rows are, which gathers none."""
    count, size = df.agg(F.count("*"), F.sum(_row_bytes(df))).first()
    return count <= max_rows and (size or 0) <= BROADCAST_BYTES


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate: good for choosing between two right plans, not for proving a bound."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    spread: Sequence[str] = (),
) -> DataFrame:
    """Join ``rows`` with ``lookup`` on ``on``; ``how`` is inner, left, left_semi or left_anti.

    ``lookup`` is measured first: only within ``max_rows`` and ``BROADCAST_BYTES`` it is broadcast. Beyond it both sides are shuffled. Keys that
    hold more of ``rows`` than half a task's share, counted exactly (a partial
    aggregate), are then spread over ``salts`` by the columns ``spread`` (all columns
    if none are given), and only their rows of ``lookup`` are repeated, once per salt; there are
    at most twice as many such keys as tasks.

    Both sides are read once to be measured and once to be joined; write them first if they are dear.

    Null keys match nothing; repeated keys of ``lookup`` repeat rows, as in any join.
    """
    on = list(on)
    if is_small(lookup, max_rows):
        return rows.join(F.broadcast(lookup), on, how)
    keys = [F.col(f"`{c}`") for c in on]
    counts = rows.groupBy(*(k.alias(f"_on{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_n"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = counts.where(F.col("_n") * 2 * tasks > rows.count())
    # A relation of at most 2 * tasks rows.
    hot = rows.sparkSession.createDataFrame(hot.drop("_n").collect(), hot.drop("_n").schema).withColumn("_hot", F.lit(True))
    salt = "_salt"
    while salt in {*rows.columns, *lookup.columns}:
        salt += "_"

    def marked(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for i, c in enumerate(on):
            same = same & df[f"`{c}`"].eqNullSafe(hot[f"_on{i}"])
        return df.join(F.broadcast(hot), same, "left").drop(*(f"_on{i}" for i in range(len(on))))

    by = [F.col(f"`{c}`") for c in (spread or [n for n, t in rows.dtypes if not t.startswith("map")])]
    left = marked(rows).withColumn(salt, F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = marked(lookup).withColumn(salt, F.explode(every)).drop("_hot")
    return left.join(right, [*on, salt], how).drop(salt)


#: Copies of one row that are made at a time.
_COPIES = 1000


def repeated(rows: DataFrame, times: str, spread: bool) -> DataFrame:
    """Every row as often as its column ``times`` says, without that column; with ``spread`` a row of very many copies is shared by all tasks.

    Copies are made group by group, so that no row's copies are ever held at once.
    """
    groups = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / _COPIES))

    def made(df: DataFrame, partitions: int = 0) -> DataFrame:
        grouped = df.withColumn("_group", F.explode(groups))
        if partitions:
            grouped = grouped.repartition(partitions)
        here = F.least(F.lit(_COPIES), F.col(times) - F.col("_group") * _COPIES)
        return grouped.withColumn(times, F.explode(F.sequence(F.lit(1).cast("bigint"), here))).drop("_group", times)

    if not spread:
        return made(rows)
    many = made(rows.where(F.col(times) > _COPIES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return made(rows.where(F.col(times) <= _COPIES)).unionByName(many)
