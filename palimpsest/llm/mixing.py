"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.joins import lookup_join
from palimpsest.session import written

SEED = 42


def source_name(source: Column) -> Column:
    """A source without outer blanks, in lower case."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def mixture_plan(documents: DataFrame, targets: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """How often each source of each mixture is repeated.

    ``documents`` has ``source`` and ``size``; ``targets`` has ``mix_id``, ``source``,
    ``target_share``, ``max_repeats`` and ``budget_ratio``. The total of a mixture is
    ``budget_ratio`` times the size of all documents, those without a source included.
    ``rate`` is the target over the source's size, at most ``max_repeats``; ``short``
    says that the source can't supply its target.

    * A null size is 0. A source without documents has size 0, rate 0, and is short
      if its target is above 0. No documents at all: every target is 0, none is short.
    * A null source of a target belongs to no documents. Repeated targets are kept.
    """
    sizes = documents.groupBy(source_name(F.col(f"`{source}`")).alias("source")).agg(F.sum(F.coalesce(F.col(f"`{size}`"), F.lit(0))).cast("double").alias("source_size"))
    sizes = written(sizes, "source-sizes")  # a row per source, read twice
    all_size = sizes.agg(F.sum("source_size")).first()[0] or 0.0
    target = F.col("target_share") * (F.col("budget_ratio") * F.lit(all_size))
    supply = F.col("max_repeats") * F.col("source_size")
    return (
        lookup_join(targets.select("mix_id", "source", "target_share", "max_repeats", "budget_ratio"), sizes, ["source"], "left")
        .withColumn("source_size", F.coalesce("source_size", F.lit(0.0)))
        .withColumn("target_size", target)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target_size") / F.col("source_size"), F.col("max_repeats").cast("double"))).otherwise(0.0))
        .withColumn("short", supply < F.col("target_size"))
    )


def draw(documents: DataFrame, plan: DataFrame, identity: Sequence[str], source: str = "source", size: str = "size", seed: int = SEED) -> DataFrame:
    """The copies of the documents of each mixture: ``mix_id``, ``source``, ``identity``, ``size`` and ``copy_no`` from 0.

    A document comes floor(rate) times, and once more if a number that ``seed``, the
    mixture and ``identity`` hash to (the first 52 bits of an MD5 digest), uniform in [0, 1), is below the fraction of the
    rate; so at most ``max_repeats`` times, and alike in every run. Nothing but the
    plan, which is small, moves.

    Rows that repeat all of ``identity`` are drawn alike. A null in ``identity`` counts
    as an empty text. Other columns are ignored.
    """
    by = [F.col(f"`{c}`") for c in identity]
    # 52 bits are exact in a double.
    text = F.concat_ws("|", F.lit(str(seed)), F.col("mix_id").cast("string"), *(F.coalesce(c.cast("string"), F.lit("")) for c in by))
    uniform = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
    rows = documents.select(*by, source_name(F.col(f"`{source}`")).alias("_source"), F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("_size"))
    rates = plan.select("mix_id", F.col("source").alias("_source"), "rate").where("rate > 0")
    whole = F.floor("rate")
    copies = (whole + F.when(uniform < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    drawn = lookup_join(rows, rates, ["_source"], spread=identity).withColumn("_copies", copies).where("_copies > 0")
    return drawn.select("mix_id", F.col("_source").alias("source"), *by, F.col("_size").alias("size"), F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("copy_no"))


def shares(plan: DataFrame, drawn: DataFrame) -> DataFrame:
    """Target and actual share of each source: of the mixture's budgeted total, and of what was drawn."""
    got = written(drawn.groupBy("mix_id", "source").agg(F.sum("size").alias("drawn_size"), F.count("*").alias("copies"), (F.max("copy_no") + 1).alias("most_repeats")), "drawn")
    all_drawn = got.groupBy("mix_id").agg(F.sum("drawn_size").alias("mix_size"))
    joined = lookup_join(lookup_join(plan, got, ["mix_id", "source"], "left"), all_drawn, ["mix_id"], "left")
    budget = F.when(F.col("target_share") > 0, F.col("target_size") / F.col("target_share"))
    return joined.select(
        "mix_id",
        "source",
        "target_share",
        "rate",
        "short",
        F.coalesce("drawn_size", F.lit(0)).alias("drawn_size"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        (F.coalesce("drawn_size", F.lit(0)) / budget).alias("share_of_budget"),
        (F.coalesce("drawn_size", F.lit(0)) / F.col("mix_size")).alias("share_of_drawn"),
    )
