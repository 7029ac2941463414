"""Votes and heartbeats as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.operators.blocks import next_in_key


def votes(requests: DataFrame, voter: str = "voter", candidate: str = "candidate", term: str = "term", order: str = "seq") -> DataFrame:
    """``requests`` with ``granted``, as each voter answers them one by one in ``order``.

    A voter grants a term above all it has seen, and the same term again to the
    candidate that it was first asked by. So a request is granted if no higher term
    came to the voter before it and its candidate is the first of that voter and
    term. Both are known from one row per voter and term, aggregated before the
    shuffle; no voter's requests are gathered. ``order`` must be unique.
    """
    v, c, t, o = (F.col(f"`{x}`") for x in (voter, candidate, term, order))
    terms = requests.where(t.isNotNull()).groupBy(v.alias("_v"), t.alias("_t")).agg(F.min(F.struct(o.alias("o"), c.alias("c"))).alias("_first"))
    above = W.partitionBy("_v").orderBy(F.desc("_t")).rowsBetween(W.unboundedPreceding, -1)
    terms = terms.withColumn("_until", F.min("_first.o").over(above))
    joined = requests.join(terms, v.eqNullSafe(F.col("_v")) & (t == F.col("_t")), "left")
    granted = (F.col("_until").isNull() | (o < F.col("_until"))) & c.eqNullSafe(F.col("_first.c")) & t.isNotNull()
    return joined.withColumn("granted", F.coalesce(granted, F.lit(False))).drop("_v", "_t", "_first", "_until")


def winners(granted: DataFrame, nodes: int) -> DataFrame:
    """The candidate of each term with votes of a majority of ``nodes``; two can't have one, as a voter has one vote a term."""
    tally = granted.where("granted").groupBy("term", "candidate").agg(F.countDistinct("voter").alias("votes"))
    return tally.where(F.col("votes") >= nodes // 2 + 1)


def rounds(answers: DataFrame, nodes: int) -> DataFrame:
    """The outcome of each attempt of a candidate to become leader, from the answers to it (attempt, candidate, term, phase, voter, granted).

    First a majority must grant the pre-vote, or the attempt ends and no term is
    begun. Then the candidate enters ``term``, votes for itself, and leads if a majority grants its vote.
    The candidate supports itself in both phases, so answers in its own name count
    for nothing; a voter's answers of one phase count as one, granted if any is.
    ``phase`` is prevote or vote. One row per attempt: ``prevotes``, ``votes`` (null if there was no vote) and ``outcome``: no_prevote, lost or leader.
    """
    others = answers.where(~F.col("voter").eqNullSafe(F.col("candidate")))
    each = others.groupBy("attempt", "candidate", "term", "phase", "voter").agg(F.bool_or(F.coalesce("granted", F.lit(False))).alias("yes"))
    count = {p: F.sum(F.when((F.col("phase") == p) & F.col("yes"), 1).otherwise(0)).alias(f"_{p}") for p in ("prevote", "vote")}
    tally = each.groupBy("attempt", "candidate", "term").agg(*count.values())
    majority = nodes // 2 + 1
    asked, won = F.col("_prevote") + 1 >= majority, F.col("_vote") + 1 >= majority
    return tally.select(
        "attempt", "candidate", "term", (F.col("_prevote") + 1).alias("prevotes"), F.when(asked, F.col("_vote") + 1).alias("votes"), F.when(~asked, "no_prevote").when(won, "leader").otherwise("lost").alias("outcome")
    )


def gaps(heartbeats: DataFrame, node: str, micros: str, timeout_us: int) -> DataFrame:
    """Heartbeats after which the next one of the node is later than ``timeout_us``: ``node``, ``gap_start_us``, ``gap_us``.

    Heartbeats of one instant are one. A node's heartbeats are cut into days, so that none is gathered whole.
    """
    seen = heartbeats.select(F.col(node).alias("node"), F.col(micros).alias("gap_start_us")).distinct()
    followed = next_in_key(seen, ["node"], "gap_start_us", "_next", width=86_400_000_000)
    return followed.select("node", "gap_start_us", (F.col("_next") - F.col("gap_start_us")).alias("gap_us")).where(F.col("gap_us") > timeout_us)


def prevotes(requests: DataFrame, elapsed: str, timeout: str, is_leader: str) -> DataFrame:
    """Whether a node would vote: not if it leads, else once half of its election timeout has passed without a heartbeat."""
    return requests.withColumn("granted", F.coalesce(~F.col(is_leader) & (F.col(elapsed) > F.col(timeout) * 0.5), F.lit(False)))
