"""Order-dependent computations without a global window.

Rows are range-partitioned and sorted once and written with the number of their
range, their block. What depends on all earlier rows is computed within each block
and carried from block to block as a few numbers, so no task ever sees more than one
block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.operators.joins import estimated_bytes
from palimpsest.session import written

#: Bytes of a block, by the optimizer's estimate, and how many times the session's shuffle partitions there may be blocks for that.
BLOCK_BYTES, BLOCKS_PER_TASK = 32_000_000, 16
#: An estimate from here on says that nothing is known.
UNKNOWN_BYTES = 2**62
#: Blocks, or groups of blocks, whose transfer tables one task composes.
FAN = 64


def block_count(df: DataFrame) -> int:
    """In how many blocks ``df`` is cut at most, by its size; one is one task's work."""
    tasks, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(df)
    return tasks if size >= UNKNOWN_BYTES else max(1, min(math.ceil(size / BLOCK_BYTES), tasks * BLOCKS_PER_TASK))


def in_blocks(df: DataFrame, order: Sequence[str], count: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with ``_block`` and ``_row``, the row's number in it from 0.

    Nulls come first. Rows that tie in ``order`` keep one order from here on, as the result is written.
    """
    by = [F.col(f"`{c}`") for c in order]
    numbered = df.repartitionByRange(count or block_count(df), *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return written(
        numbered.withColumns({"_block": F.shiftright("_id", 33).cast("int"), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"),
        "blocks",
    )


def with_carry(blocks: DataFrame, carry: dict[int, object], kind: str, name: str) -> DataFrame:
    """``blocks`` with what was carried into each block. One row per block is broadcast: as many as there are partitions."""
    rows = blocks.sparkSession.createDataFrame(list(carry.items()), f"_block int, {name} {kind}")
    return blocks.join(F.broadcast(rows), "_block", "left")


def _summed_before(blocks: DataFrame, amount: Column, count: int) -> DataFrame:
    """``blocks``, at most ``count``, with ``_carry``, the sum of ``amount`` over all earlier blocks. One number per block comes to the driver."""
    if count == 1:
        return blocks.withColumn("_carry", F.lit(0).cast("bigint"))
    carry, total = {}, 0
    for b, s in sorted((r[0], r[1] or 0) for r in blocks.groupBy("_block").agg(F.sum(amount)).collect()):
        carry[b] = total
        total += s
    return with_carry(blocks, carry, "bigint", "_carry")


def with_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """``df`` with each row's position in ``order``, from 1."""
    count = block_count(df)
    return _summed_before(in_blocks(df, order, count), F.lit(1), count).withColumn(name, F.col("_carry") + F.col("_row") + 1).drop("_block", "_row", "_carry")


def with_running_sum(df: DataFrame, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows up to and including each."""
    count = block_count(df)
    blocks = in_blocks(df, order, count)
    within = F.sum(f"`{amount}`").over(W.partitionBy("_block").orderBy("_row").rowsBetween(W.unboundedPreceding, 0))
    return _summed_before(blocks.withColumn("_within", within), F.col(f"`{amount}`"), count).withColumn(name, F.col("_carry") + F.col("_within")).drop("_block", "_row", "_carry", "_within")


class CloseAfter:
    """A group is closed by the row that brings its size to the limit."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def ends(self, cum: np.ndarray, starts: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Where groups end that start at ``starts`` with ``entries`` already in them; above len(cum) if not in this block."""
        base = np.append(0, cum)[starts]
        return np.searchsorted(cum, self.limit + base - entries, side="left") + 1

    def entries(self, cum: np.ndarray) -> np.ndarray:
        """Sizes of the open group from which on it ends at another row."""
        return np.unique(np.append(self.limit - cum[cum < self.limit], 0))


class OpenBefore:
    """A row that would bring a group above the limit opens the next one; a group of one row may be above it."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def ends(self, cum: np.ndarray, starts: np.ndarray, entries: np.ndarray) -> np.ndarray:
        base = np.append(0, cum)[starts]
        ends = np.searchsorted(cum, self.limit + base - entries, side="right")
        ends = np.where((ends <= starts) & (entries == 0), starts + 1, ends)
        # A group that reaches the end of the block may go on.
        return np.where(ends >= len(cum), len(cum) + 1, ends)

    def entries(self, cum: np.ndarray) -> np.ndarray:
        return np.unique(np.append(self.limit - cum[cum < self.limit] + 1, (0, 1)))


def _ends(rule: CloseAfter | OpenBefore, cum: np.ndarray, entry: int) -> list[int]:
    """Where the groups of a block end, given the size of the group that is open at its start."""
    ends, start, size = [], 0, entry
    while start < len(cum) or not ends:
        end = int(rule.ends(cum, np.array([start]), np.array([size]))[0])
        if end > len(cum):
            break
        ends.append(end)
        start, size = end, 0
    return ends


_TABLE = ["entry", "exit", "ended", "moves"]


def _short(table: pd.DataFrame) -> pd.DataFrame:
    """A transfer table without the rows that say what the one above them says."""
    rows = table[["exit", "ended", "moves"]].to_numpy(dtype=np.int64)
    return table[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]


def _transfer(rule: CloseAfter | OpenBefore, cum: np.ndarray) -> pd.DataFrame:
    """What a block does to the open group: entry from, exit, groups ended, and whether the exit moves with the entry.

    Groups that start alike end alike. Each start is followed to the last group of the
    block by doubling: from a start's next start to the one after that, and so on. As
    most entries soon lead to the same starts, the table is short.
    """
    n = len(cum)
    starts = np.arange(n + 1)
    after = rule.ends(cum, starts, np.zeros(n + 1, dtype=np.int64))
    goes_on = (after <= n) & (starts < n)
    last, ended = np.where(goes_on, after, starts), goes_on.astype(np.int64)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        ended, last = ended + ended[last], further
    entries = rule.entries(cum)
    first = rule.ends(cum, np.zeros(len(entries), dtype=np.int64), entries)
    moves = first > n
    start = np.where(moves, 0, first)
    sizes = np.where(moves, cum[-1], (cum[-1] - np.append(0, cum))[last[start]])
    counts = np.where(moves, 0, ended[start] + 1)
    return _short(pd.DataFrame({"entry": entries, "exit": sizes, "ended": counts, "moves": moves}))


def _through(table: pd.DataFrame, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What groups that enter with ``sizes`` leave with: exit, groups ended, whether the exit moves with the entry."""
    at = table["entry"].to_numpy().searchsorted(sizes, side="right") - 1
    moves = table["moves"].to_numpy(dtype=bool)[at]
    return table["exit"].to_numpy()[at] + np.where(moves, sizes, 0), table["ended"].to_numpy()[at], moves


def _composed(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
    """The transfer table of two stretches, one after the other."""
    entry, shift, moves = first["entry"].to_numpy(), first["exit"].to_numpy(), first["moves"].to_numpy(dtype=bool)
    bounds = np.append(entry[1:], np.iinfo(np.int64).max)
    # Where the exit moves with the entry, the second table's bounds are bounds of the whole.
    cuts = [entry, *(cut[(cut > a) & (cut < z)] for a, z, x in zip(entry[moves], bounds[moves], shift[moves], strict=True) for cut in (second["entry"].to_numpy() - x,))]
    entries = np.unique(np.concatenate(cuts))
    sizes, ended, moved = _through(first, entries)
    sizes, more, also = _through(second, sizes)
    both = moved & also
    return _short(pd.DataFrame({"entry": entries, "exit": sizes - np.where(both, entries, 0), "ended": ended + more, "moves": both}))


def _tables(pdf: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    """The transfer tables of a few nodes, in their order."""
    return [(int(node), t.sort_values("entry")[_TABLE]) for node, t in pdf.groupby("node", sort=True)]


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    tables = _tables(pdf)
    whole = tables[0][1]
    for _, table in tables[1:]:
        whole = _composed(whole, table)
    return whole.assign(node=tables[0][0] // FAN)[["node", *_TABLE]]


def _follow(pdf: pd.DataFrame, size: int, groups: int, total: bool = False) -> pd.DataFrame:
    """With what every node starts: the size of the open group and the groups before it. ``total`` adds, as node -1, what is left at the end."""
    out = []
    for node, table in _tables(pdf):
        out.append((node, size, groups))
        left, ended, _ = _through(table, np.array([size]))
        size, groups = int(left[0]), groups + int(ended[0])
    return pd.DataFrame([*out, (-1, size, groups)] if total else out, columns=["node", "size", "groups"])


_NODES, _STARTS = "node bigint, entry bigint, exit bigint, ended bigint, moves boolean", "node bigint, size bigint, groups bigint"


def _block_starts(tables: DataFrame, blocks: int) -> dict[int, tuple[int, int]]:
    """The size of the group open at the start of each block, and the groups before it; -1 stands for the end.

    Transfer tables compose, so they are composed in a tree of ``FAN`` children each, on
    executors, until the top has few nodes; these are followed, and then their
    children, down to the blocks. Only the result, a few numbers per block, comes to the driver.
    """
    levels = [tables]
    while blocks > FAN:
        levels[-1] = written(levels[-1], "transfer")
        blocks = -(-blocks // FAN)
        levels.append(levels[-1].groupBy(F.floor(F.col("node") / FAN)).applyInPandas(_compose, _NODES))
    starts = levels.pop().groupBy().applyInPandas(lambda pdf: _follow(pdf, 0, 0, True), _STARTS)
    while levels:
        starts = written(starts, "starts")
        parent = starts.where("node >= 0").select("node", "size", "groups")

        def down(nodes: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
            if nodes.empty:
                return pd.DataFrame([], columns=["node", "size", "groups"])
            return _follow(nodes, int(start["size"].iloc[0]), int(start["groups"].iloc[0]))

        below = levels.pop().withColumn("_up", F.floor(F.col("node") / FAN)).groupBy("_up").cogroup(parent.groupBy("node")).applyInPandas(down, _STARTS)
        starts = below.unionByName(starts.where("node < 0"))
    return {r["node"]: (r["size"], r["groups"]) for r in starts.collect()}


def greedy_groups(df: DataFrame, order: Sequence[str], size: str, rule: CloseAfter | OpenBefore, name: str) -> DataFrame:
    """``df`` with the number of the group, from 0, and ``_sealed``: whether the group has ended.

    Equal to going through all rows in ``order`` one by one. Every block tells how
    each size of the group open at its start turns out at its end, the blocks' tables
    are composed, and then every block is cut with the size that it really starts
    with. Python sees a block's sizes only and returns its cuts; rows are numbered by
    a running maximum of the cuts before them. Null and negative sizes count 0.
    """
    amount = F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0))
    count = block_count(df)
    blocks = in_blocks(df.withColumn("_size", amount), order, count)
    sizes = blocks.select("_block", "_row", "_size").groupBy("_block")

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _transfer(rule, np.cumsum(pdf.sort_values("_row")["_size"].to_numpy()))
        return found.assign(node=int(pdf["_block"].iloc[0]))[["node", *_TABLE]]

    starts = _block_starts(sizes.applyInPandas(tables, _NODES), count) if count > 1 else {0: (0, 0)}

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_block"].iloc[0])
        entry, first = starts[block]
        ends = _ends(rule, np.cumsum(pdf.sort_values("_row")["_size"].to_numpy()), entry)
        # OpenBefore counts the group open at the very start as one even while it is empty.
        return pd.DataFrame({"_block": block, "_row": [-1, *(e - 1 for e in ends)], "_group": range(first, first + len(ends) + 1)})

    marks = sizes.applyInPandas(cuts, "_block int, _row bigint, _group bigint").withColumn("_cut", F.lit(1))
    upto = W.partitionBy("_block").orderBy("_row", "_cut").rowsBetween(W.unboundedPreceding, 0)
    numbered = blocks.drop("_size").withColumn("_cut", F.lit(0)).unionByName(marks, allowMissingColumns=True).withColumn(name, F.max("_group").over(upto))
    if count == 1:
        numbered = numbered.withColumn("_last", F.max("_group").over(W.partitionBy("_block")))
    numbered = numbered.where("_cut = 0")
    if isinstance(rule, OpenBefore):
        sealed = F.lit(True)
    elif count > 1:
        sealed = F.col(name) < starts[-1][1] if starts else F.lit(False)
    else:
        sealed = F.col(name) < F.col("_last")
    # The last group of all rows has ended only if it was closed by a row.
    return numbered.withColumn("_sealed", sealed).drop("_block", "_row", "_group", "_cut", "_last")


def next_in_key(df: DataFrame, keys: Sequence[str], order: str, name: str, width: int = 1_000_000, previous: bool = False) -> DataFrame:
    """``df`` with the next (or previous) value of ``order`` among the rows of the same ``keys``; null at the end.

    A key is cut into stretches of ``width`` units of ``order`` (a number), within
    which a window looks; where a stretch ends, the bounds of the key's other
    stretches tell. So a key that holds a third of the rows is many groups.
    Values of ``order`` should be unique within a key; a row with a null order gets null.
    """
    k = [F.col(f"`{c}`") for c in keys]
    o = F.col(f"`{order}`")
    rows = df.withColumn("_stretch", F.floor(o / width))
    inside = W.partitionBy(*k, "_stretch").orderBy(o)
    within = F.lag(o).over(inside) if previous else F.lead(o).over(inside)
    bound = F.max(o) if previous else F.min(o)
    bounds = rows.where(o.isNotNull()).groupBy(*k, "_stretch").agg(bound.alias("_bound"))
    across = W.partitionBy(*k).orderBy("_stretch")
    bounds = bounds.withColumn("_other", F.lag("_bound").over(across) if previous else F.lead("_bound").over(across)).drop("_bound")
    return rows.withColumn("_within", within).join(bounds, [*keys, "_stretch"], "left").withColumn(name, F.coalesce("_within", "_other")).drop("_stretch", "_within", "_other")
