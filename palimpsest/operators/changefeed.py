"""Rebuilding a table from a feed of inserts, updates and deletes.

The feed is replayed key by key in the order of its positions by a small state
machine. A key's state holds the positions of its last insert, update and delete
and, for every column, the position and value of the last assignment. States can
be merged, so the replay runs twice: over the rows of every input partition, sorted
there without a shuffle, and over the states so found, shuffled and sorted by key.
A key that holds a third of the feed thus reaches the second replay as at most one
state per input batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERTS = ("insert", "set", "upsert")
UPDATES = ("update",)
DELETES = ("delete",)
_NEVER = np.iinfo(np.int64).min
_KINDS = ("_ins", "_upd", "_del")


def spelled(op: Column) -> Column:
    """An operation without outer blanks and case."""
    return F.lower(F.regexp_replace(op, r"^\s+|\s+$", ""))


def _unit_states(
    changes: DataFrame,
    keys: Sequence[str],
    pos: str,
    op: str,
    columns: Sequence[str],
    changed: str | None,
    inserts: Sequence[str],
    updates: Sequence[str],
    deletes: Sequence[str],
) -> DataFrame:
    """One state per effective change. Internal names are positional, so that no column name can clash."""
    kind = spelled(F.col(f"`{op}`"))
    p = F.col(f"`{pos}`").cast("bigint")
    is_insert, is_update, is_delete = kind.isin(*inserts), kind.isin(*updates), kind.isin(*deletes)

    def assigned(c: str) -> Column:
        given = is_insert | (is_update & F.col(f"`{c}`").isNotNull())
        if changed is None:
            return given
        listed = F.col(f"`{changed}`")
        return F.when(listed.isNull(), given).otherwise((is_insert | is_update) & F.array_contains(listed, c))

    known = is_insert | is_update | is_delete
    return changes.where(known & p.isNotNull() & F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))).select(
        *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)),
        F.when(is_insert, p).alias("_ins"),
        F.when(is_update, p).alias("_upd"),
        F.when(is_delete, p).alias("_del"),
        *(
            x
            for i, c in enumerate(columns)
            for x in (F.when(assigned(c), p).alias(f"_p{i}"), F.when(assigned(c), F.col(f"`{c}`")).alias(f"_c{i}"))
        ),
    )


def _starts(batch: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where each run of equal keys begins."""
    n = batch.num_rows
    new = np.ones(n, dtype=bool)
    if n > 1:
        same = None
        for k in keys:
            column = batch[k].combine_chunks()
            equal = pc.equal(column.slice(1), column.slice(0, n - 1))
            same = equal if same is None else pc.and_(same, equal)
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _positions(batch: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(batch[name].combine_chunks(), _NEVER).to_numpy(zero_copy_only=False)


def _merge_runs(batch: pa.Table, keys: Sequence[str], columns: int) -> pa.Table:
    """Replay each run of equal keys into one state."""
    starts = _starts(batch, keys)
    if len(starts) == batch.num_rows:
        return batch
    runs = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
    out = {k: batch[k].take(pa.array(starts)) for k in keys}
    for kind in _KINDS:
        last = np.maximum.reduceat(_positions(batch, kind), starts)
        out[kind] = pa.array(last, mask=last == _NEVER)
    for i in range(columns):
        p = _positions(batch, f"_p{i}")
        last = np.maximum.reduceat(p, starts)
        at_last = np.flatnonzero((p == last[runs]) & (p != _NEVER))
        values = batch[f"_c{i}"].combine_chunks()
        pick = np.full(len(starts), -1)
        pick[runs[at_last]] = at_last
        _settle_ties(values, at_last, runs, pick)
        out[f"_p{i}"] = pa.array(last, mask=last == _NEVER)
        out[f"_c{i}"] = values.take(pa.array(pick, mask=pick < 0))
    return pa.table(out).select(batch.column_names).cast(batch.schema)


def _settle_ties(values: pa.Array, at_last: np.ndarray, runs: np.ndarray, pick: np.ndarray) -> None:
    """Of different values at one position the greatest counts, whatever the order of arrival; null is the least."""
    if len(at_last) < 2:
        return
    tied = np.flatnonzero(runs[at_last][1:] == runs[at_last][:-1])
    if not len(tied):
        return
    a, b = values.take(pa.array(at_last[tied])), values.take(pa.array(at_last[tied + 1]))
    nulls = pc.xor(pc.is_null(a), pc.is_null(b))
    conflicts = tied[pc.or_(nulls, pc.fill_null(pc.not_equal(a, b), False)).to_numpy(zero_copy_only=False)]
    rows_of: dict[int, list[int]] = {int(r): [] for r in runs[at_last[conflicts]]}
    if rows_of:
        for row in at_last[np.isin(runs[at_last], list(rows_of))]:
            rows_of[int(runs[row])].append(int(row))
        for run, rows in rows_of.items():
            pick[run] = max(rows, key=lambda r: ((v := values[r].as_py()) is not None, v if v is not None else 0))


def _replay_sorted(keys: Sequence[str], columns: int):
    """The state machine over batches sorted by key; the last key of a batch is carried into the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carried is not None:
                table = pa.concat_tables([carried, table.cast(carried.schema)])
            if not table.num_rows:
                continue
            merged = _merge_runs(table, keys, columns)
            carried = merged.slice(merged.num_rows - 1)
            yield from merged.slice(0, merged.num_rows - 1).combine_chunks().to_batches()
        if carried is not None:
            yield from carried.combine_chunks().to_batches()

    return run


def replay_changes(
    changes: DataFrame,
    keys: Sequence[str],
    pos: str,
    op: str,
    columns: Sequence[str],
    changed: str | None = None,
    states: DataFrame | None = None,
    inserts: Iterable[str] = INSERTS,
    updates: Iterable[str] = UPDATES,
    deletes: Iterable[str] = DELETES,
) -> DataFrame:
    """The state of every key of a change feed: ``keys``, ``_ins``, ``_upd``, ``_del``, ``_p<i>``, ``_c<i>``.

    ``op`` is compared without outer blanks and case. An insert assigns all of
    ``columns``, an update those that aren't null or, where the column ``changed``
    (array of names) isn't null, those that it lists. ``states`` is the result of an
    earlier call; positions already applied to a column of it have no further effect,
    and late ones take the effect that they would have had in order.

    * Repeated changes have no further effect.
    * Changes with a null key or position, and those with another ``op``, have none.
    * Of two changes of one key at one position, a delete counts before a write, and
      for each column the greater value counts, null being least.
    * An empty feed gives no rows. Other columns are ignored, whatever their names.
    """
    keys, columns = list(keys), list(columns)
    unit = _unit_states(changes, keys, pos, op, columns, changed, tuple(inserts), tuple(updates), tuple(deletes))
    names = [f"_k{i}" for i in range(len(keys))]
    order = [*names, F.greatest("_ins", "_upd", "_del")]
    machine = _replay_sorted(names, len(columns))
    partial = unit.sortWithinPartitions(*order).mapInArrow(machine, unit.schema)
    if states is not None:
        partial = partial.unionByName(states.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)), *unit.columns[len(keys) :]))
    merged = partial.repartition(*names).sortWithinPartitions(*order).mapInArrow(machine, unit.schema)
    return merged.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), *unit.columns[len(keys) :])


def current_rows(states: DataFrame, keys: Sequence[str], columns: Sequence[str], pos: str = "pos", create_on_update: bool = True) -> DataFrame:
    """The rows that exist after a replay: ``keys``, ``columns`` and ``pos``, the position of the last write.

    A row exists if it was written after its last delete; ``create_on_update`` says
    whether an update of a missing row makes one. A column assigned only before the
    last delete is null.
    """
    deleted = F.coalesce("_del", F.lit(int(_NEVER)))
    last = F.greatest("_ins", "_upd")
    born = last if create_on_update else F.col("_ins")
    return states.where(born.isNotNull() & (born > deleted)).select(
        *(F.col(f"`{k}`") for k in keys),
        *(F.when(F.col(f"_p{i}") > deleted, F.col(f"_c{i}")).alias(c) for i, c in enumerate(columns)),
        last.alias(pos),
    )


def rebuild(changes: DataFrame, keys: Sequence[str], pos: str, op: str, columns: Sequence[str], **options) -> DataFrame:
    """:func:`replay_changes` and :func:`current_rows` in one."""
    return current_rows(replay_changes(changes, keys, pos, op, columns, **options), keys, columns)
