"""The replay of shipping runs on small tables with every kind of run."""

import random
from datetime import datetime, timedelta

from palimpsest.plans.problems import bases, followers, shipments, shipped_by_runs

START = datetime(2025, 1, 1)
STATE = "store_id bigint, run_no bigint, outcome string, started_at timestamp_ntz, leader string, nodes array<string>, follower_indices map<string,bigint>"


def generate(seed):
    """Runs that fail, that confirm less than one before, that begin earlier, that are saved twice, and that say nothing of a follower."""
    rng = random.Random(seed)
    nodes = ["http://l", "http://a/", "http://b", "http://c"]
    states = []
    for store in (1, 2):
        for run in range(1, 13):
            told = {rng.choice([u.upper(), u.rstrip("/"), u]): rng.choice([None, rng.randint(0, 30)]) for u in nodes[1:3] if rng.random() < 0.7}
            row = (store, run, rng.choice(["ok", "OK", "failed", None]), rng.choice([None, START + timedelta(hours=rng.randint(0, 40))]), nodes[0], nodes if run > 3 else nodes[:2], told)
            states += [row] * rng.choice([1, 1, 2])
    entries = [(store, i, START + timedelta(hours=rng.randint(0, 40))) for store in (1, 2, 3) for i in range(30)]
    return states, entries


def expected(states, entries):
    def address(u):
        return u.lower().removesuffix("/")

    out = []
    for store in {s[0] for s in states}:
        ok = [s for s in states if s[0] == store and s[2] and s[2].lower() == "ok"]
        if not ok:
            continue
        last = max(ok, key=lambda s: s[1])
        for node in set(last[5]) - {last[4]}:
            known = [(s[1], i, s[3]) for s in ok for u, i in s[6].items() if i is not None and address(u) == address(node)]
            base = max(known, key=lambda k: k[:2]) if known else None
            for e in (e for e in entries if e[0] == store):
                if base is None or e[1] > base[1] or (base[2] is not None and e[2] > base[2]):
                    out.append((store, node, e[1]))
    return sorted(out)


def test_replay_equals_the_last_runs_word(spark, rows):
    for seed in range(4):
        states, entries = generate(seed)
        s = spark.createDataFrame(states, STATE)
        e = spark.createDataFrame(entries, "store_id bigint, index bigint, first_appended_at timestamp_ntz")
        to = followers(s)
        target = shipped_by_runs(spark, e, s, to)
        source = shipments(e, to).drop("address")
        assert rows(target.pending(source).select("store_id", "node_url", "index")) == sorted(expected(states, entries), key=repr)
        assert len(target.table.versions()) >= 4


def test_no_states_and_no_entries(spark):
    s = spark.createDataFrame([], STATE)
    e = spark.createDataFrame([], "store_id bigint, index bigint, first_appended_at timestamp_ntz")
    assert shipped_by_runs(spark, e, s, followers(s)).rows().count() == 0
    assert bases(s, [1, 2]).count() == 0
