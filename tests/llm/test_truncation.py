import math
import random

from palimpsest.llm.truncation import cut_rates, endings, fit_censored, truncated

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, n_cues int, chars string, state string"
WORDS = "the old harbour lantern nobody ever found behind another wooden door said quietly that evening again maybe someone knows where they left".split()


def subtitle(rng, cues, end="\n"):
    out = []
    for n in range(cues):
        kind = rng.random()
        if n == cues - 1 and kind < 0.15:
            text = rng.choice(["THE END", "Subtitles by Harbour Crew", "Visit www.lantern.example"])
        elif kind < 0.7:
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 8))).capitalize() + rng.choice([".", "?", "!", "..."])
        elif kind < 0.8:
            text = "[distant thunder]"
        elif kind < 0.9:
            text = "♪ la la la ♪"
        else:
            text = "I never said—"
        out.append(f"{n + 1}\n00:{n // 60:02d}:{n % 60:02d},100 --> 00:{n // 60:02d}:{n % 60:02d},900\n{text}")
    return "\n\n".join(out) + end


def corpus(seed=5, n=1500, limit=900):
    rng, docs, cut = random.Random(seed), [], set()
    for i in range(n):
        text = subtitle(rng, rng.randint(3, 25), rng.choice(["", "\n", "\n\n"]))
        source = rng.choice(["limited", "free"])
        whole = len(text)
        if source == "limited" and len(text) > limit:
            text = text[:limit]
            cut.add(i)
        elif source == "free" and rng.random() < 0.05:
            at = rng.randrange(60, whole - 4)
            text = text[:at]
            cut.add(i)
        docs.append((i, text, f" {source.upper()}", rng.choice([None, len(text), len(text)]), None, "clash", "clash"))
    return docs, cut


def test_planted_cuts_are_found(spark):
    docs, cut = corpus()
    judged = truncated(spark.createDataFrame(docs, SCHEMA)).collect()
    found = {r["doc_id"] for r in judged if r["is_cut"]}
    assert len(found & cut) / len(cut) > 0.93 and len(found & cut) / len(found) > 0.97
    at_limit = {r["doc_id"] for r in judged if r["at_limit"]}
    assert at_limit == {d[0] for d in docs if d[2] == " LIMITED" and len(d[1]) == 900}
    rates = {r["source"]: r for r in cut_rates(truncated(spark.createDataFrame(docs, SCHEMA))).collect()}
    assert rates["limited"]["cut_at_limit"] > 100 and rates["free"]["cut_at_limit"] == 0


def test_a_pile_of_complete_texts_is_no_limit(spark):
    rng, docs = random.Random(1), []
    for i in range(400):
        docs.append((i, subtitle(rng, rng.randint(3, 25)), "s", None, None, "", ""))
    for i in range(400, 420):  # all of one length, all complete
        text = subtitle(rng, 9, "")
        docs.append((i, text + " " + "x" * (798 - len(text)) + ".", "s", None, None, "", ""))
    judged = truncated(spark.createDataFrame(docs, SCHEMA)).collect()
    assert not any(r["at_limit"] or (r["is_cut"] and r["doc_id"] >= 400) for r in judged)


def test_states_of_endings(spark):
    head = "1\n00:00:01,000 --> 00:00:02,000\n"
    cases = {
        "": "header",
        "1": "header",
        head + "Hello.\n\n2\n00:00:0": "header",
        head + "Hello.\r\n\r\n2\r\n00:00:01,5�": "header",
        "WEBVTT\n\n00:01.000 -->": "header",
        head: "empty",
        head.strip("\n"): "empty",
        head + "Hello.": "closed",
        head + "Hello\n": "unclosed",
        head + "Hel": "unclosed",
        head + "Hello wo�": "broken",
        head + "<i>Hello.</": "open",
        head + "[distant thu": "open",
        head + "♪ la la": "open",
        head + "♪ la la ♪": "closed",
        head + "You were..": "two_dots",
        head + "You were...": "ellipsis",
        head + "You were ": "space",
        "plain text without cues": "unclosed",
    }
    rows = [(i, t, "s", None, None, "", "") for i, t in enumerate(cases)]
    got = {r["doc_id"]: r["state"] for r in endings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_declared_size_outweighs_a_good_ending(spark):
    head = "1\n00:00:01,000 --> 00:00:02,000\nHello."
    rows = [(1, head, "s", 400, 9, "", ""), (2, head, "s", len(head), 1, "", ""), (3, head, None, None, None, "", "")]
    assert {r["doc_id"]: r["is_cut"] for r in truncated(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: True, 2: False, 3: False}


def test_null_empty_long_and_repeated_texts(spark):
    assert truncated(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "1\n00:00:01,000 --> 00:00:02,000\n" + "word " * 200_000 + "end."
    rows = [(1, None, "s", 5, 1, "", ""), (2, "", "s", None, None, "", ""), (3, long, None, None, None, "", ""), (4, long, None, None, None, "", ""), (None, "x", "s", None, None, "", "")]
    got = {r["doc_id"]: r for r in truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {2, 3, 4, None} and got[2]["is_cut"] and not got[3]["is_cut"]
    assert got[3]["posterior"] == got[4]["posterior"] and got[3]["source"] is None


def test_censored_fit_recovers_the_distribution():
    rng = random.Random(0)
    values = [math.exp(rng.gauss(6.5, 0.8)) for _ in range(20_000)]
    limit = 900
    seen = [v for v in values if v < limit]
    logs = [math.log(v) for v in seen]
    mu, sigma = fit_censored(len(seen), sum(logs), sum(x * x for x in logs), [(limit, len(values) - len(seen))])
    assert abs(mu - 6.5) < 0.02 and abs(sigma - 0.8) < 0.02
    naive, _ = fit_censored(len(seen), sum(logs), sum(x * x for x in logs), [])
    assert naive < 6.3
