"""Text cut off by field limits or in transfer.

Three kinds of evidence meet in one posterior, as log odds:

* the ending: whether the text stops inside a cue's header, a tag, a word or a sentence;
* what was declared about the whole text: more characters or cues than there are;
* the length: per source, a log-normal distribution of lengths is fitted by maximum
  likelihood, right-censored at the lengths at which values pile up. At such a
  candidate limit the prior odds of a cut are those of the censored to the ordinary
  values of that length; elsewhere they are the source's rate of cuts in transfer.

A pile of complete texts is no limit: a candidate counts only if the endings of its
values, taken together, speak for cuts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.mixing import source_name
from palimpsest.operators.joins import lookup_join
from palimpsest.session import written


#: Rows up to which a lookup that grows with the number of texts is broadcast.
GROWING_ROWS = 10_000


@dataclass(frozen=True)
class Evidence:
    """Log likelihood ratios, cut to complete.

    Their sizes follow from how texts end whose length is exactly at a limit of their
    source (cuts, whatever they end in) and how texts end in general.
    """

    in_header: float = 9.0
    empty_cue: float = 6.0
    broken_character: float = 7.0
    open_mark: float = 7.0
    hanging_space: float = 6.5
    half_dialogue: float = 2.0
    closed: float = -2.8
    two_dots: float = 4.0
    #: No closing mark at the end of the text; less a line break after it, which cut texts rarely have.
    unclosed: float = 6.2
    unclosed_then_break: float = 1.0
    #: An ellipsis after words that end no other text: it may have been put where the text was cut.
    rare_ellipsis: float = 2.5
    more_chars_declared: float = 7.0
    more_cues_declared: float = 3.0
    as_many_cues_declared: float = -0.8
    fewer_cues_declared: float = -2.0
    #: Chance that a line break follows, of a complete and of a cut text with the same last words.
    break_if_complete: float = 0.67
    break_if_cut: float = 0.03
    #: The most that a recurring ending can say for completeness.
    recurring: float = 8.0
    #: Bounds of one value's part in accepting a limit.
    least_vote: float = -3.0
    most_vote: float = 6.0
    #: A limit needs so many values, so many times what the fit expects, and so much evidence beyond none.
    limit_count: int = 5
    limit_excess: float = 10.0
    limit_evidence: float = 2.0
    #: Rate of cuts in transfer before anything is known of a source.
    first_rate: float = 0.02
    threshold: float = 0.5


# Time marks of a cue in either format; the hours may be missing.
_TIME = r"(?:\d+:)?\d{1,2}:\d{2}[,.]\d{3}"
_MARKS = rf"{_TIME} *--> *{_TIME}"
_ELLIPSIS = r"(?:\.\.\.|…)"
_PARTIAL_HEADER = rf"^(?:WEBVTT[^\n]*\n)?\d*\n?[\d:.,]*(?: [-> ]*[\d:.,]*)?(?:{_ELLIPSIS}|�)?$"
# Closing marks, and what dashes and ellipses become when text is decoded wrongly once or twice.
_CLOSED = (
    r'(?:[.!?…。！？"”»\)\]♪♫—–\x85\x96\x97]'
    r"|â\x80[\x93\x94\xa6]|â€[”“¦\x9d]|Ã¢Â\x80Â[\x93\x94\xa6])$"
)


def endings(documents: DataFrame, e: Evidence = Evidence()) -> DataFrame:
    """Of each text its lengths, the evidence of its ending but for recurrence, and the form of its last words."""
    text = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    rows = documents.where(F.col("text").isNotNull()).select(
        "doc_id",
        F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"),
        F.length("text").cast("bigint").alias("chars"),
        F.octet_length("text").cast("bigint").alias("bytes"),
        F.col("n_chars").alias("declared_chars"),
        F.col("n_cues").alias("declared_cues"),
        text.alias("_text"),
    )
    rows = rows.withColumn("_body", F.rtrim(F.col("_text"), F.lit("\n"))).withColumn("breaks", (F.length("_text") - F.length("_body")).cast("int"))
    rows = rows.withColumn("_cues", F.floor((F.length("_text") - F.length(F.replace("_text", F.lit("-->"), F.lit("")))) / 3)).withColumn("_block", F.substring_index("_body", "\n\n", -1)).drop("_text")
    marked = F.col("_block").rlike(_MARKS)
    rows = rows.withColumn("_cue", F.when(marked, F.regexp_extract("_block", rf"(?s)^.*{_MARKS}[^\n]*\n?(.*)$", 1)).otherwise(F.col("_block")))
    rows = rows.withColumn("_line", F.trim(F.regexp_replace(F.substring_index("_cue", "\n", -1), r"<[^>]*>|\{[^}]*\}", "")))
    cue, line = F.col("_cue"), F.col("_line")
    header = ~marked & F.col("_block").rlike(_PARTIAL_HEADER)
    empty = marked & (line == "")
    dialogue = F.length(cue) - F.length(F.regexp_replace(cue, r"(?m)^- ", " ")) == 1
    open_mark = cue.rlike(r"<[^>]*$|\{[^}]*$|\[[^\]]*$|\([^)]*$") | line.rlike(r"^♪[^♪]*(?:♪[^♪]*♪[^♪]*)*$") & ~line.rlike(r"[^♪]♪$")
    ellipsis = line.rlike(rf"{_ELLIPSIS}$")
    closed = line.rlike(_CLOSED)
    # A song whose notes were decoded wrongly still begins and ends with the same token.
    first, last = F.substring_index(line, " ", 1), F.substring_index(line, " ", -1)
    enclosed = (first == last) & (first != line) & ~first.rlike(r"^[\p{L}\p{N}]{1,2}$|^-")
    state = (
        F.when(header, "header")
        .when(empty, "empty")
        .when(line.endswith("�"), "broken")
        .when(open_mark, "open")
        .when(line.rlike(r"(?:^|[^.])\.\.$"), "two_dots")
        .when((F.col("breaks") == 0) & cue.rlike(r"[ \t]$"), "space")
        .when(ellipsis & (F.col("breaks") == 0), "ellipsis")
        .when(closed | enclosed, "closed")
        .otherwise("unclosed")
    )
    words = F.split(F.regexp_replace(line, r"\d+", "#"), r"\s+")
    # Hashed, as a text without blanks may end in a word of any length.
    form = F.when(F.size(words) > 1, F.xxhash64(F.slice(words, -2, 2))).otherwise(F.xxhash64(F.lit("\n"), words[0]))
    n_cues, n_chars = F.col("declared_cues"), F.col("declared_chars")
    declared = F.when((n_chars > F.col("chars")) & (n_chars != F.col("bytes")), e.more_chars_declared).otherwise(0.0) + F.when(
        n_cues > F.col("_cues"), e.more_cues_declared
    ).when(n_cues == F.col("_cues"), e.as_many_cues_declared).when(n_cues < F.col("_cues"), e.fewer_cues_declared).otherwise(0.0)
    rows = rows.select("doc_id", "source", "chars", "bytes", "breaks", state.alias("state"), dialogue.alias("half"), form.alias("_form"), declared.alias("declared"), F.xxhash64("_block").alias("block"), ellipsis.alias("ellipsis"))
    s = F.col("state")
    base = (
        F.when(s == "header", e.in_header)
        .when(s == "empty", e.empty_cue)
        .when(s == "broken", e.broken_character)
        .when(s == "open", e.open_mark)
        .when(s == "two_dots", e.two_dots)
        .when(s == "space", e.hanging_space)
        .when(s == "closed", F.lit(e.closed) + F.when(F.col("half"), e.half_dialogue).otherwise(0.0))
        .when(s == "ellipsis", e.rare_ellipsis)
        .otherwise(F.when(F.col("breaks") == 0, e.unclosed).otherwise(e.unclosed_then_break))
    )
    return rows.select(
        "doc_id", "source", "chars", "bytes", "state", "block", (F.col("breaks") > 0).alias("broken_off"), F.when(s.isin("ellipsis", "unclosed") | F.col("ellipsis"), F.col("_form")).alias("form"), (base + F.col("declared")).alias("evidence")
    )


def with_recurrence(ends: DataFrame, e: Evidence = Evidence()) -> DataFrame:
    """Last words that end other texts with a line break after them speak for completeness.

    Counted over all texts, but copies of a last cue, marks of time included, count
    once: a text that was uploaded again says nothing new. Where any copy lacks the
    line break, the others may have got theirs since. Every count is reduced before
    its shuffle.
    """
    # What is read more than once is written: a few numbers per text with a form.
    blocks = written(ends.where("form IS NOT NULL").groupBy("form", "block").agg(F.min("broken_off").alias("_all"), F.max("broken_off").cast("bigint").alias("_own")), "blocks")
    forms = written(blocks.groupBy("form").agg(F.sum("_own").alias("_with"), F.sum(1 - F.col("_own")).alias("_without")).where("_with > 0"), "forms")
    # A form may hold a third of the blocks. Texts that end otherwise take no part in the join.
    known = written(lookup_join(blocks, forms, ["form"], "left", max_rows=GROWING_ROWS, spread=["block"]), "known")
    joined = lookup_join(ends.where("form IS NOT NULL"), known, ["form", "block"], "left", max_rows=GROWING_ROWS, spread=["doc_id", "chars"])
    joined = joined.unionByName(ends.where("form IS NULL"), allowMissingColumns=True)
    with_break = F.coalesce(F.col("_with") - F.col("_own"), F.lit(0))
    without = F.coalesce(F.col("_without") - (1 - F.col("_own")), F.lit(0))
    says = with_break * math.log(e.break_if_complete / e.break_if_cut) + without * math.log((1 - e.break_if_complete) / (1 - e.break_if_cut))
    complete = F.greatest(F.lit(0.0), F.least(F.lit(e.recurring), says))
    lost_break = (F.col("state") == "unclosed") & F.col("broken_off") & ~F.col("_all")
    found = F.col("evidence") + F.when(lost_break, e.unclosed - e.unclosed_then_break).otherwise(0.0) - complete
    # An ellipsis that recurs is an ordinary closed ending, not more.
    found = F.when(F.col("state") == "ellipsis", F.greatest(found, F.col("evidence") - (e.rare_ellipsis - e.closed))).otherwise(found)
    return joined.select("doc_id", "source", "chars", "bytes", "state", "block", F.when(F.col("state").isin("ellipsis", "unclosed"), found).otherwise(F.col("evidence")).alias("evidence"))


def log_normal_density(length: float, mu: float, sigma: float) -> float:
    z = (math.log(length) - mu) / sigma
    return math.exp(-z * z / 2) / (length * sigma * math.sqrt(2 * math.pi))


def fit_censored(n: float, s1: float, s2: float, censored: Sequence[tuple[float, float]], rounds: int = 200) -> tuple[float, float]:
    """Maximum likelihood of a log-normal from ``n`` values with sums ``s1``, ``s2`` of logarithms and their squares,
    and ``censored`` values, each (limit, how many), of which only is known that they are at least that long.

    Expectation maximisation; it ends when the parameters stand still.
    """
    total = n + sum(m for _, m in censored)
    if total <= 0:
        return 0.0, 1.0
    mu = (s1 + sum(m * math.log(v) for v, m in censored)) / total
    sigma = math.sqrt(max((s2 + sum(m * math.log(v) ** 2 for v, m in censored)) / total - mu * mu, 1e-4))
    for _ in range(rounds):
        t1, t2 = s1, s2
        for v, m in censored:
            z = (math.log(v) - mu) / sigma
            tail = max(math.erfc(z / math.sqrt(2)) / 2, 1e-300)
            hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail if z < 30 else z
            t1 += m * (mu + sigma * hazard)
            t2 += m * (mu * mu + 2 * mu * sigma * hazard + sigma * sigma * (1 + z * hazard))
        new_mu = t1 / total
        new_sigma = math.sqrt(max(t2 / total - new_mu * new_mu, 1e-4))
        moved = abs(new_mu - mu) + abs(new_sigma - sigma)
        mu, sigma = new_mu, new_sigma
        if moved < 1e-9:
            break
    return mu, sigma


_LIMITS = "source string, unit string, at bigint, held bigint, expected double, prior double, mu double, sigma double"


def share_of_cuts(evidence: Sequence[tuple[float, int]], first: float, rounds: int = 50) -> float:
    """The share of cuts among values of which each has this evidence (log likelihood ratio, how many), by expectation maximisation from ``first``."""
    total = sum(n for _, n in evidence)
    share = min(max(first, 1e-3), 1 - 1e-3)
    for _ in range(rounds):
        prior = math.log(share / (1 - share))
        found = sum(n / (1 + math.exp(-max(-700.0, x + prior))) for x, n in evidence) / total
        share = min(max(found, 1e-3), 1 - 1e-3)
    return share


def _fit_groups(e: Evidence):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        n, s1, s2 = float(first["n"]), float(first["s1"]), float(first["s2"])
        ends = {int(v): list(zip(g["evidence"], g["held"], strict=True)) for v, g in frame.groupby("at")}
        piles = [(v, c) for v, c in ((v, int(sum(m for _, m in x))) for v, x in ends.items()) if c >= e.limit_count]
        mu, sigma = fit_censored(n, s1, s2, ())
        for _ in range(5):
            # The part of each pile beyond what the fit expects at that very length is censored.
            excess = [(v, max(0.0, c - n * log_normal_density(v, mu, sigma))) for v, c in piles]
            mu, sigma = fit_censored(
                n - sum(m for _, m in excess), s1 - sum(m * math.log(v) for v, m in excess), s2 - sum(m * math.log(v) ** 2 for v, m in excess), excess
            )
        rows = []
        for v, c in piles:
            expected = max(n * log_normal_density(v, mu, sigma), 1e-3)
            if c >= e.limit_excess * expected:
                # A pile may hold more complete texts than its length explains; their endings show it.
                share = share_of_cuts(ends[v], 1 - expected / c)
                rows.append((first["source"], first["unit"], v, c, expected, min(math.log(max(c - expected, 1e-3) / expected), math.log(share / (1 - share))), mu, sigma))
        return pd.DataFrame(rows, columns=["source", "unit", "at", "held", "expected", "prior", "mu", "sigma"])

    return fit


def _piles(lengths: DataFrame, e: Evidence) -> DataFrame:
    """Lengths at which values pile up, with the endings for a limit, and the sums of their source's logarithms.

    ``lengths`` has source, unit, at, block and evidence. Copies of a last cue count once.
    """
    vote = F.greatest(F.lit(e.least_vote), F.least(F.lit(e.most_vote), F.col("evidence")))
    values = lengths.groupBy("source", "unit", "at", "block").agg(F.max(vote).alias("vote"))
    counts = values.groupBy("source", "unit", "at").agg(F.count("*").alias("held"), F.sum("vote").alias("votes"))
    log = F.log("at")
    sums = counts.groupBy("source", "unit").agg(F.sum("held").cast("double").alias("n"), F.sum(F.col("held") * log).alias("s1"), F.sum(F.col("held") * log * log).alias("s2"))
    piles = counts.where((F.col("held") >= e.limit_count) & (F.col("votes") > e.limit_evidence))
    joined = lookup_join(piles, sums, ["source", "unit"], spread=["at"])
    mean, var = F.col("s1") / F.col("n"), F.greatest(F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) ** 2, F.lit(1e-4))
    density = F.exp(-((F.log("at") - mean) ** 2) / (2 * var)) / (F.col("at") * F.sqrt(2 * math.pi * var))
    return joined.where(F.col("held") >= e.limit_excess * F.col("n") * density)


def at_piles(ends: DataFrame, e: Evidence = Evidence()) -> tuple[DataFrame, DataFrame]:
    """``ends`` with the pile, unit and length, that each text may belong to, and the piles.

    A text of plain letters at a limit in characters is at one length in bytes as
    well; it belongs to the larger pile of the two, and a pile is then counted by the
    texts that belong to it.
    """
    lengths = ends.where("chars > 0").select("source", F.explode(F.create_map(F.lit("char"), F.col("chars"), F.lit("byte"), F.col("bytes"))).alias("unit", "at"), "block", "evidence")
    piles = written(_piles(lengths, e), "piles")
    out = ends
    for unit, column in (("char", "chars"), ("byte", "bytes")):
        at = piles.where(F.col("unit") == unit).select("source", F.col("at").alias(column), F.col("held").alias(f"{unit}_held"))
        out = lookup_join(out, at, ["source", column], "left", spread=["doc_id", "block"])
    in_bytes = F.coalesce("byte_held", F.lit(0)) > F.coalesce("char_held", F.lit(0))
    unit = F.when(in_bytes, "byte").when(F.col("char_held").isNotNull(), "char")
    out = out.withColumn("unit", unit).withColumn("at", F.when(in_bytes, F.col("bytes")).when(F.col("unit") == "char", F.col("chars"))).drop("char_held", "byte_held")
    return out, piles


def limits(ends: DataFrame, piles: DataFrame, e: Evidence = Evidence()) -> DataFrame:
    """The limits of each source: unit (char or byte), length, values there, values expected, and log odds of a cut.

    ``ends`` has the pile of each text, as :func:`at_piles` returns it. What is grouped by source is a few piles' histograms of evidence.
    """
    own = ends.where("unit IS NOT NULL").groupBy("source", "unit", "at", "block").agg(F.max("evidence").alias("evidence"))
    histogram = own.groupBy("source", "unit", "at", (F.round(F.col("evidence") * 4) / 4).alias("evidence")).agg(F.count("*").alias("held"))
    real = histogram.join(piles.select("source", "unit", "at", "n", "s1", "s2"), ["source", "unit", "at"])
    return real.groupBy("source", "unit").applyInPandas(_fit_groups(e), _LIMITS)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def transfer_rates(ends: DataFrame, e: Evidence = Evidence()) -> DataFrame:
    """Each source's rate of cuts among texts at no pile: two steps of expectation maximisation over its histogram of evidence."""
    histogram = ends.where("unit IS NULL").groupBy("source", (F.round(F.col("evidence") * 2) / 2).alias("evidence")).agg(F.count("*").alias("held"))
    once = F.sum(F.col("held") * _sigmoid(F.col("evidence") + math.log(e.first_rate / (1 - e.first_rate)))) / F.sum("held")
    first = histogram.groupBy("source").agg(once.alias("rate"), F.collect_list(F.struct("evidence", "held")).alias("h"))
    # A source's histogram has a few dozen bins, whatever its size.
    prior = F.log(F.col("rate") / (1 - F.col("rate")))
    again = F.aggregate(
        F.col("h"), F.lit(0.0), lambda a, x: a + x["held"] * _sigmoid(x["evidence"] + prior)
    ) / F.aggregate(F.col("h"), F.lit(0).cast("bigint"), lambda a, x: a + x["held"])
    bounded = F.greatest(F.lit(1e-3), F.least(F.lit(0.5), again))
    return first.select("source", F.log(bounded / (1 - bounded)).alias("rate_prior"))


def truncated(documents: DataFrame, e: Evidence = Evidence()) -> DataFrame:
    """Each text with its posterior of being cut: ``doc_id``, ``source``, ``chars``, ``bytes``, ``state``, ``at_limit``, ``posterior``, ``is_cut``.

    ``documents`` has ``doc_id``, ``text``, ``source``, ``n_chars`` and ``n_cues``.

    * A null text has no row. An empty text ends in a header and is a cut.
    * Sources are compared without outer blanks and case; documents without a source
      are a source of their own, reported as null. Null declarations say nothing.
    * Repeated ids are documents each; equal texts get equal results.
    * Very long texts are read whole; only the last cue is looked at closely.
    * Other columns are ignored.
    """
    ends = written(with_recurrence(written(endings(documents, e), "endings"), e), "evidence")
    placed, piles = at_piles(ends, e)
    placed = written(placed, "placed")
    found = limits(placed, piles, e).select("source", "unit", "at", "prior")
    out = lookup_join(placed, written(transfer_rates(placed, e), "rates"), ["source"], "left", spread=["doc_id", "chars"])
    out = lookup_join(out, written(found, "limits"), ["source", "unit", "at"], "left", spread=["doc_id", "block"])
    rate = F.coalesce("rate_prior", F.lit(math.log(e.first_rate / (1 - e.first_rate))))
    posterior = _sigmoid(F.col("evidence") + F.coalesce(F.greatest("prior", rate), rate))
    return out.select(
        "doc_id", F.nullif("source", F.lit("")).alias("source"), "chars", "bytes", "state", F.col("prior").isNotNull().alias("at_limit"), posterior.alias("posterior"), (posterior > e.threshold).alias("is_cut")
    )


def cut_rates(judged: DataFrame) -> DataFrame:
    """How often each source truncates."""
    return judged.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("is_cut").cast("bigint")).alias("cut"), F.sum((F.col("is_cut") & F.col("at_limit")).cast("bigint")).alias("cut_at_limit"), F.avg(F.col("is_cut").cast("double")).alias("cut_rate")
    )
