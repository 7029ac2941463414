"""Queries of the training-data problems over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.ledger import KeyLedger
from palimpsest.llm.mixing import SEED, draw, mixture_plan, shares
from palimpsest.llm.packing import OPEN_BINS, fill, pack
from palimpsest.llm import truncation
from palimpsest.llm.truncation import cut_rates, endings, truncated
from palimpsest.plans.tables import in_growing_batches, table
from palimpsest.session import scratch_path, written

#: Records in each of the ledger's first batches, at most, and the number of these; a later batch has as many as came before it.
LEDGER_BATCH, LEDGER_BATCHES = 1_000_000, 4


# --- 1: has this key been seen before?


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """The records seen before: each batch, in order of arrival, as the ledger answers it, written at once so that no plan spans the batches."""
    rows = table(spark, sf, "sst_record").select("rec_id", "k")
    ledger = KeyLedger(spark, scratch_path(spark, "ledger"))
    ledger.seed(table(spark, sf, "key_ledger"), "k")
    batches = in_growing_batches(rows, "rec_id", LEDGER_BATCH, LEDGER_BATCHES)
    return reduce(DataFrame.unionByName, [written(ledger.add(batch, "k", "rec_id", b).select("rec_id"), "seen") for b, batch in enumerate(batches)])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf)


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Records, those seen before, and the share of wrong answers, against the whole history at once."""
    rows = table(spark, sf, "sst_record").select("rec_id", "k")
    said = _answers(spark, sf).withColumn("said", F.lit(1))
    known = table(spark, sf, "key_ledger").select("k", F.lit(-1).cast("bigint").alias("rec_id")).unionByName(rows.select("k", "rec_id"))
    first = known.where("k IS NOT NULL").groupBy("k").agg(F.min("rec_id").alias("rec_id"))
    new = first.where("rec_id >= 0").select("rec_id").withColumn("new", F.lit(1))
    judged = rows.join(said, "rec_id", "left").join(new, "rec_id", "left")
    truth = F.col("k").isNotNull() & F.col("new").isNull()
    return judged.agg(
        F.count("*").alias("records"),
        F.sum(F.col("said").isNotNull().cast("bigint")).alias("seen_before"),
        F.avg((F.col("said").isNotNull() != truth).cast("double")).alias("wrong_share"),
    )


# --- 6: filling containers


def _placements(spark: SparkSession, sf: str) -> DataFrame:
    """Every document packed for every specification; these are parameters, a handful, and come to the driver."""
    specs = [(r["spec_id"], r["capacity_tokens"]) for r in table(spark, sf, "container_spec").select("spec_id", "capacity_tokens").distinct().collect()]
    items = table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return pack(items, "doc_id", "size", specs)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which the packing made more than one piece: each has one piece with number 1."""
    return _placements(spark, sf).where("piece_no = 1").select("spec_id", F.col("item_id").alias("doc_id"))


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each document: its pieces, their size together, and the largest and the smallest."""
    return _placements(spark, sf).groupBy("spec_id", F.col("item_id").alias("doc_id")).agg(F.count("*").alias("pieces"), F.sum("piece_size").alias("size"), F.max("piece_size").alias("largest"), F.min("piece_size").alias("smallest"))


#: The share of the space that must be used, counting out what an open container of a partition may lack.
LEAST_FILL = 0.95


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The packing against what any packing needs: containers at most the least number over ``LEAST_FILL`` and the open ones of the partitions; none above its capacity."""
    placed = written(_placements(spark, sf), "placed")
    partitions = placed.select(F.shiftright("container_id", 40).alias("p")).distinct().count()
    bound = F.ceil(F.col("least_containers") / F.lit(LEAST_FILL)) + partitions * OPEN_BINS
    return fill(placed).select("spec_id", "capacity", "size", "least_containers", (F.col("containers") >= F.col("least_containers")).alias("enough"), (F.col("containers") <= bound).alias("well_filled"), (F.col("fullest") > F.col("capacity")).alias("overfull"))


def p6_placed(spark: SparkSession, sf: str) -> DataFrame:
    """What any packing keeps: documents, pieces of split documents and sizes per specification; and no container above its capacity."""
    return (
        fill(_placements(spark, sf))
        .select("spec_id", "capacity", "items", F.col("split_items").alias("split_documents"), "size", "least_containers", (F.col("fullest") > F.col("capacity")).alias("overfull"))
    )


# --- 7: mixing sources


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", F.octet_length("text").alias("size"))


def p7_plan(spark: SparkSession, sf: str) -> DataFrame:
    return mixture_plan(_sized(spark, sf), table(spark, sf, "mix_target")).select("mix_id", "source", "source_size", "target_size", "rate", "short")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixture_plan(_sized(spark, sf), table(spark, sf, "mix_target")).where("short").select("mix_id", "source").distinct()


def p7_draw(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sized(spark, sf)
    return draw(rows, written(mixture_plan(rows, table(spark, sf, "mix_target")), "plan"), ["doc_id"])


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sized(spark, sf)
    plan = written(mixture_plan(rows, table(spark, sf, "mix_target")), "plan")
    return shares(plan, draw(rows, plan, ["doc_id"]))


# --- 8: truncated texts


def p8_judged(spark: SparkSession, sf: str) -> DataFrame:
    return truncated(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncated(table(spark, sf, "documents")).where("is_cut").select("doc_id").distinct()


def p8_endings(spark: SparkSession, sf: str) -> DataFrame:
    """The class of each text's ending, and its lengths: the evidence that needs no other text."""
    return endings(table(spark, sf, "documents")).select("doc_id", "chars", "bytes", "state")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return cut_rates(truncated(table(spark, sf, "documents")))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p6_found": p6_found,
    "p6_placed": p6_placed,
    "p6_fill": p6_fill,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_plan": p7_plan,
    "p7_draw": p7_draw,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_judged": p8_judged,
    "p8_rates": p8_rates,
    "p8_endings": p8_endings,
}

_P1 = """
WITH known AS (SELECT k, -1 AS rec_id FROM key_ledger UNION ALL SELECT k, rec_id FROM sst_record),
first AS (SELECT k, min(rec_id) AS first_id FROM known WHERE k IS NOT NULL GROUP BY k),
found AS (SELECT r.rec_id FROM sst_record r JOIN first f ON r.k = f.k WHERE f.first_id < r.rec_id)
"""

_P6 = "WITH sized AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS size FROM documents)"

_P7 = """
WITH sized AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, coalesce(octet_length(encode(text)), 0) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sized GROUP BY source),
plan AS (
  SELECT t.mix_id, t.source, coalesce(s.source_size, 0) AS source_size, t.target_share * (t.budget_ratio * (SELECT CAST(sum(size) AS DOUBLE) FROM sized)) AS target_size, t.max_repeats
  FROM mix_target t LEFT JOIN sizes s ON t.source = s.source
)
"""

_P7_DRAWN = (
    _P7.replace("SELECT lower(regexp", "SELECT doc_id, lower(regexp")
    + f"""
, rated AS (SELECT t.*, p.target_size, p.max_repeats * p.source_size < p.target_size AS short,
    CASE WHEN p.source_size > 0 THEN least(p.target_size / p.source_size, CAST(p.max_repeats AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS rate
  FROM mix_target t JOIN plan p ON t.mix_id = p.mix_id AND t.source = p.source),
copied AS (SELECT r.mix_id, r.source, d.doc_id, d.size, CAST(floor(r.rate) AS BIGINT)
    + CASE WHEN CAST('0x' || substr(md5('{SEED}|' || r.mix_id || '|' || d.doc_id), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM sized d JOIN rated r ON d.source = r.source WHERE r.rate > 0),
drawn AS (SELECT mix_id, source, doc_id, size, CAST(unnest(range(copies)) AS INTEGER) AS copy_no FROM copied)
"""
)


def _text(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


_P8 = f"""
WITH t AS (SELECT doc_id, text, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, rtrim(x, chr(10)) AS body, length(x) - length(rtrim(x, chr(10))) AS breaks FROM t),
c AS (SELECT *, string_split(body, chr(10) || chr(10))[-1] AS block FROM b),
d AS (SELECT *, regexp_matches(block, {_text(truncation._MARKS)}) AS marked FROM c),
e AS (SELECT *, CASE WHEN marked THEN regexp_extract(block, {_text(rf"(?s)^.*{truncation._MARKS}[^\n]*\n?(.*)$")}, 1) ELSE block END AS cue FROM d),
f AS (SELECT *, trim(regexp_replace(string_split(cue, chr(10))[-1], '<[^>]*>|\\{{[^}}]*\\}}', '', 'g'), ' ') AS line FROM e),
g AS (SELECT *, string_split(line, ' ')[1] AS head, string_split(line, ' ')[-1] AS tail FROM f)
SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS bytes, CASE
  WHEN NOT marked AND regexp_matches(block, {_text(truncation._PARTIAL_HEADER)}) THEN 'header'
  WHEN marked AND line = '' THEN 'empty'
  WHEN suffix(line, chr(65533)) THEN 'broken'
  WHEN regexp_matches(cue, '<[^>]*$|\\{{[^}}]*$|\\[[^\\]]*$|\\([^)]*$') OR (regexp_matches(line, '^♪[^♪]*(?:♪[^♪]*♪[^♪]*)*$') AND NOT regexp_matches(line, '[^♪]♪$')) THEN 'open'
  WHEN regexp_matches(line, '(?:^|[^.])\\.\\.$') THEN 'two_dots'
  WHEN breaks = 0 AND regexp_matches(cue, '[ \\t]$') THEN 'space'
  WHEN breaks = 0 AND regexp_matches(line, {_text(truncation._ELLIPSIS + "$")}) THEN 'ellipsis'
  WHEN regexp_matches(line, {_text(truncation._CLOSED)}) OR (head = tail AND head <> line AND NOT regexp_matches(head, '^[\\p{{L}}\\p{{N}}]{{1,2}}$|^-')) THEN 'closed'
  ELSE 'unclosed' END AS state FROM g
"""

SQL = {
    "p1_found": _P1 + "SELECT rec_id FROM found",
    "p1_report": _P1 + "SELECT (SELECT count(*) FROM sst_record) AS records, (SELECT count(*) FROM found) AS seen_before, CAST(0 AS DOUBLE) AS wrong_share",
    "p6_found": _P6 + "SELECT spec_id, doc_id FROM sized, container_spec WHERE size > capacity_tokens",
    "p6_placed": _P6
    + """SELECT spec_id, capacity_tokens AS capacity, count(*) AS items, CAST(sum(CASE WHEN size > capacity_tokens THEN 1 ELSE 0 END) AS BIGINT) AS split_documents,
    CAST(sum(size) AS BIGINT) AS size, CAST(ceil(sum(size) / capacity_tokens) AS BIGINT) AS least_containers, false AS overfull FROM sized, container_spec GROUP BY spec_id, capacity_tokens""",
    "p6_pieces": _P6
    + """, p AS (SELECT spec_id, doc_id, size, capacity_tokens AS c, greatest(1, CAST(ceil(size / capacity_tokens) AS BIGINT)) AS pieces FROM sized, container_spec)
    SELECT spec_id, doc_id, pieces, CAST(size AS BIGINT) AS size, least(size, c) AS largest, CAST(size - (pieces - 1) * c AS BIGINT) AS smallest FROM p""",
    "p6_fill": _P6
    + """SELECT spec_id, capacity_tokens AS capacity, CAST(sum(size) AS BIGINT) AS size, CAST(ceil(sum(size) / capacity_tokens) AS BIGINT) AS least_containers, true AS enough, true AS well_filled, false AS overfull
    FROM sized, container_spec GROUP BY spec_id, capacity_tokens""",
    "p7_draw": _P7_DRAWN + "SELECT mix_id, source, doc_id, CAST(size AS BIGINT) AS size, copy_no FROM drawn",
    "p7_shares": _P7_DRAWN
    + """, got AS (SELECT mix_id, source, CAST(sum(size) AS BIGINT) AS drawn_size, count(*) AS copies, max(copy_no) + 1 AS most_repeats FROM drawn GROUP BY mix_id, source),
    whole AS (SELECT mix_id, sum(drawn_size) AS mix_size FROM got GROUP BY mix_id)
    SELECT r.mix_id, r.source, r.target_share, r.rate, r.short, coalesce(g.drawn_size, 0) AS drawn_size, coalesce(g.copies, 0) AS copies, coalesce(g.most_repeats, 0) AS most_repeats,
    coalesce(g.drawn_size, 0) / (CASE WHEN r.target_share > 0 THEN r.target_size / r.target_share END) AS share_of_budget, coalesce(g.drawn_size, 0) / w.mix_size AS share_of_drawn
    FROM rated r LEFT JOIN got g ON r.mix_id = g.mix_id AND r.source = g.source LEFT JOIN whole w ON r.mix_id = w.mix_id""",
    "p8_endings": _P8,
    "p7_found": _P7 + "SELECT DISTINCT mix_id, source FROM plan WHERE max_repeats * source_size < target_size",
    "p7_plan": _P7
    + """SELECT mix_id, source, source_size, target_size, CASE WHEN source_size > 0 THEN least(target_size / source_size, CAST(max_repeats AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS rate,
    max_repeats * source_size < target_size AS short FROM plan""",
}
