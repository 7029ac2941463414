"""Bloom filters over files, as relations of the words of their bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.bloom import bit_of, filter_bits, hash_count
from palimpsest.operators.joins import lookup_join


def sizing(files: DataFrame, rate: float, file: str = "file_no") -> DataFrame:
    """Distinct keys, bits and hash functions of each file's filter."""
    sized = files.groupBy(file).agg(F.countDistinct("key").alias("capacity")).withColumn("bits", filter_bits(F.col("capacity"), rate))
    return sized.withColumn("hashes", hash_count(F.col("capacity"), F.col("bits")))


def _spread(keys: DataFrame) -> DataFrame:
    """Distinct keys, few but each about to become several hashes, over all shuffle partitions, not put into few tasks by their size.

    By the columns in reverse, as a repartition like that of the aggregate below it would be dropped.
    """
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), *reversed(keys.columns))


#: Bits in one word of a filter.
WORD = 32


def _hashed(keys: DataFrame, sizes: DataFrame, file: str) -> DataFrame:
    """The words of its file's filter that each key touches, and the mask of its bits in each: at most one row per hash function."""
    asked = lookup_join(_spread(keys.select(file, "key").distinct()), sizes.select(file, "bits", "hashes"), [file], spread=["key"])
    each = asked.select(file, "key", "bits", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("hashes") - 1)).alias("round")).withColumn("bit", bit_of(F.col("key"), F.col("round"), F.col("bits")))
    return _masks(each, file, "key")


def _masks(bits: DataFrame, *by: str) -> DataFrame:
    mask = F.expr(f"shiftleft(1L, cast(bit % {WORD} AS int))")
    return bits.select(*by, F.floor(F.col("bit") / WORD).cast("bigint").alias("word_no"), mask.alias("word"))


def _united(masks: DataFrame, *by: str) -> DataFrame:
    return masks.groupBy(*by, "word_no").agg(F.bit_or("word").alias("word"))


def build(files: DataFrame, sizes: DataFrame, file: str = "file_no") -> DataFrame:
    """The filters as words of 32 bits, those without a bit left out: ``file``, ``word_no``, ``word``. United before the shuffle."""
    return _united(_hashed(files, sizes, file), file)


def probe(words: DataFrame, sizes: DataFrame, probes: DataFrame, file: str = "file_no") -> DataFrame:
    """Distinct pairs of ``probes`` (file, key) with ``may_contain``: whether all bits of the key are set in the file's filter."""
    wanted = _hashed(probes, sizes, file)
    held = lookup_join(wanted, words.withColumnRenamed("word", "_held"), [file, "word_no"], "left", spread=["key"])
    return held.groupBy(file, "key").agg(F.bool_and(F.coalesce("_held", F.lit(0)).bitwiseAND(F.col("word")) == F.col("word")).alias("may_contain"))


def serialize(words: DataFrame, sizes: DataFrame, file: str = "file_no") -> DataFrame:
    """Each filter as its number of hash functions, a line feed, and its bits as 0 and 1; a filter is bounded by its file."""
    empty = sizes.select(file, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bits") - 1) / WORD))).alias("word_no"), F.lit(0).cast("bigint").alias("word"))
    each = _united(empty.unionByName(words), file).withColumn("word", F.reverse(F.lpad(F.conv(F.col("word").cast("string"), 10, 2), WORD, "0")))
    text = each.groupBy(file).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]), "").alias("_text"))
    return sizes.join(text, file).select(file, F.concat(F.col("hashes").cast("string"), F.lit("\n"), F.substring("_text", F.lit(1), F.col("bits").cast("int"))).alias("data"))


def deserialize(filters: DataFrame, file: str = "file_no") -> DataFrame:
    """The words from the serialised form; a malformed one fails the job."""
    well = F.col("data").rlike(r"^[1-9][0-9]*\n[01]+$")
    checked = filters.where(F.when(F.coalesce(~well, F.lit(True)), F.raise_error(F.lit("malformed filter")).cast("boolean")).otherwise(True))
    bits = checked.select(file, F.posexplode(F.split(F.substring_index("data", "\n", -1), "")).alias("bit", "_on")).where("_on = '1'")
    return _united(_masks(bits, file), file)
