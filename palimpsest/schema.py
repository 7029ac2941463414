"""Fixed schemas; nothing is ever inferred."""

from pyspark.sql import types as T

MUTATIONS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

CELLS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("is_tombstone", T.BooleanType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("min_key", T.StringType()),
        T.StructField("max_key", T.StringType()),
    ]
)

REPLICATION_ENTRY = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("operation", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

SNAPSHOT = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
