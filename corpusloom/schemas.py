"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

FILE = T.StructType(
    [
        T.StructField("relative_path", T.StringType(), False),
        T.StructField("content", T.BinaryType()),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("size", T.LongType()),
    ]
)
SNAPSHOT = T.StructType([T.StructField("relative_path", T.StringType(), False), T.StructField("mtime_ns", T.LongType())])
CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("scope", T.StringType(), False),
        T.StructField("relative_path", T.StringType(), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("chunk_type", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("source_mtime", T.DoubleType()),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("symbol_path", T.StringType()),
        T.StructField("heading_path", T.StringType()),
        T.StructField("domain_tags", T.ArrayType(T.StringType()), False),
        T.StructField("is_generated", T.BooleanType(), False),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("embedding_backend", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("index_schema_version", T.IntegerType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)
QUERY = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("query", T.StringType(), False),
        T.StructField("expected_any", T.ArrayType(T.StringType())),
    ]
)
RESULT_COLUMNS = ["chunk_id", "scope", "relative_path", "language", "chunk_type", "snippet", "start_line", "end_line", "symbol_path", "heading_path", "domain_tags", "score", "dense_score", "lexical_score"]
READ_COLUMNS = ["chunk_id", "scope", "relative_path", "language", "chunk_type", "text", "start_line", "end_line", "symbol_path", "heading_path", "domain_tags"]
