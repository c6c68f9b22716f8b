"""Explicit schemas of the analysis record (never inferred)."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampNTZType)

POSITION = StructType([
    StructField("start_line", IntegerType()),
    StructField("start_column", IntegerType()),
    StructField("end_line", IntegerType()),
    StructField("end_column", IntegerType()),
])

FUNCTION = StructType([
    StructField("name", StringType()),
    StructField("position", POSITION),
    StructField("parameters", ArrayType(StringType())),
    StructField("complexity", IntegerType()),
    StructField("body_text", StringType()),
])

CLASS = StructType([
    StructField("name", StringType()),
    StructField("position", POSITION),
    StructField("methods", ArrayType(FUNCTION)),
    StructField("complexity", IntegerType()),
    StructField("body_text", StringType()),
])

FIELD = StructType([
    StructField("name", StringType()),
    StructField("type", StringType()),
    StructField("tag", StringType()),
])

STRUCT = StructType([
    StructField("name", StringType()),
    StructField("position", POSITION),
    StructField("fields", ArrayType(FIELD)),
    StructField("body_text", StringType()),
])

IMPORT = StructType([
    StructField("text", StringType()),
    StructField("position", POSITION),
    StructField("type", StringType()),
])

METRICS = StructType([
    StructField("total_lines", IntegerType()),
    StructField("code_lines", IntegerType()),
    StructField("comment_lines", IntegerType()),
    StructField("blank_lines", IntegerType()),
    StructField("average_complexity", DoubleType()),
])

# Whole-definition line span of a function (0-based, inclusive).
SPAN = StructType([
    StructField("name", StringType()),
    StructField("start_line", IntegerType()),
    StructField("end_line", IntegerType()),
])

ANALYSIS = StructType([
    StructField("file_path", StringType()),
    StructField("language", StringType()),
    StructField("functions", ArrayType(FUNCTION)),
    StructField("classes", ArrayType(CLASS)),
    StructField("structs", ArrayType(STRUCT)),
    StructField("imports", ArrayType(IMPORT)),
    StructField("metrics", METRICS),
    StructField("has_errors", BooleanType()),
    StructField("parser_used", StringType()),
    StructField("error", StringType()),
])

FILES = StructType([
    StructField("file_path", StringType()),
    StructField("language", StringType()),
    StructField("content", StringType()),
    StructField("created_at", TimestampNTZType()),
])

VECTORS = StructType([
    StructField("id", LongType()),
    StructField("embedding", ArrayType(FloatType())),
    StructField("label", IntegerType()),
])

ALERT = StructType([
    StructField("alert_id", StringType()),
    StructField("alert_type", StringType()),
    StructField("alert_message", StringType()),
    StructField("file_path", StringType()),
    StructField("line_number", IntegerType()),
    StructField("severity", StringType()),
    StructField("created_at", TimestampNTZType()),
])
