"""Sources with bad rows set aside instead of dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV manifest, all strings, trimmed; nulls are empty."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in columns))


def headed_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, retrieved, text, ok) of texts that open with SOURCE: and RETRIEVED: lines."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    form = r"(?s)^SOURCE: ([^\n]*)\nRETRIEVED: ([^\n]*)\n(.*)$"
    part = lambda i: F.regexp_extract("value", form, i)
    return raw.select("path", part(1).alias("source"), F.expr(r"try_to_timestamp(regexp_extract(value, '(?s)^SOURCE: [^\\n]*\\nRETRIEVED: ([^\\n]*)', 1))").alias("retrieved"), part(3).alias("text"), F.col("value").rlike(form).alias("ok"))


def json_records(lines: DataFrame, column: str) -> DataFrame:
    """lines with record (variant, null if the text is no JSON object) and usable."""
    parsed = F.expr(f"try_parse_json({column})")
    return lines.withColumn("usable", F.coalesce(F.expr(f"schema_of_variant(try_parse_json({column})) like 'OBJECT%'"), F.lit(False))).withColumn("record", F.when(F.col("usable"), parsed))
