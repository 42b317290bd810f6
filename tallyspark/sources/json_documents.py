"""Nested documents in JSON files: written, read back by a schema, with those that don't parse told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.functions.text import is_json

#: The parts of a processed document, and the names that it could not process.
PARTS_SCHEMA = "parts array<struct<kind:string,text:string>>, submitted_but_not_processed_files array<string>"


def write_documents(rows: DataFrame, path: str, by: str, most: int = 10_000) -> None:
    """Each row as one line of JSON, in a folder for each value of `by` and files of `most` rows: a nested document is a
    row, so that no document is gathered beyond what the rows hold."""
    fields = F.struct(*[c for c in rows.columns if c != by])
    rows.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"), by).write.partitionBy(by).option("maxRecordsPerFile", most).text(path)


def read_texts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """file, text of each file below a path, or of each line of them, and the columns that folders stand for."""
    rows = spark.read.text(path, wholetext=whole)
    return rows.withColumnRenamed("value", "text").withColumn("file", F.input_file_name())


def parsed(texts: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """The rows with the schema's fields in place of the text, and `problem`: null, `empty`, `not JSON`, or `not of the
    schema` where a value has another type; fields that the schema doesn't name are left out, missing ones are null. Of a
    row with a problem all fields are null."""
    fields = StructType.fromDDL(schema)
    held = F.from_json(text, f"{schema}, _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    rows = texts.withColumn("_held", held).withColumn("_object", is_json(F.coalesce(text, F.lit(""))) & F.ltrim(F.regexp_replace(text, r"^\s+", "")).startswith("{"))
    problem = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(~F.coalesce("_object", F.lit(False)), "not JSON").when(F.col("_held._damaged").isNotNull(), "not of the schema")
    rows = rows.withColumn("problem", problem)
    kept = [c for c in texts.columns if c != text]
    return rows.select(*kept, *[F.when(F.col("problem").isNull(), F.col("_held")[f.name]).alias(f.name) for f in fields], "problem")


def parts_of(metas: DataFrame, payloads: DataFrame) -> DataFrame:
    """source_key, name, ord, kind, text: the parts of each document (source_key, name, file), in order. Payloads are rows
    of PARTS_SCHEMA by file, with their problem."""
    held = metas.join(payloads.filter("problem IS NULL"), "file")
    return held.select("source_key", "name", F.posexplode("parts").alias("ord", "_part")).select("source_key", "name", "ord", "_part.kind", "_part.text")


def not_processed(metas: DataFrame, payloads: DataFrame) -> DataFrame:
    """source_key, names: what a source's documents could not process: the names that a payload tells, and the documents
    whose payload is missing or has a problem. Documents that were never processed (no file) are left out."""
    rows = metas.filter("file IS NOT NULL").join(payloads.select("file", "problem", "parts", F.col("submitted_but_not_processed_files").alias("_told"), F.lit(True).alias("_there")), "file", "left")
    told = F.filter(F.coalesce("_told", F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    failed = F.col("_there").isNull() | F.col("problem").isNotNull()
    names = F.when(failed, F.array("name")).otherwise(told)
    return rows.select("source_key", F.explode(names).alias("_name")).groupBy("source_key").agg(F.sort_array(F.collect_set("_name")).alias("names"))


