"""Typed documents: JSON, JSON5 and YAML files below a folder."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.numbering import union_all
from tidelog.session import ship

#: Which parser reads which extension.
JSON_EXTENSIONS = ("json",)
JSON5_EXTENSIONS = ("json5",)
YAML_EXTENSIONS = ("yaml", "yml")
#: The part of JSON5 that the Spark reader knows.
JSON5_OPTIONS = {
    "allowComments": "true",
    "allowSingleQuotes": "true",
    "allowUnquotedFieldNames": "true",
    "allowNumericLeadingZeros": "true",
    "allowNonNumericNumbers": "true",
    "allowUnquotedControlChars": "true",
}
CORRUPT = "_corrupt_record"


def _relative(path: Column, base: str) -> Column:
    """The path below the base folder; the scheme and repeated slashes do not count."""
    plain = F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")
    root = "/" + base.split(":", 1)[-1].strip("/") + "/"
    return F.substring(plain, F.lit(len(root) + 1), F.length(plain))


def _yaml_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import yaml

    for batch in batches:
        texts = []
        for content in batch.column("content"):
            try:
                value = yaml.safe_load(content.as_py())
                texts.append(json.dumps(value, default=str))
            except (yaml.YAMLError, UnicodeDecodeError) as error:
                texts.append("\x00" + str(error))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], ["path", "text"])


def _read_json(
    spark: SparkSession, folder: str, pattern: str, schema: T.StructType, options: dict[str, str]
) -> DataFrame:
    shaped = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(shaped)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .options(**options)
        .json(folder)
        .withColumn("_path", F.col("_metadata.file_path"))
    )


def _read_yaml(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    ship(spark)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "content")
    )
    texts = files.mapInArrow(_yaml_json, "path string, text string")
    shaped = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = texts.select(
        "path",
        F.from_json("text", shaped, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("doc"),
    )
    return parsed.select("doc.*", F.col("path").alias("_path"))


def read_documents(spark: SparkSession, folder: str, mask: str, schema: T.StructType) -> DataFrame:
    """The documents whose path below ``folder`` matches ``mask``, shaped by ``schema``.

    Columns: those of ``schema``, ``rel_path``, ``mask``, and ``_corrupt_record`` with
    the text that could not be read. Unknown keys are ignored, nulls leave a field
    unset. The last part of the mask names the files; ``**`` stands for any folders.
    """
    name = mask.rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1].lower()
    if extension in JSON_EXTENSIONS:
        docs = _read_json(spark, folder, name, schema, {})
    elif extension in JSON5_EXTENSIONS:
        docs = _read_json(spark, folder, name, schema, JSON5_OPTIONS)
    elif extension in YAML_EXTENSIONS:
        docs = _read_yaml(spark, folder, name, schema)
    else:
        raise ValueError(f"no reader for {mask}")
    found = docs.withColumn("rel_path", _relative(F.col("_path"), folder)).drop("_path")
    return found.where(F.rlike("rel_path", F.lit(_mask_pattern(mask)))).withColumn("mask", F.lit(mask))


def _mask_pattern(mask: str) -> str:
    """A file mask as regular expression over the relative path."""
    parts = []
    for part in mask.split("/"):
        if part == "**":
            parts.append("(?:.*/)?")
            continue
        text = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c) for c in part)
        parts.append(text + "/")
    return "^" + "".join(parts).rstrip("/") + "$"


def read_all_documents(
    spark: SparkSession, folder: str, masks: list[str], schema: T.StructType
) -> DataFrame:
    """Documents of several masks; ``mask`` and ``rel_path`` identify each."""
    return union_all([read_documents(spark, folder, mask, schema) for mask in masks])
