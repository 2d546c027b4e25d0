"""Scans of the text formats (S01-S05, S07, S08, S13, S15-S17, S19, X08 schemas); gzip is read by suffix everywhere."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


def _objects(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType(_fields(T.StringType(), *names)))


#: Schemas of nested entities, raw tweets and lines of the hose.
ENTITIES = T.StructType([T.StructField("user_mentions", _objects("screen_name")), T.StructField("hashtags", _objects("text")), T.StructField("urls", _objects("url", "expanded_url"))])
RAW_TWEET = T.StructType([*_fields(T.StringType(), "_id", "doc_type", "provider_namespace", "username", "screen_name", "text"), T.StructField("entities", ENTITIES)])
HOSE_LINE = T.StructType([*_fields(T.LongType(), "id", "followers_count", "friend_count", "statuses_count"), *_fields(T.StringType(), "text", "screen_name", "lang", "created_at", "timezone", "location", "profile_image_url"), T.StructField("entities", ENTITIES)])


def _text(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    read = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return (read.option("pathGlobFilter", pattern) if pattern else read).text(path)


def _parsed(lines: DataFrame, schema: T.StructType, parse) -> DataFrame:  # noqa: ANN001
    """The columns of lines that parse as a whole; the mark of a bad line is a column of the parser's result."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    made = lines.select(parse(F.col("value"), full).alias("r"))
    return made.where("r is not null and r._corrupt_record is null").select(*[F.col(f"r.`{f.name}`") for f in schema])


def json_lines(spark: SparkSession, path: str, schema: T.StructType = HOSE_LINE, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """One object per line; ``recursive`` walks a tree, ``pattern`` keeps file names such as 'drink-the-hose*'.

    Lines that are no JSON leave.
    """
    return _parsed(_text(spark, path, recursive, pattern), schema, lambda c, s: F.from_json(c, s, {"mode": "PERMISSIVE"}))


def quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A line for each row, no header, quotes are ', doubled inside a field; rows of another width leave."""
    wanted = T.StructType.fromDDL(schema)
    options = {"sep": ",", "quote": "'", "escape": "'", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return _parsed(_text(spark, path), wanted, lambda c, s: F.from_csv(c, s.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options))


def header_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header, columns by name; columns that the file lacks are null."""
    wanted = T.StructType.fromDDL(schema)
    rows = spark.read.options(header=True, encoding="UTF-8").csv(path)
    return rows.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def view_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a view file, for ``operators.labels.parsed_rows``."""
    return spark.read.text(path).select(F.trim("value").alias("value"))


def documents_by_key(docs: DataFrame, key: str, start: str) -> DataFrame:
    """Documents whose key starts with ``start``, one row for each key."""
    return docs.where(F.col(key).startswith(start)).dropDuplicates([key])


def trigram_model(spark: SparkSession, *paths: str) -> DataFrame:
    """(tg, n) of saved models; several files add up."""
    rows = spark.read.schema("tg string, n long").csv(list(paths), sep="\t")
    return rows.groupBy("tg").agg(F.sum("n").alias("n"))


def matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of matrices or weights saved as parquet arrays."""
    return spark.read.parquet(path)


def topic_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, words) of blocks '.I id', '.W', lines of words, and an empty line."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    head = r"(?s)^\s*\.I (\d+)\s*\n\.W\s*\n?(.*)$"
    return blocks.where(F.col("value").rlike(head)).select(F.regexp_extract("value", head, 1).cast("long").alias("doc_id"), F.filter(F.split(F.regexp_extract("value", head, 2), r"\s+"), lambda w: w != "").alias("words"))


def document_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, doc_id) of lines 'topic document 1'."""
    part = F.split("value", " ")
    return spark.read.text(path).where(F.size(part) >= 2).select(part[0].alias("topic"), part[1].try_cast("long").alias("doc_id"))


def npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, values): the rows of the two-dimensional ``.npy`` files under ``path``; pickled and broken ones leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    x = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                except (ValueError, EOFError, OSError):
                    continue
                if x.ndim != 2:
                    continue
                flat, ends = np.ascontiguousarray(x, np.float64).ravel(), np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(np.arange(len(x))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["file", "row", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "file string, row long, values array<double>")
