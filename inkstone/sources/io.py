"""Readers and writers: text folders, id lists, sentence caches, feature tables, reports."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators.corpus import row_offsets


def read_texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(doc_id, name): each .txt file is one value; bad UTF-8 becomes replacement characters; the id is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return files.select(F.url_decode(F.regexp_replace(stem, r"\+", "%2B")).alias("doc_id"), F.expr("try_validate_utf8(cast(content as string))").alias("ok"), "content").select("doc_id", F.coalesce("ok", F.expr("make_valid_utf8(cast(content as string))")).alias(name))


def read_pairs(spark: SparkSession, judgments: str, headnotes: str) -> DataFrame:
    """IO1/IO2: documents that have both; a missing folder raises."""
    return read_texts(spark, judgments, "judgment").join(read_texts(spark, headnotes, "headnote"), "doc_id")


def id_order(c: str = "doc_id") -> list[Column]:
    """TK1: numbers by value, then the rest by text."""
    return [F.expr(f"try_cast({c} as bigint)").asc_nulls_last(), F.col(c).asc()]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """IO4: stripped lines, blank ones dropped."""
    return spark.read.text(path).select(F.trim("value").alias("doc_id")).where("doc_id <> ''")


def read_split(docs: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """IO3, J2, J10: documents of a split, ids compared as text; with ``limit`` the first by id."""
    ids = ids if limit is None else ids.orderBy(*id_order()).limit(limit)
    wanted = ids.select(F.col("doc_id").cast("string").alias("_id")).distinct()
    return docs.join(wanted, F.col("doc_id").cast("string") == F.col("_id"), "left_semi")


def read_sentence_cache(spark: SparkSession, path: str) -> DataFrame:
    """IO5: (doc_id, sent_idx, sent) of a (gzip) JSON map from id to strings or to {text} / {sentence}."""
    raw = spark.read.text(path, wholetext=True)
    docs = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("doc_id", "items"))
    item = F.coalesce(F.get_json_object("item", "$.text"), F.get_json_object("item", "$.sentence"), F.col("item"))
    return docs.select("doc_id", F.posexplode("items").alias("sent_idx", "item")).select("doc_id", "sent_idx", item.alias("sent"))


def write_features(raw: DataFrame, scaled: DataFrame, params: DataFrame, path: str, config: str) -> None:
    """IO10: raw and scaled rows, partitioned by configuration, and the scaling parameters beside them.

    The key (doc_id, sent_idx) stands in every row, so no index file ties rows to keys by place.
    """
    for name, df in (("raw", raw), ("scaled", scaled), ("params", params)):
        df.withColumn("config", F.lit(config)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config").parquet(f"{path}/{name}")


def read_features(spark: SparkSession, path: str, config: str, name: str = "raw") -> DataFrame:
    """IO6: what ``write_features`` wrote of one configuration; other configurations are not read."""
    return spark.read.parquet(f"{path}/{name}").where(F.col("config") == config).drop("config")


def write_labels(labels: DataFrame, stats: DataFrame, path: str) -> None:
    """IO11: labels, their one row of statistics, and where each document begins and ends in them."""
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    row_offsets(labels.groupBy("doc_id").agg(F.count("*").alias("m"))).write.mode("overwrite").parquet(f"{path}/boundaries")


def saved_vocabulary(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """IO12: the vocabulary at ``path``; made and written if it is not there."""
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(file):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """IO7: (word, vec) from Parquet; a word given twice keeps its least vector.  A missing table raises."""
    return spark.read.parquet(path).groupBy("word").agg(F.min("vec").alias("vec"))


def lemmatized(words: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """ST13: (word, ...) with each word replaced by its lemma from a (word, lemma) table; without one, or where it has none, the word."""
    if lemmas is None:
        return words
    of = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma"))
    return words.join(of, "word", "left").withColumn("word", F.coalesce("lemma", "word")).drop("lemma")


def encoded(sentences: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 128, unit: bool = False) -> DataFrame:
    """IO9, M5: (doc_id, sent_idx, vec) by a sentence encoder.

    ``load`` makes the model, once a worker and task; the model maps a list of up to ``batch`` sentences to vectors.
    ``unit`` scales them to length 1.  No rows, no vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = [[float(x) for x in vec] for vec in model(part.column(2).to_pylist())]
                if unit:
                    v = [[x / n for x in vec] if (n := math.sqrt(sum(x * x for x in vec))) else vec for vec in v]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(v, pa.list_(pa.float64()))], ["doc_id", "sent_idx", "vec"])

    s = sentences.select("doc_id", F.col("sent_idx").cast("int").alias("sent_idx"), "sent")
    return s.mapInArrow(run, f"doc_id {dict(s.dtypes)['doc_id']}, sent_idx int, vec array<double>")


def tagged(docs: DataFrame, load: Callable[[], Callable[[str], list[tuple[str, str]]]] | None = None) -> DataFrame:
    """ST15, ST16: (doc_id, text, label) of entities by a tagger, made once a worker and task; without one by rule."""
    if load is None:
        return docs.select("doc_id", F.explode(T.entities_proxy(F.col("text"))).alias("e")).select("doc_id", "e.text", "e.label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = load()
        for b in batches:
            rows = [(d, x, y) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and t.strip() for x, y in tag(t)]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "text", "label"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, label string")


def tagger_name(load=None) -> str:
    """ST17: which tagger is at work."""
    return "rule" if load is None else getattr(load, "__name__", type(load).__name__)


def write_ids(ids: DataFrame, path: str, about: dict | None = None) -> None:
    """IO13: one id a line, in order, and, if given, a line of JSON about the split beside them."""
    ids.orderBy(*id_order()).select(F.col("doc_id").cast("string")).write.mode("overwrite").text(path)
    if about is not None:
        ids.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".about")


def write_report(df: DataFrame, path: str, title: str, most: int = 1_000) -> str:
    """IO14: a summary as JSON lines at ``path``, and as a Markdown table in return.  A table of over ``most`` rows is no summary and raises."""
    df.write.mode("overwrite").json(path)
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    head = df.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(json.dumps(r[c], default=str) if not isinstance(r[c], str) else r[c] for c in head) + " |" for r in rows])
