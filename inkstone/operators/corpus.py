"""Sentences, tokens, TF-IDF, labels: the tables every later operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions import vectors as V
from inkstone.functions.stem import stems

MIN_DF, MAX_DF, MAX_TERMS = 5, 0.85, 50_000
PART = 4 << 20


def spread(docs: DataFrame, always: bool = False) -> DataFrame:
    """Documents dealt to all cores by doc_id, where the input has fewer splits than there are cores, or ``always``.

    Splitting and tokenizing are the expensive part, and a small file is one split.  A large input has splits enough;
    there the exchange pays only where later steps group by document, and then it is the only one: texts move once,
    not their many terms.  A part has ``PART`` bytes of input at most, so that its terms are counted in memory.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < cores * (128 << 20):
        return docs.repartition(max(cores, size // PART), "doc_id")
    return docs.repartition("doc_id") if always else docs


def sentence_lists(docs: DataFrame, cut=T.rule_sentences) -> DataFrame:
    """(doc_id, sents): the sentences of each document that has any."""
    return docs.select("doc_id", cut(F.col("text")).alias("sents")).where(F.size("sents") > 0)


def sentences(docs: DataFrame, cut=T.rule_sentences) -> DataFrame:
    """(doc_id, sent_idx, sent, m); m is the number of sentences of the document."""
    return sentence_lists(docs, cut).select("doc_id", F.size("sents").alias("m"), F.posexplode("sents").alias("sent_idx", "sent"))


def sizes(docs: DataFrame, cut=T.rule_sentences) -> DataFrame:
    """AG1: (doc_id, m), without any exchange."""
    return sentence_lists(docs, cut).select("doc_id", F.size("sents").cast("long").alias("m"))


def position(s: DataFrame) -> DataFrame:
    """Index / number of sentences, without any exchange."""
    return s.select("doc_id", "sent_idx", F.round(F.col("sent_idx") / F.col("m"), 6).alias("pos"))


def terms(s: DataFrame, tokens=T.tokens_b) -> DataFrame:
    """(doc_id, sent_idx, term, tf)."""
    return s.select("doc_id", "sent_idx", F.explode(tokens(F.col("sent"))).alias("term")).groupBy("doc_id", "sent_idx", "term").agg(F.count("*").alias("tf"))


def document_terms(docs: DataFrame, tokens=T.tokens_b) -> DataFrame:
    """(doc_id, term, tf): a sentence ends at white space after a mark, so a document's terms are those of its whole text."""
    return docs.select("doc_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(t: DataFrame, n_docs: int, min_df: int = MIN_DF, max_df: float = MAX_DF, most: int = MAX_TERMS) -> DataFrame:
    """AG21, M13: (term, df, idf) of (doc_id, term, tf) rows, one a document and term; the most frequent terms if there are more than ``most``."""
    v = t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    v = v.orderBy(F.desc("cf"), "term").limit(most)
    return v.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf(t: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, term, w), rows of unit length; ``vocab`` is bounded by its term limit."""
    w = t.join(F.broadcast(vocab), "term").withColumn("raw", (1.0 + F.log("tf")) * F.col("idf"))
    return w.withColumn("w", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id", "sent_idx")))).select("doc_id", "sent_idx", "term", "w")


def tfidf_sum(s: DataFrame, vocab: DataFrame, tokens=T.tokens_b) -> DataFrame:
    """AG9: (doc_id, sent_idx, tfidf), 0 for sentences without terms; sum(w) = sum(raw) / norm, so nothing is joined back."""
    raw = (1.0 + F.log("tf")) * F.col("idf")
    t = s.select("doc_id", "sent_idx", F.explode_outer(tokens(F.col("sent"))).alias("term")).groupBy("doc_id", "sent_idx", "term").agg(F.count("*").alias("tf"))
    w = t.join(F.broadcast(vocab), "term", "left").groupBy("doc_id", "sent_idx").agg((F.sum(raw) / F.sqrt(F.sum(raw * raw))).alias("x"))
    return w.select("doc_id", "sent_idx", F.round(F.coalesce("x", F.lit(0.0)), 6).alias("tfidf"))


def scored_lists(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, sents, tfidf): a document's sentences and their TF-IDF sums, two arrays of one length.

    All steps group by document: with documents dealt by doc_id no row moves again.
    """
    lists = sentence_lists(docs)
    x = tfidf_sum(sentences(docs), vocab).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "tfidf"))).alias("x"))
    return lists.join(x, "doc_id").select("doc_id", "sents", F.transform("x", lambda p: p["tfidf"]).alias("tfidf"))


def labels(src: DataFrame, ref: DataFrame, stemmed: bool = False) -> DataFrame:
    """J5, M10-M12, AG8: (doc_id, sent_idx, y, match_idx, match_text): the best ROUGE-1 F1 over the document's own
    reference sentences; the first of equals; 0, -1 and "" without a common token.

    ``src`` is (doc_id, sent_idx, sent), ``ref`` (doc_id, ref_idx, sent); documents without references have no labels to
    learn from and drop out (J1).  All tokens count.  Tokens are joined within a document, not sentences with each
    other: a pair without a common token has F1 0 and is never made.  With ``stemmed`` tokens agree by stem (ST14);
    each distinct token is stemmed once.
    """
    count = lambda df, *k: df.groupBy(*k, "tok").agg(F.count("*").alias("c"))
    src = src.join(ref.select("doc_id").distinct(), "doc_id", "left_semi")
    a = src.select("doc_id", "sent_idx", F.explode(T.tokens_rouge(F.col("sent"))).alias("tok"))
    b = ref.select("doc_id", "ref_idx", F.explode(T.tokens_rouge(F.col("sent"))).alias("tok"))
    if stemmed:
        known = a.select("tok").union(b.select("tok")).distinct().select("tok", stems(F.col("tok")).alias("stem"))
        a, b = (x.join(known, "tok").drop("tok").withColumnRenamed("stem", "tok") for x in (a, b))
    na, nb = a.groupBy("doc_id", "sent_idx").agg(F.count("*").alias("na")), b.groupBy("doc_id", "ref_idx").agg(F.count("*").alias("nb"))
    hit = count(a, "doc_id", "sent_idx").join(count(b, "doc_id", "ref_idx").withColumnRenamed("c", "c2"), ["doc_id", "tok"])
    hit = hit.groupBy("doc_id", "sent_idx", "ref_idx").agg(F.sum(F.least("c", "c2")).alias("hits")).join(nb, ["doc_id", "ref_idx"]).join(na, ["doc_id", "sent_idx"])
    f1 = 2.0 * F.col("hits") / (F.col("na") + F.col("nb"))
    best = hit.groupBy("doc_id", "sent_idx").agg(F.max(F.struct(f1.alias("f"), (-F.col("ref_idx")).alias("k"))).alias("x"))
    best = best.select("doc_id", "sent_idx", F.col("x.f").alias("f"), (-F.col("x.k")).alias("ref_idx")).join(ref.select("doc_id", "ref_idx", F.col("sent").alias("found")), ["doc_id", "ref_idx"])
    out = src.select("doc_id", "sent_idx").join(best, ["doc_id", "sent_idx"], "left")
    return out.select("doc_id", "sent_idx", F.round(F.coalesce("f", F.lit(0.0)), 6).alias("y"), F.coalesce("ref_idx", F.lit(-1)).alias("match_idx"), F.coalesce("found", F.lit("")).alias("match_text"))


def row_offsets(sizes: DataFrame, bucket: int = 65_536) -> DataFrame:
    """(doc_id, start_idx, end_idx, num_sentences) of documents laid out by doc_id, the end exclusive.

    Sums of runs of ``bucket`` ids are accumulated first, so the one ordered pass over everything has a row a run.
    """
    x = sizes.select("doc_id", F.col("m").cast("long").alias("m"), F.floor(F.col("doc_id") / bucket).alias("run"))
    runs = x.groupBy("run").agg(F.sum("m").alias("all"))
    runs = runs.select("run", (F.sum("all").over(Window.orderBy("run")) - F.col("all")).alias("before"))
    end = F.sum("m").over(Window.partitionBy("run").orderBy("doc_id")) + F.col("before")
    return x.join(runs, "run").select("doc_id", (end - F.col("m")).alias("start_idx"), end.alias("end_idx"), F.col("m").cast("int").alias("num_sentences"))


def sentence_vectors(s: DataFrame, tokens=T.tokens_a, vectors: DataFrame | None = None, dim: int = V.DIM) -> DataFrame:
    """J7, AG10: (doc_id, sent_idx, vec): the mean vector of a sentence's words.

    ``vectors`` is a (word, vec) table (IO7); words that it lacks drop out, and sentences without a known word.  Without
    it a word's hash stands in, which is a function of the word and needs no join.
    """
    tok = s.select("doc_id", "sent_idx", F.explode(tokens(F.col("sent"))).alias("word"))
    tok = tok.select("doc_id", "sent_idx", V.hash_vector(F.col("word")).alias("vec")) if vectors is None else tok.join(vectors.select("word", "vec"), "word")
    dims = [F.avg(F.col("vec")[i].cast("double")).alias(f"v{i}") for i in range(dim)]
    return tok.groupBy("doc_id", "sent_idx").agg(*dims).select("doc_id", "sent_idx", F.array(*[f"v{i}" for i in range(dim)]).alias("vec"))


def centroid_cosine(vectors: DataFrame, key: str, item: str, vec: str, dim: int, normalize: bool = False) -> DataFrame:
    """M3/M4: cosine of each vector with the mean of its key's; ``normalize`` takes unit vectors for the mean."""
    v = V.unit(F.col(vec)) if normalize else F.col(vec)
    x = vectors.select(key, item, F.col(vec).alias("v"), v.alias("u"))
    mean = x.groupBy(key).agg(*[F.avg(F.col("u")[i].cast("double")).alias(f"m{i}") for i in range(dim)]).select(key, F.array(*[f"m{i}" for i in range(dim)]).alias("mean"))
    return x.join(mean, key).select(key, item, F.round(V.cosine(F.col("v"), F.col("mean")), 6).alias("cos"))
