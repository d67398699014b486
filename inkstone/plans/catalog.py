"""All queries of the summarization engine by name, each with its SQL twin where SQL has one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions import transport as X
from inkstone.functions import vectors as V
from inkstone.operators import corpus as C
from inkstone.operators import evaluation as E
from inkstone.operators import scoring as G
from inkstone.operators import selection as S
from inkstone.operators import wmd as W
from inkstone.sources import io

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str, by_document: bool = False) -> DataFrame:
    return C.spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), by_document)


def _count(spark, d) -> int:
    return spark.read.parquet(f"{d}/documents.parquet").count()


def _sents(spark, d) -> DataFrame:
    return C.sentences(_docs(spark, d))


def _vocab(spark, d) -> DataFrame:
    return C.vocabulary(C.document_terms(_docs(spark, d, True)), _count(spark, d))


def _lists(spark, d) -> DataFrame:
    """(doc_id, sents, tfidf): arrays, a row a document."""
    return C.scored_lists(_docs(spark, d, True), _vocab(spark, d))


def _scores(spark, d) -> DataFrame:
    """(doc_id, sent_idx, sent, tfidf, pos, score, m): the deterministic score behind selection queries."""
    x = _lists(spark, d).select("doc_id", F.size("sents").alias("m"), F.posexplode(F.arrays_zip("sents", "tfidf")).alias("sent_idx", "x"))
    x = x.select("doc_id", "sent_idx", F.col("x.sents").alias("sent"), F.col("x.tfidf").alias("tfidf"), "m")
    return x.withColumn("pos", F.round(F.col("sent_idx") / F.col("m"), 6)).withColumn("score", G.linear_proxy())


def _references(spark, d) -> DataFrame:
    """(doc_id, ref_idx, sent): the reference texts, each that of the document of its id."""
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return C.sentences(b).select("doc_id", F.col("sent_idx").alias("ref_idx"), "sent")


def _labels(spark, d, stemmed: bool = False) -> DataFrame:
    return C.labels(_sents(spark, d), _references(spark, d), stemmed)


# ---- SQL building blocks -------------------------------------------------
_STOP = "(" + ", ".join("'" + w + "'" for w in T.STOPWORDS) + ")"
_CLEAN = r"regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g')"
_SPLIT = rf"list_filter(list_transform(string_split(regexp_replace({_CLEAN}, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: length(x) > 0)"
_S = f"s AS (SELECT doc_id, unnest(range(len(p)))::INT AS sent_idx, unnest(p) AS sent FROM (SELECT doc_id, {_SPLIT} AS p FROM documents))"
_TOK = r"list_filter(regexp_split_to_array(lower(sent), '[^\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z]{2,}$') AND x NOT IN " + _STOP + ")"
_TOKA = r"list_filter(regexp_split_to_array(lower(sent), '[^\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[\p{L}\p{N}]+$') AND x NOT IN " + _STOP + ")"
_T = f"t AS (SELECT doc_id, sent_idx, term, count(*) AS tf FROM (SELECT doc_id, sent_idx, unnest({_TOK}) AS term FROM s) GROUP BY ALL)"
_N = "n AS (SELECT count(*) AS n FROM documents)"
_VOC = "v AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df, sum(tf) AS cf FROM t GROUP BY term), n WHERE df >= 5 AND df <= 0.85 * n ORDER BY cf DESC, term LIMIT 50000)"
_TS = "ts AS (SELECT s.doc_id, s.sent_idx, s.sent, round(coalesce(x, 0), 6) AS tfidf FROM s LEFT JOIN (SELECT doc_id, sent_idx, sum((1 + ln(tf)) * idf) / sqrt(sum(((1 + ln(tf)) * idf) ** 2)) AS x FROM t JOIN v USING (term) GROUP BY ALL) w USING (doc_id, sent_idx))"
_SC = "sc AS (SELECT *, round(tfidf - 0.5 * pos, 7) AS score FROM (SELECT *, round(sent_idx / count(*) OVER (PARTITION BY doc_id), 6) AS pos, count(*) OVER (PARTITION BY doc_id) AS m FROM ts))"
_BUD = "greatest(3, round_even(0.05::DOUBLE * m, 0)::INT)"
_RK = f"rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_idx DESC) AS rn, {_BUD} AS k FROM sc)"
_BASE = f"WITH {_S}"
_SCORED = f"WITH {_S}, {_T}, {_N}, {_VOC}, {_TS}, {_SC}, {_RK}"
_ROUGE_TOK = "list_filter(regexp_split_to_array(lower(sent), '[^a-z0-9]+'), lambda x: length(x) > 0)"


def _rouge(tok: str = "tok") -> str:
    """Labels from the definition: F1 of clipped unigram counts over all tokens, within a document; ``tok`` may map a token."""
    return rf"""sr AS (SELECT * FROM s WHERE doc_id IN (SELECT item_id FROM benchmark WHERE len({_SPLIT}) > 0)),
rs AS (SELECT doc_id, unnest(range(len(p)))::INT AS ref_idx, unnest(p) AS sent FROM (SELECT item_id AS doc_id, {_SPLIT} AS p FROM benchmark)),
a AS (SELECT doc_id, sent_idx, {tok} AS tok FROM (SELECT doc_id, sent_idx, unnest({_ROUGE_TOK}) AS tok FROM sr)),
b AS (SELECT doc_id, ref_idx, {tok} AS tok FROM (SELECT doc_id, ref_idx, unnest({_ROUGE_TOK}) AS tok FROM rs)),
ca AS (SELECT doc_id, sent_idx, tok, count(*) AS c FROM a GROUP BY ALL), cb AS (SELECT doc_id, ref_idx, tok, count(*) AS c FROM b GROUP BY ALL),
na AS (SELECT doc_id, sent_idx, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT doc_id, ref_idx, count(*) AS n FROM b GROUP BY ALL),
h AS (SELECT doc_id, sent_idx, ref_idx, sum(least(ca.c, cb.c)) AS hits FROM ca JOIN cb USING (doc_id, tok) GROUP BY ALL),
pr AS (SELECT h.doc_id, h.sent_idx, h.ref_idx, hits::DOUBLE / na.n AS p, hits::DOUBLE / nb.n AS r FROM h JOIN nb USING (doc_id, ref_idx) JOIN na USING (doc_id, sent_idx)),
f AS (SELECT doc_id, sent_idx, ref_idx, round(2 * p * r / (p + r), 12) AS f1 FROM pr),
y AS (SELECT sr.doc_id, sr.sent_idx, round(coalesce(f1, 0), 6) AS y, coalesce(q.ref_idx, -1)::INT AS match_idx, coalesce(rs.sent, '') AS match_text FROM sr
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY f1 DESC, ref_idx) AS rk FROM f) q ON sr.doc_id = q.doc_id AND sr.sent_idx = q.sent_idx AND q.rk = 1
LEFT JOIN rs ON rs.doc_id = q.doc_id AND rs.ref_idx = q.ref_idx)"""


_ROUGE = _rouge()


# ---- sentences, tokens, text ---------------------------------------------
@query(f"{_BASE} SELECT doc_id, sent_idx, length(sent)::INT AS n_chars FROM s")
def sentences(spark, d):
    return _sents(spark, d).select("doc_id", "sent_idx", F.length("sent").alias("n_chars"))


@query(f"{_BASE} SELECT doc_id, sent_idx, round(sent_idx / count(*) OVER (PARTITION BY doc_id), 6) AS pos FROM s")
def position(spark, d):
    return C.position(_sents(spark, d))


def _tokens(tok):
    def run(spark, d):
        x = _docs(spark, d).withColumn("toks", tok(F.coalesce("text", F.lit(""))))
        return x.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.size(F.array_distinct("toks")).cast("long").alias("n_distinct"))

    return run


for _name, _f, _q in (("tokens_a", T.tokens_a, _TOKA), ("tokens_b", T.tokens_b, _TOK)):
    QUERIES[_name] = _tokens(_f)
    SQL[_name] = f"SELECT doc_id, len(x)::BIGINT AS n_tokens, len(list_distinct(x))::BIGINT AS n_distinct FROM (SELECT doc_id, {_q.replace('sent', 'coalesce(text, chr(32))')} AS x FROM documents)"


@query(r"""SELECT doc_id, ((length(p) - length(replace(p, '<PERIOD>', ''))) / 8)::BIGINT AS n_placeholders, length(replace(p, '<PERIOD>', '.'))::BIGINT AS n_restored
FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\b(\d{1,2}(?:/\d{1,2})?)\.(\d{1,2})\.\s*(\d{2,4})\b', '\1<PERIOD>\2<PERIOD>\3', 'g'), '([0-9]+)\.([0-9]+)', '\1<PERIOD>\2', 'g') AS p FROM documents)""")
def protect_dates_decimals(spark, d):
    p = T.protect_decimals(T.protect_dates(F.coalesce("text", F.lit(""))))
    x = _docs(spark, d).withColumn("p", p)
    return x.select("doc_id", ((F.length("p") - F.length(F.replace("p", F.lit(T.DOT), F.lit("")))) / 8).cast("long").alias("n_placeholders"), F.length(T.restore(F.col("p"))).cast("long").alias("n_restored"))


@query()
def legal_sentences(spark, d):
    """ST8/ST9: look-ahead, which the SQL engine's patterns lack."""
    x = _docs(spark, d).withColumn("p", T.legal_sentences(F.col("text")))
    return x.select("doc_id", F.size("p").cast("long").alias("m"), F.md5(F.array_join("p", "\n")).alias("digest"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f]+'), lambda x: length(x) > 0))::BIGINT AS n_words FROM documents")
def word_count(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count(F.coalesce("text", F.lit(""))).cast("long").alias("n_words"))


@query(r"""SELECT doc_id, CASE WHEN length(x) > 110 THEN left(x, 107) || '...' ELSE x END AS short FROM (
SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'), '[\r\n]', ' ', 'g') AS x FROM documents)""")
def ellipsis(spark, d):
    return _docs(spark, d).select("doc_id", T.ellipsis(F.coalesce("text", F.lit(""))).alias("short"))


@query(f"{_BASE} SELECT doc_id, sent_idx, len(regexp_extract_all(sent, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*'))::BIGINT AS ner_proxy FROM s")
def ner_proxy(spark, d):
    return _sents(spark, d).select("doc_id", "sent_idx", T.ner_proxy(F.col("sent")).cast("long").alias("ner_proxy"))


@query("SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS text, 'PROXY' AS label FROM documents")
def entities_proxy(spark, d):
    return io.tagged(_docs(spark, d))


@query(rf"""SELECT doc_id, f <> '' AND f NOT IN ('in', 'the', 'this', 'an', 'cross', 'first', 'second', 'leave') AS truncated,
regexp_matches(left(t, 3000), '[^\p{{L}}\p{{N}}_ \t\n\r\f.,;:?!''"]{{3,}}') AS symbols, regexp_matches(left(t, 3000), '(?:^|\n)[ \t\n\r\f]*(?:[a-zA-Z][ \t\n\r\f]+){{4,}}[a-zA-Z]') AS spaced
FROM (SELECT doc_id, coalesce(text, '') AS t, lower(regexp_extract(left(coalesce(text, ''), 3000), '(?:^|\n)[ \t\n\r\f]*([a-z]{{1,5}})[ \t\n\r\f]+(?:{'|'.join(T.OCR_NOUNS)})\b', 1)) AS f FROM documents)""")
def ocr_regex(spark, d):
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select("doc_id", T.ocr_truncated(t).alias("truncated"), T.ocr_symbols(t).alias("symbols"), T.ocr_spaced(t).alias("spaced"))


@query("SELECT doc_id, " + " OR ".join(f"contains(coalesce(text, ''), '{m}')" for m in T.OCR_MARKERS) + " AS marked FROM documents")
def ocr_marker(spark, d):
    return _docs(spark, d).select("doc_id", T.ocr_marker(F.coalesce("text", F.lit(""))).alias("marked"))


# ---- audits ----------------------------------------------------------------
@query(f"{_BASE}, m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY 1) SELECT CASE WHEN m < 20 THEN 'short' WHEN m <= 500 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n_docs, sum(m)::BIGINT AS n_sents, min(m) AS least, max(m) AS most, round(avg(m), 6) AS mean, sum(CASE WHEN m < 20 OR m > 500 THEN 1 ELSE 0 END)::BIGINT AS flagged FROM m GROUP BY 1")
def doc_audit(spark, d):
    m = C.sizes(_docs(spark, d))
    return m.groupBy(T.length_bucket(F.col("m")).alias("bucket")).agg(F.count("*").alias("n_docs"), F.sum("m").alias("n_sents"), F.min("m").alias("least"), F.max("m").alias("most"), F.round(F.avg("m"), 6).alias("mean"), F.sum((T.audit_flag(F.col("m")) != "ok").cast("long")).alias("flagged"))


@query(f"{_BASE}, m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY 1), o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM m) SELECT " + ", ".join(f"max(m) FILTER (i = floor(n * {p})) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM o")
def length_percentiles(spark, d):
    return E.floor_percentiles(C.sizes(_docs(spark, d)), "m", [0.25, 0.5, 0.75, 0.95, 0.99])


@query(f"{_BASE} SELECT doc_id, count(*) AS m FROM s GROUP BY 1 ORDER BY m DESC, doc_id LIMIT 10")
def longest_docs(spark, d):
    return C.sizes(_docs(spark, d)).orderBy(F.desc("m"), "doc_id").limit(10)


@query(f"{_BASE} SELECT doc_id, sent_idx, left(sent, 150) || ' ... ' || right(sent, 80) AS snippet FROM s WHERE length(sent) > 500 ORDER BY doc_id, sent_idx LIMIT 100")
def long_sentences(spark, d):
    s = _sents(spark, d).where(F.length("sent") > 500).orderBy("doc_id", "sent_idx").limit(100)
    return s.select("doc_id", "sent_idx", T.snippet(F.col("sent")).alias("snippet"))


@query(f"""{_BASE}, m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY 1)
SELECT * FROM (SELECT 'short' AS pick, doc_id, m FROM m WHERE m < 20 ORDER BY m, doc_id LIMIT 1) UNION ALL
SELECT * FROM (SELECT 'medium', doc_id, m FROM m WHERE m BETWEEN 70 AND 110 ORDER BY abs(m - 83), doc_id LIMIT 1) UNION ALL
SELECT * FROM (SELECT 'long', doc_id, m FROM m WHERE m > 500 ORDER BY m DESC, doc_id LIMIT 1)""")
def example_picks(spark, d):
    m = C.sizes(_docs(spark, d))
    pick = lambda name, cond, *by: m.where(cond).orderBy(*by, "doc_id").limit(1).select(F.lit(name).alias("pick"), "doc_id", "m")
    return pick("short", "m < 20", "m").union(pick("medium", "m between 70 and 110", F.abs(F.col("m") - 83))).union(pick("long", "m > 500", F.desc("m")))


@query("SELECT CASE WHEN o THEN 'marked' ELSE 'plain' END AS grp, count(*) AS n, sum(z)::BIGINT AS oov, round(100.0::DOUBLE * sum(z) / count(*), 6) AS pct FROM (" + f"""{_BASE}, {_T}, {_N}, {_VOC}, k AS (SELECT DISTINCT doc_id, sent_idx FROM t JOIN v USING (term)),
o AS (SELECT doc_id, {" OR ".join(f"contains(coalesce(text, ''), '{m}')" for m in T.OCR_MARKERS)} AS o FROM documents)
SELECT o.o, CASE WHEN k.doc_id IS NULL THEN 1 ELSE 0 END AS z FROM s JOIN o USING (doc_id) LEFT JOIN k ON s.doc_id = k.doc_id AND s.sent_idx = k.sent_idx) GROUP BY 1""")
def oov_rate(spark, d):
    mark = F.when(T.ocr_marker(F.coalesce("text", F.lit(""))), "marked").otherwise("plain").alias("grp")
    docs = _docs(spark, d, True).select("doc_id", T.rule_sentences(F.col("text")).alias("sents"), mark)
    tok = docs.select("doc_id", "grp", F.posexplode("sents").alias("sent_idx", "sent")).select("doc_id", "grp", "sent_idx", F.explode_outer(T.tokens_b(F.col("sent"))).alias("term"))
    known = tok.join(F.broadcast(_vocab(spark, d).select("term", F.lit(1).alias("k"))), "term", "left")
    x = known.groupBy("doc_id", "sent_idx", "grp").agg(F.max("k").alias("k"))
    z = F.col("k").isNull().cast("long")
    return x.groupBy("grp").agg(F.count("*").alias("n"), F.sum(z).alias("oov"), F.round(100.0 * F.sum(z) / F.count("*"), 6).alias("pct"))


# ---- features ----------------------------------------------------------------
@query(f"{_BASE}, {_T}, {_N}, {_VOC} SELECT term, df, round(idf, 6) AS idf FROM v")
def vocab_df(spark, d):
    return _vocab(spark, d).withColumn("idf", F.round("idf", 6))


@query(f"{_BASE}, {_T}, {_N}, {_VOC}, {_TS} SELECT doc_id, sent_idx, tfidf FROM ts")
def tfidf_sum(spark, d):
    return C.tfidf_sum(C.sentences(_docs(spark, d, True)), _vocab(spark, d))


@query(f"""{_BASE}, {_T}, {_N}, {_VOC}, dt AS (SELECT doc_id, term, sum(tf) AS tf FROM t GROUP BY ALL),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM dt JOIN v USING (term)), u AS (SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 4) AS w FROM w)
SELECT doc_id, rank, term, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank FROM u) WHERE rank <= 10""")
def top_terms(spark, d):
    doc = C.document_terms(_docs(spark, d, True)).withColumn("sent_idx", F.lit(0))
    w = C.tfidf(doc, _vocab(spark, d)).withColumn("w", F.round("w", 4))
    by = S.Window.partitionBy("doc_id").orderBy(F.desc("w"), "term")
    return w.withColumn("rank", F.row_number().over(by)).where("rank <= 10").select("doc_id", "rank", "term", "w")


_HV = "[" + ", ".join(f"('0x' || substr(md5(word), {4 * i + 1}, 4))::INT / 32767.5 - 1.0" for i in range(8)) + "]::DOUBLE[]"
_WV = f"wt AS (SELECT doc_id, sent_idx, word, {_HV} AS v FROM (SELECT doc_id, sent_idx, unnest({_TOKA}) AS word FROM s)), sv AS (SELECT doc_id, sent_idx, [" + ", ".join(f"avg(v[{i}])" for i in range(1, 9)) + "] AS v FROM wt GROUP BY ALL)"


@query(f"{_BASE}, {_WV}, c AS (SELECT doc_id, [" + ", ".join(f"avg(v[{i}])" for i in range(1, 9)) + "] AS c FROM sv GROUP BY 1) SELECT doc_id, sent_idx, round(coalesce(list_cosine_similarity(v, c), 0), 6) AS cos FROM sv JOIN c USING (doc_id)")
def w2v_sentence_cosine(spark, d):
    return C.centroid_cosine(C.sentence_vectors(C.sentences(_docs(spark, d, True))), "doc_id", "sent_idx", "vec", V.DIM)


def _emb(normalize: bool) -> str:
    part = "embedding[{i}] / sqrt(list_dot_product(embedding, embedding))" if normalize else "embedding[{i}]"
    mean = ", ".join("avg(" + part.format(i=i) + ")" for i in range(1, 65))
    return f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings), c AS (SELECT label, [{mean}] AS c FROM e GROUP BY 1) SELECT label, vec_id, round(list_cosine_similarity(embedding, c), 6) AS cos FROM e JOIN c USING (label)"


@query(_emb(False))
def centroid_cosine(spark, d):
    return C.centroid_cosine(spark.read.parquet(f"{d}/embeddings.parquet"), "label", "vec_id", "embedding", 64)


@query(_emb(True))
def centroid_cosine_unit(spark, d):
    return C.centroid_cosine(spark.read.parquet(f"{d}/embeddings.parquet"), "label", "vec_id", "embedding", 64, normalize=True)


# ---- labels ------------------------------------------------------------------
@query(f"{_BASE}, {_ROUGE} SELECT * FROM y")
def rouge_label(spark, d):
    return _labels(spark, d)


@query(f"{_BASE}, {_ROUGE} SELECT count(*) AS n, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, min(y) AS least, round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.75), 6) AS p75, round(quantile_cont(y, 0.9), 6) AS p90, max(y) AS most FROM y")
def label_stats(spark, d):
    q = lambda p: F.round(F.expr(f"percentile(y, {p})"), 6)
    x = _labels(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.stddev_pop("y"), 6).alias("std"), F.min("y").alias("least"), q(0.5).alias("median"), q(0.75).alias("p75"), q(0.9).alias("p90"), F.max("y").alias("most"))
    return x.fillna(0.0, ["mean", "std", "least", "median", "most"])  # AG7: zeros without rows, but no percentiles


# ---- selection -----------------------------------------------------------------
@query(f"{_BASE} SELECT doc_id, m, {_BUD} AS k FROM (SELECT doc_id, count(*) AS m FROM s GROUP BY 1)")
def budget(spark, d):
    return C.sizes(_docs(spark, d)).withColumn("k", T.budget(F.col("m")))


@query(f"{_SCORED} SELECT doc_id, sent_idx, rn FROM rk WHERE rn <= k")
def topk(spark, d):
    return S.top_k(_scores(spark, d))


_MMR = """WITH RECURSIVE e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, ((vec_id * 7919) % 1009) / 1009.0::DOUBLE AS score FROM embeddings),
c AS (SELECT label, greatest(3, round_even(0.05::DOUBLE * count(*), 0)::INT) AS k FROM e GROUP BY 1),
r AS (
  SELECT label, 1 AS step, list(vec_id ORDER BY score DESC, vec_id)[1:1] AS picked FROM e GROUP BY label
  UNION ALL
  SELECT label, step + 1, list_append(picked, nxt) FROM (
    SELECT r.label, r.step, r.picked, (SELECT x.vec_id FROM e x WHERE x.label = r.label AND NOT list_contains(r.picked, x.vec_id)
      ORDER BY {lam} * x.score - (1 - {lam}) * (SELECT max(list_cosine_similarity(x.v, y.v)) FROM e y WHERE y.label = r.label AND list_contains(r.picked, y.vec_id)) DESC, x.vec_id LIMIT 1) AS nxt
    FROM r JOIN c ON r.label = c.label WHERE r.step < least(c.k, (SELECT count(*) FROM e z WHERE z.label = r.label)))),
l AS (SELECT label, max(step) AS step FROM r GROUP BY 1)
SELECT label, unnest(range(1, len(picked) + 1))::INT AS step, unnest(picked) AS vec_id, false AS under_filled FROM r JOIN l USING (label, step)"""


def _mmr(lam: float):
    def run(spark, d):
        e = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("score", F.pmod(F.col("vec_id") * 7919, F.lit(1009)) / 1009.0)
        return S.mmr_select(e, "label", "vec_id", "score", "embedding", lam)

    return run


for _lam in (0.3, 0.5, 0.7, 0.9):
    QUERIES[f"mmr_select_{int(10 * _lam)}"] = _mmr(_lam)
    SQL[f"mmr_select_{int(10 * _lam)}"] = _MMR.replace("{lam}", str(_lam))


def _token_lists(spark, d) -> DataFrame:
    """(doc_id, s): a document's sentences as (score, sent_idx, toks), the score that of ``_scores``.

    A list named inside a function of its items is made anew for each of them; m and the pairs are arguments, made once.
    """
    score = lambda x, i, m: F.round(x - 0.5 * F.round(i / m, 6), 7)
    row = lambda m: lambda p, i: F.struct(score(p["tfidf"], i, m).alias("score"), i.alias("sent_idx"), T.tokens_a(p["sents"]).alias("toks"))
    rows = F.transform(F.array(F.size("tfidf")), lambda m: F.transform(F.arrays_zip("sents", "tfidf"), row(m)))
    return _lists(spark, d).select("doc_id", F.get(rows, 0).alias("s"))


@query()
def threshold_select(spark, d):
    """TK6 at the chosen delta: greedy and data-dependent, so without SQL."""
    return S.threshold_lists(_token_lists(spark, d), (1.15,)).drop("delta")


@query()
def delta_sweep(spark, d):
    """ML9, AG16: the threshold filter at four deltas, a document's sentences read once for all of them."""
    x = S.threshold_lists(_token_lists(spark, d), (1.0, 1.15, 1.25, 1.35))
    under = F.count(F.when(F.col("under_filled"), 1))
    return x.groupBy("delta").agg(
        F.count("*").alias("n_docs"), F.round(F.avg(F.size("selected")), 6).alias("avg_sentences"), F.round(F.avg("budget_fulfillment"), 6).alias("fulfillment_mean"),
        F.round(F.stddev_pop("budget_fulfillment"), 6).alias("fulfillment_std"), under.alias("under_filled_count"), F.round(100.0 * under / F.count("*"), 6).alias("under_filled_pct"),
    )


LAMBDAS = (0.3, 0.5, 0.7, 0.9)
_SWEPT = " UNION ALL ".join(f"SELECT {lam}::DOUBLE AS lam, label, vec_id FROM ({_MMR.replace('{lam}', str(lam))})" for lam in LAMBDAS)


@query(f"SELECT lam, count(DISTINCT label) AS n_docs, count(*) AS n_selected, round(avg((vec_id * 7919 % 1009) / 1009.0), 6) AS mean_score FROM ({_SWEPT}) GROUP BY 1")
def lambda_sweep(spark, d):
    """ML9: MMR at four lambdas."""
    rows = [_mmr(lam)(spark, d).select(F.lit(lam).alias("lam"), "label", "vec_id") for lam in LAMBDAS]
    x = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    return x.groupBy("lam").agg(F.count_distinct("label").alias("n_docs"), F.count("*").alias("n_selected"), F.round(F.avg(F.pmod(F.col("vec_id") * 7919, F.lit(1009)) / 1009.0), 6).alias("mean_score"))


@query(f"{_BASE} SELECT count(*) AS n, count(*) FILTER (round_even(0.05::DOUBLE * m, 0) < 3) AS n_floor, round(avg({_BUD}), 6) AS avg_k, quantile_cont({_BUD}, 0.5) AS median_k, min({_BUD}) AS min_k, max({_BUD}) AS max_k FROM (SELECT doc_id, count(*) AS m FROM s GROUP BY 1)")
def k_audit(spark, d):
    """AG25: how budgets spread and how often the floor of three decides."""
    k = T.budget(F.col("m"))
    x = C.sizes(_docs(spark, d)).select(k.alias("k"), (T.budget(F.col("m"), least=0) < 3).alias("low"))
    return x.agg(F.count("*").alias("n"), F.count(F.when(F.col("low"), 1)).alias("n_floor"), F.round(F.avg("k"), 6).alias("avg_k"), F.expr("percentile(k, 0.5)").alias("median_k"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))


@query(f"{_BASE}, m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY 1), e AS (SELECT doc_id, m, sum(m) OVER (ORDER BY doc_id) AS e FROM m) SELECT doc_id, (e - m)::BIGINT AS start_idx, e::BIGINT AS end_idx, m::INT AS num_sentences FROM e")
def row_offsets(spark, d):
    return C.row_offsets(C.sizes(_docs(spark, d)))


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20")
def spot_check(spark, d):
    """TK14: 20 rows in hash order, the same on every run."""
    return spark.read.parquet(f"{d}/documents.parquet").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(20).select("doc_id", "lang", "n_chars")


@query(f"{_BASE}, {_ROUGE}, r AS (SELECT doc_id, sent_idx, y, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, sent_idx) AS hi, row_number() OVER (PARTITION BY doc_id ORDER BY y, sent_idx) AS lo FROM y) SELECT doc_id, sent_idx, y, hi <= 5 AS is_top, lo <= 2 AS is_bottom FROM r WHERE hi <= 5 OR lo <= 2")
def label_extremes(spark, d):
    """TK8: the five best and two worst labels of each document."""
    w = S.Window.partitionBy("doc_id")
    x = _labels(spark, d).select("doc_id", "sent_idx", "y", F.row_number().over(w.orderBy(F.desc("y"), "sent_idx")).alias("hi"), F.row_number().over(w.orderBy("y", "sent_idx")).alias("lo"))
    return x.where("hi <= 5 or lo <= 2").select("doc_id", "sent_idx", "y", (F.col("hi") <= 5).alias("is_top"), (F.col("lo") <= 2).alias("is_bottom"))


@query()
def rouge_label_stemmed(spark, d):
    """M10 with ST14's stemmer, which has no SQL."""
    return _labels(spark, d, stemmed=True)


@query(f"{_SCORED}, r AS (SELECT rank() OVER (ORDER BY tfidf) + (count(*) OVER (PARTITION BY tfidf) - 1) / 2.0 AS rx, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ry FROM sc) SELECT count(*) AS n, round(coalesce(corr(rx, ry), 0), 6) AS rho FROM r")
def global_spearman(spark, d):
    return E.global_spearman(_scores(spark, d).select("tfidf", "score"), "tfidf", "score")


@query(f"""{_BASE}, m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY 1), x AS (SELECT *, CASE WHEN m < 20 THEN 'short' WHEN m <= 45 THEN 'edge' WHEN m BETWEEN 50 AND 350 THEN 'medium' WHEN m > 500 THEN 'long' END AS stratum FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY CASE WHEN stratum = 'edge' THEN lpad(m::VARCHAR, 6, '0') ELSE md5(doc_id::VARCHAR) END, doc_id) AS rn FROM x WHERE stratum IS NOT NULL)
SELECT doc_id, m, stratum FROM r WHERE stratum = 'short' OR rn <= CASE stratum WHEN 'edge' THEN 11 WHEN 'medium' THEN 20 ELSE 15 END""")
def stratified_sample(spark, d):
    return S.stratified_sample(C.sizes(_docs(spark, d)))


@query("""SELECT doc_id, CASE WHEN r <= least(100, n) THEN 'test' WHEN r <= least(100, n) + floor((n - least(100, n)) * 0.15) THEN 'val' ELSE 'train' END AS part
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) AS r, count(*) OVER () AS n FROM documents)""")
def hash_split(spark, d):
    return S.hash_split(_docs(spark, d))


# ---- transport -------------------------------------------------------------------
_TW = f"{_BASE}, w AS (SELECT doc_id, sent_idx, word, count(*) AS c, {_HV} AS h FROM (SELECT doc_id, sent_idx, unnest({_TOKA}) AS word FROM s) GROUP BY ALL), u AS (SELECT doc_id, sent_idx, word, c / sum(c) OVER (PARTITION BY doc_id, sent_idx) AS p, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) AS v FROM w)"


@query(f"""{_TW}, p AS (SELECT a.doc_id, a.sent_idx, a.word AS wa, a.p AS pa, b.word AS wb, b.p AS pb, sqrt(greatest(2 - 2 * list_dot_product(a.v, b.v), 0)) AS c FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.sent_idx = a.sent_idx - 1),
l AS (SELECT doc_id, sent_idx, sum(x) AS d FROM (SELECT doc_id, sent_idx, wa, any_value(pa) * min(c) AS x FROM p GROUP BY ALL) GROUP BY ALL),
r AS (SELECT doc_id, sent_idx, sum(x) AS d FROM (SELECT doc_id, sent_idx, wb, any_value(pb) * min(c) AS x FROM p GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, sent_idx, round(greatest(l.d, r.d), 4) AS dist FROM l JOIN r USING (doc_id, sent_idx)""")
def rwmd_previous(spark, d):
    """Relaxed distance of every sentence to the one before it, a document's in its row (J6, M7 relaxed, W7)."""
    toks = C.sentence_lists(_docs(spark, d)).select("doc_id", F.transform("sents", T.tokens_a).alias("toks"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                doc, place, dist = W.relaxed_previous(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(place, pa.int32()), pa.array(dist)], ["doc_id", "sent_idx", "dist"])

    return toks.mapInArrow(run, "doc_id long, sent_idx int, dist double").select("doc_id", "sent_idx", F.round("dist", 4).alias("dist"))


@query()
def wmd_exact(spark, d):
    """Exact distance of every sentence to the one before it, a document's in its row (M7, W7); 0 for the first."""
    toks = C.sentence_lists(_docs(spark, d)).select("doc_id", F.transform("sents", T.tokens_a).alias("toks"))
    return toks.select("doc_id", F.posexplode(X.to_previous(spark, F.col("toks"))).alias("sent_idx", "dist")).withColumn("dist", F.rint(F.col("dist") * 1e6) / 1e6)


# ---- redundancy and evaluation ------------------------------------------------------
_DT = f"dt AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[\\p{{L}}\\p{{N}}]+$') AND x NOT IN {_STOP}) AS x FROM documents)"


@query(f"WITH {_DT}, g AS (SELECT doc_id, x, list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]) AS b FROM dt) SELECT doc_id, round(CASE WHEN len(x) = 0 THEN 0.0 WHEN len(x) < 2 THEN 1.0 ELSE len(list_distinct(b))::DOUBLE / len(b) END, 6) AS distinct_2 FROM g")
def distinct_n(spark, d):
    return E.distinct_n(_docs(spark, d).select("doc_id", T.tokens_a(F.coalesce("text", F.lit(""))).alias("toks")), 2)


_BLEU = f"""{_SCORED}, q AS (SELECT doc_id, sent_idx, {_TOKA} AS x FROM rk WHERE rn <= k), z AS (SELECT * FROM q WHERE len(x) > 0), nn AS (SELECT doc_id, count(*) AS n FROM z GROUP BY 1),
g AS (SELECT doc_id, sent_idx, 1 AS o, unnest(x) AS g FROM z UNION ALL SELECT doc_id, sent_idx, 2, unnest(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) FROM z),
c AS (SELECT doc_id, sent_idx, o, g, count(*) AS c FROM g GROUP BY ALL),
m AS (SELECT a.doc_id, a.sent_idx, a.o, a.g, a.c, coalesce(max(b.c), 0) AS other FROM c a LEFT JOIN c b ON a.doc_id = b.doc_id AND a.o = b.o AND a.g = b.g AND a.sent_idx <> b.sent_idx GROUP BY ALL),
h AS (SELECT doc_id, sent_idx, sum(least(c, other)) FILTER (o = 1) AS h1, sum(c) FILTER (o = 1) AS a1, coalesce(sum(least(c, other)) FILTER (o = 2), 0) AS h2, coalesce(sum(c) FILTER (o = 2), 0) AS a2 FROM m GROUP BY ALL),
rl AS (SELECT a.doc_id, a.sent_idx, arg_min(len(b.x), abs(len(b.x) - len(a.x)) * 100000 + len(b.x)) AS r FROM z a LEFT JOIN z b ON a.doc_id = b.doc_id AND a.sent_idx <> b.sent_idx GROUP BY ALL)
SELECT doc_id, round(avg(CASE WHEN n < 2 OR h1 = 0 THEN 0.0 ELSE (CASE WHEN len(x) > r THEN 1.0 ELSE exp(1.0 - r::DOUBLE / len(x)) END) * exp((ln(h1::DOUBLE / a1) + ln((CASE WHEN h2 = 0 THEN 0.1 ELSE h2::DOUBLE END) / greatest(a2, 1))) / 2) END), 6) AS self_bleu_2
FROM z JOIN nn USING (doc_id) JOIN h USING (doc_id, sent_idx) JOIN rl USING (doc_id, sent_idx) GROUP BY 1"""


def _chosen(spark, d) -> DataFrame:
    """(doc_id, sent_idx, k, toks): the budgeted top sentences."""
    r = S.ranked(_scores(spark, d), "doc_id", "sent_idx", "score").withColumn("k", T.budget(F.col("m"))).where("rn <= k")
    return r.select("doc_id", "sent_idx", "k", T.tokens_a(F.col("sent")).alias("toks"))


@query(_BLEU)
def self_bleu(spark, d):
    return E.self_bleu_2(_chosen(spark, d))


@query(_BLEU.replace("SELECT doc_id, round(avg(", "SELECT b.doc_id, b.n_sel AS selected_count, b.k AS k_i, round(b.n_sel / b.k, 6) AS budget_fulfillment, b.n_sel < b.k AS under_filled, coalesce(sb, 0.0) AS self_bleu_2, round(CASE WHEN len(b.ts) = 0 THEN 0.0 WHEN len(b.ts) < 2 THEN 1.0 ELSE len(list_distinct(list_transform(range(1, len(b.ts)), lambda i: b.ts[i] || ' ' || b.ts[i + 1])))::DOUBLE / (len(b.ts) - 1) END, 6) AS distinct_2, b.tc AS token_count FROM (SELECT doc_id, count(*) AS n_sel, any_value(k) AS k, sum(len(" + _TOKA + "))::BIGINT AS tc, flatten(list(" + _TOKA + " ORDER BY sent_idx)) AS ts FROM rk WHERE rn <= k GROUP BY 1) b LEFT JOIN (SELECT doc_id, round(avg(").replace("AS self_bleu_2\nFROM z", "AS sb\nFROM z") + ") q2 ON b.doc_id = q2.doc_id")
def summary_metrics(spark, d):
    """Counts, budget, redundancy and tokens of the selected sentences."""
    r = _chosen(spark, d)
    toks = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "toks"))), lambda x: x["toks"]))
    c = r.groupBy("doc_id").agg(F.count("*").alias("selected_count"), F.max("k").alias("k_i"), F.sum(F.size("toks").cast("long")).alias("token_count"), toks.alias("toks"))
    c = c.join(E.distinct_n(c.select("doc_id", "toks"), 2), "doc_id").join(E.self_bleu_2(r), "doc_id", "left")
    return c.select("doc_id", "selected_count", "k_i", F.round(F.col("selected_count") / F.col("k_i"), 6).alias("budget_fulfillment"), (F.col("selected_count") < F.col("k_i")).alias("under_filled"), F.coalesce("self_bleu_2", F.lit(0.0)).alias("self_bleu_2"), "distinct_2", "token_count")


def _two_ranks(spark, d) -> DataFrame:
    """Scores with ``rn``, the rank by score, and ``rt``, the rank by TF-IDF."""
    x = S.ranked(_scores(spark, d), "doc_id", "sent_idx", "tfidf").withColumnRenamed("rn", "rt")
    return S.ranked(x, "doc_id", "sent_idx", "score")


_TWO = f"{_SCORED}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, sent_idx DESC) AS rt FROM rk)"


@query(f"""{_TWO}, a AS (SELECT doc_id, count(*) FILTER (rn <= k AND rt <= k) AS hits, count(*) FILTER (rn <= k OR rt <= k) AS any_, count(*) FILTER (rt <= k) AS truth FROM p GROUP BY 1)
SELECT doc_id, round(hits::DOUBLE / any_, 6) AS jaccard, round(hits::DOUBLE / truth, 6) AS recall FROM a""")
def overlap_metrics(spark, d):
    """SO1-SO3: the score's top k against the top k by TF-IDF alone; both ranks in one pass over a document."""
    of = lambda c: F.collect_list(F.when(F.col(c) <= T.budget(F.col("m")), F.col("sent_idx")))
    j = _two_ranks(spark, d).groupBy("doc_id").agg(of("rt").alias("truth"), of("rn").alias("found"))
    return j.select("doc_id", F.round(E.jaccard(F.col("truth"), F.col("found")), 6).alias("jaccard"), F.round(E.recall(F.col("truth"), F.col("found")), 6).alias("recall"))


@query(f"""{_SCORED}, r AS (SELECT doc_id, sent_idx, tfidf, score, rank() OVER (PARTITION BY doc_id ORDER BY tfidf) + (count(*) OVER (PARTITION BY doc_id, tfidf) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY doc_id ORDER BY score) + (count(*) OVER (PARTITION BY doc_id, score) - 1) / 2.0 AS ry FROM sc),
rho AS (SELECT doc_id, count(*) AS m, corr(rx, ry) AS rho, stddev_pop(rx) * stddev_pop(ry) AS sd FROM r GROUP BY 1),
tau AS (SELECT a.doc_id, sum(sign(a.tfidf - b.tfidf) * sign(a.score - b.score)) / nullif(sqrt(sum(abs(sign(a.tfidf - b.tfidf))) * sum(abs(sign(a.score - b.score)))), 0) AS tau FROM sc a JOIN sc b ON a.doc_id = b.doc_id AND a.sent_idx < b.sent_idx GROUP BY 1)
SELECT doc_id, round(CASE WHEN sd = 0 THEN 0 ELSE coalesce(rho, 0) END, 6) AS rho, round(coalesce(tau, 0), 6) AS tau_b FROM rho JOIN tau USING (doc_id) WHERE m >= 2""")
def rank_corr(spark, d):
    return E.rank_correlation(_scores(spark, d), "doc_id", "sent_idx", "tfidf", "score")


@query(f"""{_SCORED} SELECT doc_id, any_value(m) AS m, round(min(rn) FILTER (tfidf = mx) / any_value(m), 6) AS best_pct, round(avg(rn) FILTER (rt <= k) / any_value(m), 6) AS top_pct, count(*) FILTER (tfidf >= 0.8) AS n_high, count(*) FILTER (tfidf >= 0.8 AND rn <= k) AS n_high_top,
round(avg(rn) FILTER (tfidf >= 0.8), 6) AS mean_high_rank, round(max(score) - min(score), 7) AS spread, round(stddev_pop(score), 4) AS std FROM (SELECT *, max(tfidf) OVER (PARTITION BY doc_id) AS mx, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, sent_idx DESC) AS rt FROM rk) GROUP BY 1""")
def rank_diagnostics(spark, d):
    return E.rank_diagnostics(_scores(spark, d).select("doc_id", "sent_idx", "tfidf", "score", "m"), "doc_id", "sent_idx", "tfidf", "score")


@query(f"""{_TWO}, a AS (SELECT doc_id, any_value(m) AS m, any_value(k) AS k, count(*) FILTER (rn <= k AND rt <= k) AS hits FROM p GROUP BY 1)
SELECT CASE WHEN m < 20 THEN 'short' WHEN m <= 500 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n_docs, sum(m)::BIGINT AS total_sentences, round(sum(hits)::DOUBLE / sum(least(k, m)), 6) AS capture, round((sum(hits)::DOUBLE / sum(least(k, m))) / (sum(least(k, m))::DOUBLE / sum(m)), 6) AS over_chance FROM a GROUP BY 1""")
def bucket_report(spark, d):
    """AG17: by length, the share of the truth that is found, and its ratio to chance."""
    b = T.budget(F.col("m"))
    m = _two_ranks(spark, d).groupBy("doc_id").agg(F.max("m").cast("long").alias("m"), F.count(F.when((F.col("rn") <= b) & (F.col("rt") <= b), 1)).alias("both"))
    m = m.withColumn("k", F.least(T.budget(F.col("m")).cast("long"), "m"))
    hit, k, n = F.sum("both"), F.sum("k"), F.sum("m")
    return m.groupBy(T.length_bucket(F.col("m")).alias("bucket")).agg(F.count("*").alias("n_docs"), n.alias("total_sentences"), F.round(F.try_divide(hit, k), 6).alias("capture"), F.round(F.try_divide(F.try_divide(hit, k), F.try_divide(k, n)), 6).alias("over_chance"))


@query(f"""{_BASE}, m AS (SELECT doc_id, m, least({_BUD}, m)::INT AS k FROM (SELECT doc_id, count(*) AS m FROM s GROUP BY 1)),
h AS (SELECT doc_id, m, k, unnest(range(greatest(0, 2 * k - m), k + 1))::INT AS h FROM m),
p AS (SELECT *, exp(lgamma(k + 1) - lgamma(h + 1) - lgamma(k - h + 1) + lgamma(m - k + 1) - lgamma(k - h + 1) - lgamma(m - 2 * k + h + 1) - lgamma(m + 1) + lgamma(k + 1) + lgamma(m - k + 1)) AS p FROM h)
SELECT doc_id, round(sum(p * h / (2 * k - h)), 6) AS ej, round(max(k::DOUBLE / m), 6) AS er FROM p GROUP BY 1""")
def chance_closed_form(spark, d):
    return E.chance(C.sizes(_docs(spark, d)))


@query(f"""{_SCORED}, q AS (SELECT 'tfidf' AS feature, quantile_cont(tfidf, 0.25) AS a, quantile_cont(tfidf, 0.5) AS b, quantile_cont(tfidf, 0.75) AS c FROM sc UNION ALL SELECT 'pos', quantile_cont(pos, 0.25), quantile_cont(pos, 0.5), quantile_cont(pos, 0.75) FROM sc)
SELECT feature, round(b, 6) AS center, round(CASE WHEN c = a THEN 1 ELSE c - a END, 6) AS scale FROM q""")
def robust_scale(spark, d):
    p = E.robust_params(_scores(spark, d).select("tfidf", "pos"), ["tfidf", "pos"])
    return p.select("feature", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


@query(f"""{_SCORED} SELECT doc_id, sent_idx, round((tfidf - (SELECT quantile_cont(tfidf, 0.5) FROM sc)) / (SELECT quantile_cont(tfidf, 0.75) - quantile_cont(tfidf, 0.25) FROM sc), 4) + 0.0 AS tfidf FROM sc""")
def scaled_features(spark, d):
    x = _scores(spark, d).select("doc_id", "sent_idx", "tfidf")
    return E.scale(x, E.robust_params(x, ["tfidf"]), ["tfidf"]).withColumn("tfidf", F.round("tfidf", 4) + 0.0)


@query(f"{_SCORED} SELECT count(*) AS n, round(1 - sum((tfidf - score) ** 2) / (var_pop(tfidf) * count(*)), 6) AS r2, round(sqrt(avg((tfidf - score) ** 2)), 6) AS rmse, round(avg(abs(tfidf - score)), 6) AS mae, false AS negative_r2 FROM sc")
def regression_metrics(spark, d):
    m = E.regression_metrics(_scores(spark, d), "tfidf", "score")
    return m.select("n", F.round("r2", 6).alias("r2"), F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "negative_r2")


@query(f"""{_BASE}, a AS (SELECT doc_id, sent_idx FROM s), b AS (SELECT doc_id, sent_idx FROM s WHERE length(sent) > 20), j AS (SELECT a.doc_id AS x, b.doc_id AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx)
SELECT 'only_left' AS "check", count(*) FILTER (y IS NULL) AS n_bad FROM j UNION ALL SELECT 'only_right', count(*) FILTER (x IS NULL) FROM j UNION ALL SELECT 'nan_n', 0 UNION ALL SELECT 'inf_n', 0 UNION ALL SELECT 'differs_n', count(*) FILTER (y IS NULL) FROM j""")
def alignment_audit(spark, d):
    s = _sents(spark, d).select("doc_id", "sent_idx", F.length("sent").alias("n"))
    return E.alignment(s, s.where("n > 20"), ["doc_id", "sent_idx"], ["n"])


def _features(spark, d, config: str) -> DataFrame:
    """ML1: (doc_id, sent_idx, the configuration's features), raw."""
    return G.feature_rows(_docs(spark, d, True), _lists(spark, d), config)


@query()
def c1_features(spark, d):
    """ML1, M8: the five features of C1; the distance to the document is the relaxed one, with the mask of its fallback."""
    return _features(spark, d, "C1")


@query(f"""{_SCORED}, {_WV}, c AS (SELECT doc_id, [{", ".join(f"avg(v[{i}])" for i in range(1, 9))}] AS c FROM sv GROUP BY 1)
SELECT sc.doc_id, sc.sent_idx, tfidf, len(regexp_extract_all(sent, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*'))::DOUBLE AS ner, pos AS position, coalesce(round(list_cosine_similarity(v, c), 6), 0) AS cosine_sbert
FROM sc LEFT JOIN sv USING (doc_id, sent_idx) LEFT JOIN c ON c.doc_id = sc.doc_id""")
def c3_features(spark, d):
    """ML1, PF10, PF11: the four features of C3; hash vectors stand in for sentence embeddings."""
    return _features(spark, d, "C3")


def _paired(spark, d) -> DataFrame:
    """(doc_id, text): the documents with references, which alone have labels to learn from."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return C.spread(docs.join(_references(spark, d).select("doc_id").distinct(), "doc_id", "left_semi"), True)


@query()
def gbt_scores(spark, d):
    """ML5/ML6 on the labels of documents with references: all trees, the features of C3.

    Only those documents are split and scored; the vocabulary is that of all.
    """
    f = G.features_of("C3")
    docs, vocab = _paired(spark, d), _vocab(spark, d)
    x = G.feature_rows(docs, C.scored_lists(docs, vocab), "C3")
    x = x.join(C.labels(C.sentences(docs), _references(spark, d)).select("doc_id", "sent_idx", "y"), ["doc_id", "sent_idx"])
    paired = _references(spark, d).select("doc_id").distinct()
    x = x.join(S.hash_split(paired, test=0), "doc_id").select("doc_id", "sent_idx", *f, "y", "part")
    return G.predict(G.fit(x.where("part = 'train'"), f), x, f).select("doc_id", "sent_idx", "part", "y", "y_hat")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Summaries: a document's sentences by score and against redundancy (MMR, lambda 0.7), in document order."""
    vecs = C.sentence_vectors(C.sentences(_docs(spark, d, True))).groupBy("doc_id").agg(F.collect_list(F.struct("sent_idx", "vec")).alias("vecs"))
    score = F.transform("tfidf", lambda x, i: F.round(x - 0.5 * F.round(i / F.size("tfidf"), 6), 7))
    x = _lists(spark, d).join(vecs, "doc_id", "left").select("doc_id", "sents", score.alias("scores"), "vecs")
    r = S.mmr_lists(x, 0.7).withColumn("k", T.budget(F.size("sents")))
    return r.select("doc_id", F.array_join(F.transform("ordered", lambda i: F.get("sents", i)), " ").alias("summary"), "k", F.round(F.size("ordered") / F.col("k"), 6).alias("fulfillment"))


@query(f"""{_SCORED.replace("WITH", "WITH RECURSIVE", 1)}, {_WV},
q AS (SELECT rk.doc_id, rk.sent_idx, sent, score, k, m, coalesce(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), [0.0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[]) AS u FROM rk LEFT JOIN sv USING (doc_id, sent_idx)),
r AS (
  SELECT doc_id, sent_idx, score, k, m, u, 1 AS step, -2.0::DOUBLE AS near, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_idx) = 1 AS pick FROM q
  UNION ALL
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY 0.7::DOUBLE * score - (1 - 0.7::DOUBLE) * near DESC, sent_idx) = 1 AS pick FROM (
    SELECT doc_id, sent_idx, score, k, m, u, step + 1 AS step, greatest(near, least(1, greatest(-1, list_dot_product(u, pu)))) AS near
    FROM (SELECT *, max(CASE WHEN pick THEN u END) OVER (PARTITION BY doc_id) AS pu FROM r) WHERE NOT pick AND step < least(k, m)))
SELECT r.doc_id, string_agg(sent, ' ' ORDER BY r.sent_idx) AS summary, any_value(r.k) AS k, round(count(*) / any_value(r.k), 6) AS fulfillment FROM r JOIN q USING (doc_id, sent_idx) WHERE pick GROUP BY 1""")
def c3_summary(spark, d):
    return flagship(spark, d)


@query()
def global_kendall(spark, d):
    """M16 over all sentences; all pairs are too many for SQL, tests compare with them."""
    return E.global_kendall(_scores(spark, d), "tfidf", "score")


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')) < 50 AS near_empty, length(regexp_replace(coalesce(text, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')) = 0 AS blank FROM documents")
def empty_texts(spark, d):
    """PF1, PF2."""
    t = F.col("text")
    return _docs(spark, d).select("doc_id", T.is_near_empty(t).alias("near_empty"), T.is_blank(t).alias("blank"))


@query(f"{_BASE} SELECT doc_id, count(*) AS m FROM s GROUP BY 1 ORDER BY m, doc_id LIMIT 10")
def shortest_docs(spark, d):
    """TK10, the other end."""
    return C.sizes(_docs(spark, d)).orderBy("m", "doc_id").limit(10)


@query("SELECT 'train' AS left_part, 'test' AS right_part, 0::BIGINT AS n_shared")
def split_overlap(spark, d):
    """Ids that train and test share; the contract is none."""
    x = S.hash_split(_docs(spark, d)).cache()
    n = S.overlap(x.where("part = 'train'"), x.where("part = 'test'"))
    x.unpersist()
    return spark.createDataFrame([("train", "test", n)], "left_part string, right_part string, n_shared long")


@query("SELECT source, min(doc_id) AS first_doc FROM documents WHERE source IS NOT NULL GROUP BY 1")
def first_seen(spark, d):
    """SO7: sources in the order in which they are first seen."""
    x = spark.read.parquet(f"{d}/documents.parquet").where("source is not null").withColumnRenamed("doc_id", "first_doc")
    return S.first_seen(x, "source", "first_doc")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id::VARCHAR) AS place FROM documents ORDER BY doc_id::VARCHAR LIMIT 50")
def text_order(spark, d):
    """TK2: the first 50 ids in the order of their text, which is not that of their value."""
    ids = spark.read.parquet(f"{d}/documents.parquet").select("doc_id").orderBy(F.col("doc_id").cast("string")).limit(50)
    return ids.select("doc_id", F.row_number().over(S.Window.orderBy(F.col("doc_id").cast("string"))).cast("long").alias("place"))  # 50 rows


@query(f"""{_SCORED} SELECT 'tfidf' AS feature, round(max(abs(tfidf - score)), 6) AS max_abs_diff FROM sc""")
def max_difference(spark, d):
    """AG24."""
    x = _scores(spark, d)
    a, b = x.select("doc_id", "sent_idx", "tfidf"), x.select("doc_id", "sent_idx", F.col("score").alias("tfidf"))
    return E.max_difference(a, b, ["doc_id", "sent_idx"], ["tfidf"]).withColumn("max_abs_diff", F.round("max_abs_diff", 6))


@query(f"""{_SCORED}, p AS (SELECT avg(tfidf) AS c, stddev_pop(tfidf) AS s FROM sc) SELECT doc_id, sent_idx, round((tfidf - c) / s, 4) + 0.0 AS tfidf FROM sc, p""")
def standard_scaled(spark, d):
    """ML2-ML4: mean and deviation fitted and applied."""
    out, _ = E.fit_transform(_scores(spark, d).select("doc_id", "sent_idx", "tfidf"), ["tfidf"], "standard")
    return out.withColumn("tfidf", F.round("tfidf", 4) + 0.0)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
