"""Mixing sources to target weights by capped water-filling (operator 6, native).

``targets(sizes)``: the mix is 150 % of all words.  Sources by code point, null
last, weigh 5, 2, 1, repeating.  A source is clamped at ``max_epochs`` times its
size and what it leaves is shared among the others by weight, again and again,
until no source is above its clamp.  ``mix(df)`` then takes of each source whole
repetitions of all its documents and, for the rest, one more repetition of a
seeded part of them: documents in order of a seeded hash, as many as come
nearest the target.  The cut is found by narrowing a 48-bit hash range four
times by 12 bits, each time from sums by bucket, so no source is ever sorted or
gathered in one task.

Only DataFrame operations are used.  The rounds read sums of a table that has
one row a source; the driver sees two numbers a round.

A document's place in the order follows from the seed, its doc_id, source and
text, and, among rows equal in all three, from a number 0, 1, ... of its own, so
that rows with one id or none, and copies, are taken one by one.  Numbers are
counted inside input partitions first, so that a group of copies is no task.

Defined results.  Null text: size 0, taken 0.  Null source: a source of its own.
Sources without words: target 0.  Repeated rows are documents of their own; which
of them are taken makes no difference, how many does not change from run to run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.common import cut, table

WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED = 1.5, 2.0, "mix-1"
LEVELS, BITS = 4, 12
SPREAD, MOST_SALTS = 1_000_000, 4096  # rows of one source in a task; salts at most


def size_of(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) by code point, null last, without gathering the sources in one task."""
    parts = cut(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    own = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return parts.withColumn("rank", F.row_number().over(own) - 1).join(before, "part").withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def targets(sizes: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight, target from (source, size) rows."""
    src = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    src = cut(src.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * max_epochs).alias("cap")))
    total = share * (src.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        # level only grows, so what is clamped once stays clamped; each round clamps at least one more source
        full = F.col("weight") * level > F.col("cap")
        held, open_weight = src.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (held or 0.0)) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return src.select("source", "source_size", "weight", F.least("cap", F.col("weight") * level).alias("target"))


def identity(seed: str) -> Column:
    """A digest of the seed and of a document's id, source and text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(seed), part("doc_id"), part("source"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``i``: 0, 1, ... among rows with one ``id``."""
    again = rows.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("id").alias("_id"))
    if not again.limit(1).count():
        return rows.withColumn("i", F.lit(0).cast("long"))
    rows = cut(rows.withColumn("_p", F.spark_partition_id()))
    again = cut(again)
    same = F.col("id") == F.col("_id")
    once = rows.join(again, same, "left_anti").withColumn("i", F.lit(0).cast("long"))
    more = rows.join(again, same, "left_semi")
    parts = more.groupBy("id", "_p").agg(F.count("*").alias("_n"))
    before = parts.select(F.col("id").alias("_id"), F.col("_p").alias("_q"), (F.sum("_n").over(Window.partitionBy("id").orderBy("_p")) - F.col("_n")).alias("_b"))  # a row a partition
    own = more.withColumn("i", F.row_number().over(Window.partitionBy("id", "_p").orderBy("id")))
    own = own.join(before, same & (F.col("_p") == F.col("_q"))).withColumn("i", F.col("i") - 1 + F.col("_b"))
    return once.select(*rows.columns, "i").unionByName(own.select(*rows.columns, "i")).drop("_p")


def order_hash() -> Column:
    """48 bits of a numbered document."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id"), F.col("i").cast("string"))), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def salts_for(rows: int, sources: int) -> int:
    """Over how many tasks the rows of one source are spread; salting never makes the sources' table larger than a tenth of the rows."""
    return max(1, min(MOST_SALTS, rows // SPREAD, rows // (10 * max(sources, 1))))


def by_source(rows: DataFrame, small: DataFrame, salts: int) -> DataFrame:
    """Joins a row a source (its key is ``s``) to (source, h, ...) rows; a hot source is spread over ``salts`` tasks."""
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.pmod("h", F.lit(salts)).cast("int") == F.col("salt"))
    return rows.join(small, same).drop("s", "salt")


def plan(sizes: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """s (a source), source_size, target, whole, rest, last from (source, size, h) rows: documents with h up to ``last``
    are taken once more; and the number of salts for joins of such rows."""
    goal = targets(sizes, share, max_epochs)
    # whole repetitions, and the words still wanted of one more
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int"))
    salts = salts_for(sizes.count(), goal.count())
    goal = cut(goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    # by source: the hash prefix in which the wanted words end; what lies below it is taken
    at = goal.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    for k in range(1, LEVELS + 1):
        inside = by_source(sizes, at.select(F.col("source").alias("s"), "prefix"), salts).withColumn("b", F.shiftright("h", (LEVELS - k) * BITS))
        sums = inside.where(F.shiftright("b", BITS) == F.col("prefix")).groupBy("source", "b").agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("b")  # at most 4,096 rows a source
        sums = sums.withColumn("to", F.sum("n").over(run)).select(F.col("source").alias("s"), "b", "n", "to")
        hit = sums.join(at.select("source", "rest", "below"), F.col("s").eqNullSafe(F.col("source"))).where(F.col("below") + F.col("to") > F.col("rest"))
        hit = hit.groupBy("source").agg(F.min(F.struct("b", "n", "to")).alias("x")).select(F.col("source").alias("s"), "x")
        at = cut(at.join(hit, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "rest",
            F.coalesce(F.col("x.b"), F.shiftleft(F.col("prefix") + 1, BITS)).alias("prefix"),
            (F.col("below") + F.coalesce(F.col("x.to") - F.col("x.n"), F.lit(0))).alias("below"),
            F.coalesce(F.col("x.n"), F.lit(0)).alias("n")))
    # the document at the cut is taken too if that comes nearer the target
    last = F.when(F.col("below") + F.col("n") - F.col("rest") < F.col("rest") - F.col("below"), F.col("prefix")).otherwise(F.col("prefix") - 1)
    ends = at.select(F.col("source").alias("s"), last.alias("last"))
    return cut(goal.join(ends, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", "whole", "rest", "last")), salts


def measured(df: DataFrame, seed: str = SEED) -> DataFrame:
    rows = cut(df.select("doc_id", "source", size_of(F.col("text").cast("string")).alias("size"), identity(seed).alias("id")))
    return cut(numbered(rows).select("doc_id", "source", "size", order_hash().alias("h")))


def copies() -> Column:
    return F.col("whole") + ((F.col("h") <= F.col("last")) & (F.col("rest") > 0)).cast("int")


def shares(df: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (repetitions the mix takes), one row per row of ``df``."""
    sizes = measured(df, seed)
    return by_source(sizes, *plan(sizes, share, max_epochs)).select("doc_id", "source", "size", "source_size", "target", copies().alias("copies"))


def mix(df: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of ``df``, each as often as the mix takes it."""
    goal = plan(measured(df, seed), share, max_epochs)
    rows = numbered(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), "source", identity(seed).alias("id")))
    taken = by_source(rows.withColumn("h", order_hash()), *goal).select("row", copies().alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shares(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


QUERIES = {"op6_mixing": op6_mixing}
ORACLE_SQL = {
    "op6_mixing": """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(id || ':' || (row_number() OVER (PARTITION BY id) - 1)), 1, 12))::BIGINT AS h
  FROM (SELECT *, md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, 'null'), coalesce(source, 'null'), md5(coalesce(text, '')))) AS id FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS weight FROM s),
o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM w),
c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY k DESC) AS open_weight, (SELECT 1.5 * sum(source_size) FROM s) AS total FROM o),
l AS (SELECT arg_min((total - held) / open_weight, k) FILTER (WHERE (total - held) / open_weight * weight <= cap) AS level FROM c),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM c, l),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12)::INT ELSE 0 END AS whole FROM t),
r AS (SELECT *, greatest(0.0, target - whole * source_size) AS rest FROM g),
x AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
}
