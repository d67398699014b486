"""What the corpus operators share: reading, Arrow batches, word bytes, checkpoints.

Keys.  A document is known by ``doc_id`` and, because ids may be null or
repeated, by a 64-bit hash of its text (``_th``).  Rows equal in both are one
document and share one decision.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; ``bytes.split()`` without arguments splits on exactly these.
SPACES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's switch for removing an execution's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch on its way to Python.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"


def ready(spark: SparkSession) -> SparkSession:
    """Sees that checkpoint() has a folder: that of ``spark.checkpoint.dir``, which a cluster's executors share."""
    sc: SparkContext = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="inkstone-ckpt-"))  # one machine, one folder
    return spark


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Plans and runs what is inside under a setting, and puts the old one back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder and reads it from there: lineage ends, lost executors cost nothing, and
    the shuffle files that made it are removed.

    A checkpoint keeps the size estimate of the plan that made it, and a join's is the product of its sides: in
    loops its digits double with each round until the driver's heap is full.  The copy has no estimate; joins
    are then chosen by the sizes that the shuffles measure.
    """
    spark = ready(df.sparkSession)
    with setting(spark, TIDY, "true"), setting(spark, BATCH_KEY, BATCH):
        held = df.select("*").checkpoint(eager=True)._jdf  # a new plan: an execution takes the switch as it is when its plan is made
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)
    where = held.queryExecution().logical().rdd().getCheckpointFile()
    out._written = where.get() if where.isDefined() else None
    return out


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as Parquet in the checkpoint folder: far smaller for tables of many short rows."""
    spark = ready(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    with setting(spark, TIDY, "true"), setting(spark, BATCH_KEY, BATCH):
        df.select("*").write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*written: DataFrame) -> None:
    """Deletes what ``cut`` or ``stored`` wrote for tables that nothing reads any more; what is made from them later must have been cut itself."""
    for df in written:
        if getattr(df, "_written", None):
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            path = jvm.org.apache.hadoop.fs.Path(df._written)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def without_broadcast(spark: SparkSession):
    """No automatic broadcasts inside: in loops over small tables each one holds a page of driver memory."""
    return setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1")


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _th, text): the operators' input, free of any other column; a null text has a null ``_th``."""
    t = F.col(f"`{text_col}`").cast("string")
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.when(t.isNotNull(), F.xxhash64(t)).alias("_th"), t.alias("text"))


#: Where the ranks of rows without a number for an id begin.
LATE = 1 << 62


def rank(doc_id: Column, th: Column) -> Column:
    """The order of documents: ids that are whole numbers by value, then all others, null too, by a hash of id and text hash."""
    return F.coalesce(doc_id.try_cast("bigint"), F.lit(LATE) + F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), th), 2))


def slices(batches: Iterator[pa.RecordBatch], budget: int = 4_000_000, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of at most ``rows`` rows and about ``budget`` bytes, so that results stay small."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, min(rows, int(b.num_rows * budget / max(b.nbytes, 1))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def texts_of(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` over small slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield fn(b)

    return df.mapInArrow(run, schema)


class Ids(dict):
    """Numbers unseen keys 0, 1, 2 ... as they are looked up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n

    def of(self, keys) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=len(keys))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... (lengths[i] of them) for all i, in one array."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    at, s, n = (ends - lengths)[keep], starts[keep], lengths[keep]
    out[at[0]] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
