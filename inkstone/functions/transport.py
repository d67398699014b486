"""Exact transport within a document as Column expressions: ``Transport.java``, compiled by the compiler that Spark has for its plans."""

from __future__ import annotations

import pkgutil
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FOUND = "array<struct<delta double, picks array<int>, num_evaluated int, num_rejected int>>"
KINDS = {"Previous": "array<double>", "Filter": FOUND}


def _function(spark: SparkSession, kind: str, *args: Column) -> Column:
    """A call of a class of ``Transport.java``; the first in a session compiles it and hands its classes to the executors."""
    name = f"inkstone_transport_{kind.lower()}"
    if not spark.catalog.functionExists(name):
        java = spark._jvm.org.codehaus.janino.SimpleCompiler()
        java.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        java.cook(pkgutil.get_data(__package__, "Transport.java").decode())
        with tempfile.NamedTemporaryFile(prefix="inkstone-transport-", suffix=".jar", delete=False) as file, zipfile.ZipFile(file, "w") as jar:
            for path, code in java.getBytecodes().items():
                jar.writestr(path.replace(".", "/") + ".class", bytes(code))
        spark.sql(f"ADD JAR '{file.name}'")
        for k, ddl in KINDS.items():
            made = java.getClassLoader().loadClass(f"inkstone.Transport${k}").newInstance()
            spark._jsparkSession.udf().register(f"inkstone_transport_{k.lower()}", made, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(ddl))
    return F.call_function(name, *args)


def to_previous(spark: SparkSession, sentences: Column) -> Column:
    """Of a document's sentences, as lists of tokens, each one's distance to the one before; 0 for the first."""
    return _function(spark, "Previous", sentences)


def filtered(spark: SparkSession, sentences: Column, k: Column, deltas: tuple[float, ...]) -> Column:
    """TK6: for each delta its (delta, places picked, num_evaluated, num_rejected), the sentences in the order in which they are tried."""
    return _function(spark, "Filter", sentences, k, F.array(*[F.lit(float(d)) for d in deltas]))
