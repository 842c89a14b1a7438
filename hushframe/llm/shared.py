"""Tables that the driver and all executors can see."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.textbytes import give_back
from hushframe.session import on_one_machine

#: Keys that spread_join() may send to every task.
HOT_KEYS = 10_000

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or a folder of our own where it is unset (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not on_one_machine(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="hushframe-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + os.path.abspath(_own[0])


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/hushframe/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{uuid.uuid4().hex}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has put into the shared folder, when no result is read any more."""
    delete(spark, own_dir(spark))


def release(spark: SparkSession) -> bool:
    """Give memory that the driver has freed back to the system, by its Python and its JVM.

    Each plan compiles code of its own, and what the JVM's compilers and threads have
    freed lies outside its heap, where no garbage collection returns it.  False where
    the JVM has no command for it.
    """
    give_back()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # By the interface's method: the server's own class may not be called from outside its module.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(server, args)
    except Py4JError:
        return False
    return True


#: Rows of one written file of a table whose size is known.
FILE_ROWS = 100_000


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: its lineage ends there, and any executor can be lost.

    ``rows``: the number of its rows, about; small tables then become few files.
    """
    path = new_path(df.sparkSession, name)
    out = df if rows is None else df.coalesce(rows // FILE_ROWS + 1)
    out.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_small(df: DataFrame, name: str) -> DataFrame:
    """As cut(), for a table that may be small: it is counted first."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cut(kept, name, kept.count())
    kept.unpersist()
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that are no longer read."""
    for table in tables:
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            delete(table.sparkSession, name)


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner", most: int = HOT_KEYS, total: int | None = None) -> DataFrame:
    """rows joined with a table of one row for each key (a long), of which ``weight`` rows have it.

    Keys with more than 1 / ``most`` of all rows, of which there are fewer than ``most``,
    go to every task, and their rows stay where they are; so no task gets more than that
    share by one key.  The table is read several times: cut() it before.
    """
    names = [c for c in table.columns if c != key]
    if total is None:
        total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) > total / most).select(key, F.struct(*names).alias("spread_hot"))
    # Rows whose key is found already are dealt out by all of their columns; that this is some key does not matter.
    apart = F.when(F.col("spread_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))
    cold = table.select(F.col(key).alias("spread_key"), F.struct(*names).alias("spread_cold"))
    both = rows.join(F.broadcast(hot), key, "left").withColumn("spread_key", apart).join(cold, "spread_key", "left")
    found = both.withColumn("spread_found", F.coalesce("spread_hot", "spread_cold"))
    if how == "inner":
        found = found.where("spread_found IS NOT NULL")
    return found.select(*rows.columns, "spread_found.*")
