"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch, a tenth of what is usual.
BATCH_ROWS = 1000


def on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session on one machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("hushframe")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def package() -> bytes:
    """The package as a zip."""
    top = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    return out.getvalue()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers of this application, once.

    The zip lies in the folder that spark.checkpoint.dir names; in a folder of our own
    where that is unset, as on one machine.
    """
    # Rows of an Arrow batch: a batch of texts is held several times over, by the JVM and by the worker.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not on_one_machine(context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not shared:
        shared = tempfile.mkdtemp(prefix="hushframe-ship-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/hushframe/{context.applicationId}/hushframe_package.zip")
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(package()))
    stream.close()
    context.addPyFile(path.toString())
    _shipped.add(context.applicationId)
    return spark


def kept(df: DataFrame) -> DataFrame:
    """The rows, written now to the checkpoint folder (shared by all executors): what made them is not run again.

    Where no folder is set, one of our own serves on one machine; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not on_one_machine(context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="hushframe-kept-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


#: Input below this many bytes a core may be one row group of one file, which one task would read alone.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt out to all cores where there are few bytes of them (by the plan's own estimate): the work on a row may be heavy all the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SMALL:
        return df
    return df.repartition(cores)


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir, or one of our own on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not on_one_machine(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _scratch:
            _scratch.append(tempfile.mkdtemp(prefix="hushframe-scratch-"))
            atexit.register(shutil.rmtree, _scratch[0], ignore_errors=True)
        top = f"file://{_scratch[0]}"
    return f"{top.rstrip('/')}/hushframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
