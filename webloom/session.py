"""Session helpers: table access, the shared work folder, shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}
_work: dict[str, str] = {}


def build_session(app_name: str = "webloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WEBLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` dealt out over all cores where its files are fewer and small.

    A file of one row group is read by one task, whatever is computed from it. Only tables of up to ``most_bytes`` for
    each core move, and only where there are fewer files than cores, so a large table stays where it is read.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return df.repartition(cores) if size <= most_bytes * cores else df


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 400_000) -> DataFrame:
    """``df`` of about ``rows`` rows, by ``keys`` over as many tasks as hold ``most`` each, where the session's partitions would hold more.

    A task's hash table or sort has then a size that does not grow with the table. What follows by the same keys needs no
    exchange of its own, nor a hash table before it.
    """
    tasks = -(-rows // most)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="webloom-"), "webloom_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, as in tests or on a laptop, may leave it unset; a temporary folder takes its place there.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _own.get(context.applicationId)
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="webloom-shared-")
    jvm = context._jvm
    target = jvm.org.apache.hadoop.fs.Path(found)
    store = target.getFileSystem(context._jsc.hadoopConfiguration())
    whole = store.makeQualified(target).toString().rstrip("/")
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def work_folder(spark: SparkSession) -> str:
    """The folder of this application's work tables; it goes when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _work:
        _work[app] = f"{shared_dir(spark)}/webloom/{app}"
        atexit.register(_forget, spark, app)
    return _work[app]


def _forget(spark: SparkSession, app: str) -> None:
    try:
        drop_path(spark, _work[app])
    except Exception:  # the JVM may be gone already
        pass


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def clear_work(spark: SparkSession) -> None:
    """Delete this application's work tables; results that read them must have been written before."""
    drop_path(spark, work_folder(spark))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors, and gives the optimizer the
    true size of the table, so that it broadcasts it only when it is small.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.work_path = path
    return written


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        if df is not None and getattr(df, "work_path", None):
            drop_path(df.sparkSession, df.work_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
