"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours gets; the cluster may override any of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole XML reports travel to the Python parser in Arrow batches: keep a batch
    # at 2k documents (not 10k) so large reports do not overload a worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Reports and logs are many small files: do not charge 4 MB per file when packing splits.
    "spark.sql.files.openCostInBytes": str(256 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "suitelens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``suitelens`` importable in the Python workers (as ``--py-files`` would).

    Zips the package once per application and adds it to the context, so the
    executors' Python processes can unpickle the few functions that run there.
    Idempotent and thread-safe: one zip per application and process, in a private folder
    of the driver, from where Spark sends it to the executors.
    """
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # Spark Connect: no SparkContext; ship as a session artifact
        sc, key = None, f"connect-{spark.conf.get('spark.app.name', 'app')}-{id(spark)}"
    with _SHIP_LOCK:
        if key in _SHIPPED:
            return
        import zipfile
        pkg = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="suitelens-pyfiles-"), "suitelens.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(d, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        if sc is not None:
            sc.addPyFile(out)
        else:
            spark.addArtifacts(out, pyfile=True)
        _SHIPPED.add(key)


def default_parallelism(spark: SparkSession) -> int:
    """Total task slots of the cluster (falls back to the shuffle partitions setting
    where no SparkContext is reachable, e.g. Spark Connect)."""
    try:
        return max(1, spark.sparkContext.defaultParallelism)
    except Exception:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (``local``, ``local[n]``)."""
    try:
        master = spark.sparkContext.master
    except Exception:  # Spark Connect: the server's setting
        master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate files, as a fully qualified URI.

    On a cluster this is the checkpoint directory the cluster names
    (``spark.checkpoint.dir``). The context's value comes first because Spark has
    already qualified it with the file system scheme (``hdfs://...``, ``file:/...``);
    the executor-side writers need the scheme, since a bare path would mean local
    disk to them but the default file system to Spark. Only when nothing is set and
    the master is local (tests) is a private temporary folder created and registered as
    the checkpoint directory; on a cluster that raises, since each executor would write
    to its own disk and a scan would see a part only.
    """
    root = None
    try:
        root = spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - e.g. Spark Connect
        root = None
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster intermediate files need a folder that the "
                               "driver and all executors share")
        root = tempfile.mkdtemp(prefix="suitelens-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


def new_shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared root (never reused; only ``sinks.files.remove_shared_dir`` clears one)."""
    return f"{shared_root(spark)}/suitelens/{name}-{uuid.uuid4().hex[:12]}"
