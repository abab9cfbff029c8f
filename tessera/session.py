"""Session helpers.

Cluster deployments bring their own session; these helpers only fill in
settings the library relies on and that are unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the operators are designed around.  They are applied with
# ``setdefault`` semantics so a cluster's own values win.
LIBRARY_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tiles are up to a few MiB each: bound Arrow batches by bytes, not rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.session.timeZone": "UTC",
}
# One BLAS thread per Python worker: Spark already runs one task per core.
WORKER_ENV = {f"spark.executorEnv.{k}": "1" for k in
              ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session for tests, bench and local use."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(LIBRARY_CONF)
    conf.update(WORKER_ENV)
    conf.update({
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "16g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    })
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_library_conf(spark)
    return spark


def apply_library_conf(spark: SparkSession) -> None:
    """Set library defaults on an existing session where they are unset."""
    for k, v in LIBRARY_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    ship_package(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: tile
    kernels run there and import it, whatever the workers' own path is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A local session without one (tests) gets a scratch folder.  On a cluster
    a folder of one machine would lose rows, so there it must be set.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
