"""Session helpers.

Library code never builds its own session; it works on the session of the DataFrames it is
given. ``get_session`` is for tests, the bench and the demo entry point only.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "densitykit",
                checkpoint_dir: str | None = None, extra: dict | None = None) -> SparkSession:
    """Local session for tests and benches (no UI port, UTC, AQE on)."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(_LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if checkpoint_dir:
        conf["spark.checkpoint.dir"] = checkpoint_dir
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one is used. Only a
    local-mode session without the setting (tests, the smoke entry) gets a fresh temporary
    folder. A cluster session without it is an error: a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="densitykit-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder (HDFS/S3/ABFS) "
                       "so that iterative operators can cut lineage reliably")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once a context), so that functions run in Python workers
    can be loaded there without the repository on the workers' own path."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_densitykit_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="densitykit-package-"), "densitykit.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("densitykit", os.path.relpath(p, root)))
    sc.addPyFile(target)
    sc._densitykit_shipped = True


def qualified(spark: SparkSession, path: str) -> str:
    """A path (or comma-separated paths) as Spark takes it: without a scheme it is on the default file system."""
    def one(p: str) -> str:
        h = spark._jvm.org.apache.hadoop.fs.Path(p.strip())
        return h.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(h).toString()

    return ",".join(one(p) for p in path.split(",") if p.strip())


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the session's reliable checkpoint folder."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/densitykit/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df, tag: str = "stage", **metrics):
    """Cut lineage by writing ``df`` as parquet under the checkpoint folder and reading it back.

    Used in place of ``Dataset.checkpoint``: a checkpointed plan keeps the size estimate of
    the plan it came from, and in an iterative loop those estimates (products over joins)
    grow without bound; a parquet read is sized by its files, which also gives AQE true
    sizes for its join choices. The folder is on the shared checkpoint storage, so the
    result survives the loss of any executor.

    Keyword arguments name aggregate Columns computed while the rows are written (an
    ``Observation``, no second pass); then ``(df, {name: value})`` is returned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    obs = None
    if metrics:
        from pyspark.sql import Observation

        obs = Observation(tag)
        df = df.observe(obs, *[c.alias(n) for n, c in metrics.items()])
    df.write.mode("error").parquet(path)
    out = spark.read.parquet(path)
    if obs is None:
        return out
    return out, dict(obs.get)
