"""Session helpers: a local session for tests and tools, and the
checkpoint folder rule (use the cluster's ``spark.checkpoint.dir``; only a
local session without one gets a scratch folder)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "preflight",
              shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a scratch one only for a local
    session that has none (tests).  A cluster must name a shared folder in
    ``spark.checkpoint.dir``; a machine-local folder would not survive the
    loss of an executor."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for lineage "
            "checkpoints (a machine-local folder does not survive executor loss)")
    scratch = tempfile.mkdtemp(prefix="preflight-ckpt-",
                               dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark, label: str) -> str:
    """A new folder name under the checkpoint folder, remembered until it is
    deleted."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/preflight-{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_files(spark) -> list[str]:
    """The session's folders that have not been deleted, oldest first."""
    return list(_SCRATCH.get(spark.sparkContext.applicationId, ()))


def delete_scratch(spark, paths) -> None:
    """Delete folders of ``scratch_files`` that nothing reads any more."""
    known = _SCRATCH.get(spark.sparkContext.applicationId, [])
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if p in known:
            known.remove(p)


def materialize(df, label: str = "stage", count: bool = False, size=None):
    """Cut lineage by writing ``df`` as parquet under the checkpoint folder
    and reading it back: computed once (a reliable ``checkpoint()`` of an
    uncached frame computes it twice), and the files are in the shared
    folder, so a lost executor loses nothing.

    With ``count=True`` returns ``(frame, rows)``, with a column ``size``
    ``(frame, rows, sum of size)``; both are observed while writing
    (``DataFrame.observe``), not by a second job."""
    import uuid

    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    if count or size is not None:
        obs = Observation(f"{label}-{uuid.uuid4().hex[:8]}")
        total = F.sum(size if size is not None else F.lit(0))
        df.observe(obs, F.count(F.lit(1)).alias("rows"), total.alias("size")).write.mode("overwrite").parquet(path)
        out = spark.read.schema(schema).parquet(path)
        return (out, int(obs.get["rows"])) if size is None else (out, int(obs.get["rows"]), int(obs.get["size"] or 0))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(frames) -> None:
    """Delete the files of materialized frames that are no longer read."""
    for df in frames:
        delete_scratch(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/preflight-" in f})


def size_setting(spark, key: str, default: int) -> int:
    """Bytes of a size setting (``10485760``, ``10485760b``, ``64MB``, ``1k``)."""
    import re

    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)(i?b)?\s*", str(spark.conf.get(key, str(default))).lower())
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ") if m else default
