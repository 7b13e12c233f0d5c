"""Spark session defaults and the shared checkpoint folder.

Every operator in the package takes and returns DataFrames; the session only
pins the settings the semantics rely on (UTC instants) and the adaptive
execution features the plans are designed around (AQE partition coalescing,
skew-join splitting, runtime broadcast re-planning).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in the package assumes.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_LOCAL_CKPT: str | None = None


def build_session(
    master: str | None = None,
    app_name: str = "encore",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or fetch) a session with the package defaults applied.

    On a cluster leave ``master`` unset so spark-submit decides, and size
    ``shuffle_partitions`` to the data (roughly input bytes / 128 MB); tests
    pass ``local[*]`` and a handful of partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # getOrCreate() may hand back an existing session: re-apply SQL settings.
    for key, value in conf.items():
        if key.startswith("spark.sql.") and key != "spark.sql.execution.arrow.pyspark.enabled":
            try:
                spark.conf.set(key, value)
            except Exception:  # static conf of an already running session
                pass
    spark.sparkContext.setLogLevel("WARN")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in executor Python workers (like ``--py-files``).

    Pandas UDFs defined in this package are pickled by reference, so workers
    need the package; it is zipped once per SparkContext and added with
    ``addPyFile``, which distributes it to every executor.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="encore-pyfiles-")
    zip_path = os.path.join(out_dir, "encore.zip")
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    rel = os.path.relpath(full, os.path.dirname(pkg_dir))
                    zf.write(full, rel)
    sc.addPyFile(zip_path)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name one: a folder of the driver's machine is not the
    executors'. Only a local master without one gets a private folder.
    """
    global _LOCAL_CKPT
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _LOCAL_CKPT is None:
            _LOCAL_CKPT = tempfile.mkdtemp(prefix="encore-ckpt-")
        path = _LOCAL_CKPT
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written tables)."""
    return os.path.join(checkpoint_dir(spark), *parts)


def written_at(df: DataFrame, *parts: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table under the shared checkpoint folder, read back, and its folder: computed once, lineage ends there."""
    path = scratch_path(df.sparkSession, *parts, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, *parts: str) -> DataFrame:
    return written_at(df, *parts)[0]
