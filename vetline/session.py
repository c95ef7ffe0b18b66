"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings that matter for every job in this package.  AQE re-plans shuffles
# at runtime (coalesces small partitions, splits skewed join partitions);
# the session time zone is pinned so date arithmetic is reproducible.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # JSON objects with a repeated key keep the last value (as a strict JSON
    # reader of the responses does) instead of failing to parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # checkpoint files of numbering steps are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "vetline", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, build the session with the cluster's
    own settings and pass it in; nothing here assumes local mode."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> str:
    """Session settings the operators rely on, applied to a session built
    elsewhere (a cluster's, the driver's): runtime SQL settings only."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    ship_package(spark)
    return checkpoint_dir(spark)


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package where their Python path lacks it (a
    session built elsewhere, without ``--py-files``): it is sent once as a zip."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    sc = spark.sparkContext
    if root in known or sc.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="vetline-zip-")
    with zipfile.ZipFile(os.path.join(folder, "vetline.zip"), "w") as z:
        for top, _, names in os.walk(os.path.join(root, "vetline")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(os.path.join(folder, "vetline.zip"))
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; on a cluster without one this raises, as
    a folder on one machine would lose data with that machine.  Only in local
    mode (unit tests, a laptop) a scratch folder is made.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server owns the setting
        return d or ""
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="vetline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(d)
    return d


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at ``path`` (or matches it) in its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in ``folder``; none where there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
