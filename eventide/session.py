"""Session construction and shared scratch locations.

Scratch data (round-trip files, checkpoints, streaming state) always lives under the
checkpoint directory the cluster names in ``spark.checkpoint.dir``; a private directory
is only created when nothing is configured (local runs and tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: adaptive execution re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed join partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def cluster_conf(input_tb: float = 100.0, total_cores: int = 8000) -> dict[str, str]:
    """Settings for a large cluster run (the jobs themselves do not change).

    Shuffles start from enough partitions for ~256 MiB each at the input volume and AQE
    coalesces them down to the advisory size at run time, so a stage never has too few
    partitions to fit in executor memory or too many tiny ones; file splits stay at
    256 MiB; skewed join partitions are split when over 5× the median and 512 MiB.
    """
    initial = max(total_cores * 3, int(input_tb * 2**40 / (256 * 2**20)))
    return {
        **SCALE_CONF,
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 2**20),
        "spark.sql.files.maxPartitionBytes": str(256 * 2**20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 2**20),
        "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    }


def _driver_memory() -> str:
    """Local mode runs everything in the driver JVM: give it about half of the machine's
    memory, capped at 16 GiB, so a small container is not overcommitted."""
    import os
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    # a container's cgroup limit, when set, is the real bound
    for limit_file in ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes"):
        try:
            with open(limit_file) as f:
                raw = f.read().strip()
            if raw.isdigit():
                total = min(total, int(raw))
        except OSError:
            pass
    return f"{max(1, min(16, int(total / 2**30 * 0.5)))}g"


def build_session(master: str = "local[8]", app: str = "eventide",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", _driver_memory()))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint directory; set a private one only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="eventide-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique directory path under the checkpoint root."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/eventide/{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application. For the end of a job: results that still read
    them must be written first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet under the checkpoint root and read back, and its folder: what a batch
    uses more than once. Unlike a checkpoint it is compressed, and a reader takes only its columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`kept` once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``eventide`` importable in Python workers on every executor (``addPyFile``).

    Operators that run Python on executors (``mapInPandas``, ``applyInPandasWithState``)
    call this first; it zips the package on the driver once per SparkContext and lets
    Spark distribute it, as ``--py-files`` would.
    """
    import os
    import zipfile

    import eventide

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(eventide.__file__))
    base = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="eventide-pyfiles-"), "eventide.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, base))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
