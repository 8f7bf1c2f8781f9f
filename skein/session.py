"""Session set-up and staged tables.

``stage`` is how the library cuts lineage: it writes a DataFrame as Parquet under the
shared folder named by ``spark.checkpoint.dir`` and reads it back, so that lost executors
cost a re-read, later scans prune columns, and the optimizer knows real sizes.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # lets `row_number() <= k` filters trim rows before the shuffle up to a whole token budget
    "spark.sql.optimizer.windowGroupLimitThreshold": "8192",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # bounds the Python-side batch when rows carry long vectors or texts
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}

_SHIPPED: set[str] = set()
_LOCAL_ROOTS: dict[str, str] = {}
_STAGED: dict[tuple, DataFrame] = {}
_WRITTEN: dict[str, list[str]] = {}  # by application, what it staged


def build_session(app: str = "skein", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**_RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the plans rely on to a session made elsewhere."""
    for key, value in _RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables; a local temp folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    single = re.match(r"local(\[|$)", spark.sparkContext.master)
    if configured:
        if not single and tempfile.gettempdir() != "/" and re.match(rf"(file:/+)?{re.escape(tempfile.gettempdir().lstrip('/'))}/?$", configured.lstrip("/")):
            raise RuntimeError("spark.checkpoint.dir is this machine's own temporary folder; every executor must reach it")
        return configured.rstrip("/")
    if not single:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="skein-")
    return _LOCAL_ROOTS[app]


def staging_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the staging folder, which ``release_staged`` deletes with all others."""
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` once to the staging folder and return a scan of it; ``folders`` are columns whose values readers pick by."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    # zstd finds what a text and its copies have in common within a whole page; snappy does not
    df.write.mode("errorifexists").partitionBy(*folders).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``stage`` in buckets by ``keys``: joins on them leave these rows where they are and move the other side only."""
    spark = df.sparkSession
    table = f"skein_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{staging_root(spark)}/{table}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*frames: DataFrame) -> None:
    """Delete what ``stage`` wrote for these frames; only for tables that nothing reads any more, as in loops that write each round anew."""
    for df in frames:
        root = re.sub("^file:/*", "/", staging_root(df.sparkSession))
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.sub("^file:/*", "/", folder).startswith(root + "/"):
                delete_path(df.sparkSession, folder)


def release_staged(spark: SparkSession) -> int:
    """Delete all that this application staged, once its results are written; how many tables those were. Snapshots are built anew after it."""
    app = spark.sparkContext.applicationId
    paths = _WRITTEN.pop(app, [])
    for path in paths:
        delete_path(spark, path)
    for key in [k for k in _STAGED if k[0] == app]:
        del _STAGED[key]
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it wherever it is installed here."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        base = os.path.join(tempfile.mkdtemp(prefix="skein-package-"), "skein")
        package = os.path.dirname(os.path.abspath(__file__))
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(app)


def stage_once(spark: SparkSession, key: tuple, name: str, build) -> DataFrame:
    """``stage`` memoised per application: snapshot tables are written once, then only read."""
    full_key = (spark.sparkContext.applicationId, name, *key)
    if full_key not in _STAGED:
        _STAGED[full_key] = stage(build(), name)
    return _STAGED[full_key]


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition for Python work: few bytes per group but much work, so no coalescing by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def default_cores() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))


def spread(df: DataFrame) -> DataFrame:
    """Shuffle a scan of too few splits over all cores; a scan with enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
