"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # methods over 8 KB of bytecode are never JIT-compiled; split them instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cpus: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("caseweave")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a scratch folder; a cluster must
    name one, as a machine-local folder would not survive a lost executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get()


def rebalanced(df: DataFrame, by: str) -> DataFrame:
    """Rows of a value of ``by`` together, in parts of the advised size: small values share none of their files with others,
    a value with a third of all rows is split at run time."""
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({by}) */ * FROM {{rows}}", rows=df)


def _write(df: DataFrame, by: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), f"cut-{uuid.uuid4().hex}")
    if by:
        rebalanced(df, by).write.mode("overwrite").partitionBy(by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back, so lost executors cost no recomputation.

    A written table rather than ``checkpoint()``: columnar, prunable, and its
    size is known to the planner when it picks join strategies.
    """
    return _write(df)[0]


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path, for any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate files below the shared one."""
    fs, hadoop = filesystem(spark, path)
    fs.delete(hadoop, True)


class Rounds:
    """Tables of an iteration: ``next`` writes a round and drops the one before the last."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def next(self, df: DataFrame) -> DataFrame:
        out, path = _write(df)
        self.paths.append(path)
        if len(self.paths) > 2:
            fs, old = filesystem(self.spark, self.paths.pop(0))
            fs.delete(old, True)
        return out

    def drop(self) -> None:
        """Drops the tables that are left."""
        for path in self.paths:
            drop_folder(self.spark, path)
        self.paths = []


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors once per application, as --py-files would; for code that runs in Python there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "caseweave-package.zip")          # read by the driver alone
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


_stages: dict[tuple, tuple[DataFrame, str]] = {}


def fingerprint(spark: SparkSession, source: str) -> int:
    """Of the files below a folder: names, lengths and times, so that new data is not taken for the old."""
    fs, path = filesystem(spark, source)
    found, files = [], fs.listFiles(path, True) if fs.exists(path) else None
    while files is not None and files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


def stage(spark: SparkSession, name: str, source: str, build, by: str | None = None) -> DataFrame:
    """Materialise a named intermediate table once per application, input folder and content of the folder.

    ``by`` names a column of few values: one folder per value, so that filters on it prune whole folders."""
    key = (spark.sparkContext.applicationId, source, fingerprint(spark, source), name)
    if key in _stages:
        fs, path = filesystem(spark, _stages[key][1])
        if not fs.exists(path):                 # swept away: build it again
            del _stages[key]
    if key not in _stages:
        _stages[key] = _write(build(), by)
    return _stages[key][0].alias(name)


def forget_stages() -> None:
    """Drop the memo, so that the next query recomputes from the source tables."""
    _stages.clear()
