"""Session helpers: settings, sending the package to executors, tables in the shared folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine is meant to run under; a session's own values stay.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "corpuslake", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | conf).getOrCreate()


#: Bytes of an Arrow batch on its way to a Python worker; both sides hold several batches of each task at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session are small, unless it has a bound of its own."""
    name, limit = BATCH_BYTES
    if name not in spark.conf.getAll:
        spark.conf.set(name, limit)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_corpuslake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        target = os.path.join(tempfile.mkdtemp(prefix="corpuslake-"), "corpuslake.zip")  # the driver's; executors fetch it from there
        with open(target, "wb") as out:
            out.write(data.getvalue())
        sc.addPyFile(target)
    sc._corpuslake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master (tests) may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = getattr(sc, "_corpuslake_dir", None)
        if where is None:
            where = sc._corpuslake_dir = "file://" + tempfile.mkdtemp(prefix="corpuslake-shared-")
    return where.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remember(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if not hasattr(sc, "_corpuslake_paths"):
        sc._corpuslake_paths = []
    sc._corpuslake_paths.append(path)


def sweep(spark: SparkSession) -> int:
    """Delete the tables that this application has stashed, once their results have been written; how many there were."""
    sc = spark.sparkContext
    paths, sc._corpuslake_paths = getattr(sc, "_corpuslake_paths", []), []
    for p in paths:
        where = sc._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
