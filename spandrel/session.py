"""Session helpers: table loading and the shared folder for cut lineage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "spandrel", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the library is written for (UTC, AQE, ANSI)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**settings, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode alone."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage like checkpoint(), survives lost executors, and stays
    columnar and compressed. ``release`` removes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spandrel_path = path
    return out


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are gone, which else stay until the driver happens to collect its garbage.

    Spark keeps hold of what it ran last, so something else of the same kind runs first.
    """
    spark.range(4).repartition(4).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames made by ``materialize`` (others are ignored)."""
    for df in frames:
        path = getattr(df, "_spandrel_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
