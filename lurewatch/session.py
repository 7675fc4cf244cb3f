"""Session helpers. The cluster's own settings always win; nothing here overrides a value already set."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench. On a cluster the session is handed in."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lurewatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
    )
    for k, v in LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    A local folder is chosen only for a local master with the setting unset (tests, bench).
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="run-lurewatch-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, group: int | None = None) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back.

    A lost executor re-reads the table and never replays what came before; the rows are computed exactly once. `group` bounds the
    bytes of a row group: a reader holds up to 4,096 rows of one at a time, which is too much where a row is a long vector.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    (df.write if group is None else df.write.option("parquet.block.size", group)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that `cut_lineage` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)  # noqa: SLF001
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001
