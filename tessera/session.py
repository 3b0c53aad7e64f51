"""Session construction and the small settings every plan relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time.

    Cluster settings (executor sizes, shuffle partitions, ``spark.checkpoint.dir``)
    are left to the deployment; ``conf`` overrides anything here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder: the plan starts anew there and survives lost executors.

    The folder is ``spark.checkpoint.dir``; only where that is unset (one machine, tests) a local one is named.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or "/tmp/checkpoints")
    return df.checkpoint()
