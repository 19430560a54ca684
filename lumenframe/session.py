"""The session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Semantics, not tuning: they are set on any session the engine is given.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Sets what results depend on; partition counts and memory stay the cluster's."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for one machine, with a few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lumenframe")
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **SEMANTICS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
