"""Lineage cuts: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with over a HOT-th of all rows is hot; there are fewer than HOT of them.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder if all runs in one process, or an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lumenframe-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


class Table:
    """A written table: ``df`` reads it, ``drop()`` removes its files once nothing reads them any more."""

    def __init__(self, frame: DataFrame, label: str):
        self._spark = frame.sparkSession
        self.path = new_folder(self._spark, label)
        frame.write.parquet(self.path)
        self.df = self._spark.read.schema(frame.schema).parquet(self.path)

    def drop(self) -> None:
        sc = self._spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_keyed(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``values(key, n, ...)``, n being how many rows have the key.

    Rows of hot keys take their values from a broadcast of fewer than HOT rows; the others are
    shuffled, none of whose keys has more than a HOT-th of all rows.
    """
    most = rows.count() // HOT
    hot = F.broadcast(values.where(F.col("n") > most).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(values.where(F.col("n") <= most).drop("n"), key, "left")
    return rest.unionByName(rows.join(hot, key))


def spread(rows: DataFrame, values: DataFrame, keys: list[str], uid: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner join on ``keys`` with a further join column ``salt``.

    A key with over a HOT-th of all ``rows`` is dealt, by ``uid``, among as many copies of its values
    as keep a copy's share below that; other keys have one copy.  Neither side has null keys.
    """
    sizes = Table(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sizes").df
    most = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT)
    # Fewer than HOT rows, so the broadcasts are bounded.
    hot = Table(sizes.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).alias("salts")), "hot").df
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    one = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64(uid), salts)).drop("salts")
    other = values.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return one, other
