"""What every operator here needs from the cluster: shared scratch tables, inputs, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session

__all__ = ["Scratch", "read", "ship", "with_ids", "without_ids"]

#: Ids (longs) that a broadcast may hold: about 50 MB as a hash relation.
BROADCAST_IDS = 1 << 21
#: Bytes of rows that go to or from a Python worker at once, about; a worker and its JVM hold a few times that.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """The package on the executors, and for this session batches of at most BATCH_BYTES, where a larger size was set."""
    session.ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


class Scratch:
    """Tables in the folder that the cluster names in spark.checkpoint.dir; lineage ends at each of them.

    Where the setting is absent in a local session, as in tests, a temporary folder is used; on a cluster
    its absence is an error, since other machines would not see that folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.paths: dict[str, str] = {}
        self.tables: dict[str, str] = {}
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a Parquet table and return a DataFrame that reads it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """The same as a table bucketed by `key`: joins on it later do not shuffle this side again."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"tidemark_{name.replace('-', '_')}_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, key).option("path", f"{self.root}/{name}").saveAsTable(table)
        self.paths[name], self.tables[name] = f"{self.root}/{name}", table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            if table := self.tables.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name, f"{self.root}/{name}"))
            path.getFileSystem(conf).delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which the result still reads."""
        self.drop(*(n for n in list(self.paths) if n not in names))


def _by_id(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), key, how)


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among ids (distinct longs): without a shuffle of df while these are few."""
    return _by_id(df, ids, key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The other rows of df."""
    return _by_id(df, ids, key, "left_anti")


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one input table, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
