"""Session settings and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE picks broadcast or shuffle from measured sizes and splits hot join keys.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("specweave")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # one partition per core already: merging small ones would only idle cores
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def has_shared_folder(spark: SparkSession) -> bool:
    return spark.conf.get("spark.checkpoint.dir", None) is not None or spark.sparkContext.getCheckpointDir() is not None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the shared folder named by ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def shared(df: DataFrame) -> DataFrame:
    """A result that several steps read: checkpointed where a shared folder is named, else persisted."""
    return cut_lineage(df) if has_shared_folder(df.sparkSession) else df.persist()


class Kept:
    """The shared results of one run, freed at its end.

    A call writes a result to a folder of its own below ``folder`` (else the shared folder) and reads it back, so
    that a lost executor costs nothing; where there is none, it is persisted.  ``free`` removes the files::

        with Kept(spark) as keep:
            store(reconcile(..., keep=keep))
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.persisted: list[DataFrame] = []
        folder = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        self.folder = folder and f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
        self.n = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        if self.folder is None:
            self.persisted.append(df.persist())
            return self.persisted[-1]
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        for df in self.persisted:
            df.unpersist()
        self.persisted.clear()
        if self.folder is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *error: object) -> None:
        self.free()
