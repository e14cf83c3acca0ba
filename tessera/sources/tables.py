"""The chunk store on Parquet: one folder for each repository, rewritten partition by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, partition: str = "repo_id") -> None:
    """Replace only the partitions that ``chunks`` has rows of. Its plan mustn't read what it overwrites."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_chunks(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """All chunks, or one repository's: the filter prunes folders."""
    chunks = spark.read.parquet(path)
    return chunks if repo_id is None else chunks.where(chunks["repo_id"] == repo_id)


def count_chunks(spark: SparkSession, path: str, repo_id: str) -> int:
    return read_chunks(spark, path, repo_id).count()


def partition_counts(chunks: DataFrame, partition: str = "repo_id") -> DataFrame:
    """(partition, n_rows) of a store, from the folders' footers: no column of a chunk is read."""
    return chunks.groupBy(partition).count().withColumnRenamed("count", "n_rows")


def update_callers(spark: SparkSession, path: str, called: DataFrame) -> DataFrame:
    """The stored chunks with ``called_by`` replaced where ``called`` (id, called_by) has their id; to be written elsewhere."""
    new = called.withColumnRenamed("called_by", "_new")
    return spark.read.parquet(path).join(new, "id", "left").withColumn("called_by", F.coalesce("_new", "called_by")).drop("_new")


def delete_repo(spark: SparkSession, path: str, repo_id: str) -> None:
    """Drop a repository's folder through the file system that the path is on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/repo_id={repo_id}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
