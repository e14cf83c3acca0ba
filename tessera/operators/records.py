"""Small keyed tables beside the chunks: repositories, their profiles and status, pending changes, cached answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import store

#: (repo_id, url, branch, status, chunks, files, updated_at), one row a repository.
REPOSITORY = "repo_id string, url string, branch string, status string, chunks long, files long, updated_at timestamp"
#: What a repository can be while it is read.
STATES = ("ingesting", "done", "failed")


def put(records: DataFrame, new: DataFrame, key: str = "repo_id") -> DataFrame:
    """The table with ``new`` written over its keys; of several new rows of a key the newest (updated_at) counts."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), "updated_at").alias("_r")).select(key, "_r.*")
    return store.upsert(records, last.select(*records.columns), key)


def get(records: DataFrame, ids: DataFrame, key: str = "repo_id") -> DataFrame:
    return records.join(ids.select(key).distinct(), key)


def without(records: DataFrame, ids: DataFrame, key: str = "repo_id") -> DataFrame:
    return store.delete(records, ids, key)


def status(records: DataFrame) -> DataFrame:
    """(repo_id, status): what a poll is told; a state that isn't known counts as failed."""
    return records.select("repo_id", F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("failed").alias("status"))


def profiles(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Requests with their repository's profile, empty where there is none."""
    return asked.join(known.select("repo_id", "profile"), "repo_id", "left").withColumn("profile", F.coalesce("profile", F.lit("")))


def pending(applies: DataFrame, repo_ids: DataFrame, now: Column) -> DataFrame:
    """Changes of the repositories that wait for review and haven't expired, newest first."""
    waiting = applies.where((F.col("status") == "pending_review") & (F.col("expires_at") > now))
    return waiting.join(repo_ids.select("repo_id").distinct(), "repo_id", "left_semi").orderBy(F.desc("expires_at"), "apply_id")


def invalidated(answers: DataFrame, synced: DataFrame) -> DataFrame:
    """Cached answers (repo_id, written_at, ...) that outlive a sync (repo_id, synced_at): those written after it."""
    last = synced.groupBy("repo_id").agg(F.max("synced_at").alias("_at"))
    return answers.join(last, "repo_id", "left").where(F.col("_at").isNull() | (F.col("written_at") > F.col("_at"))).drop("_at")


def as_json(rows: DataFrame, key: str = "question") -> DataFrame:
    """(key, body): each row as a JSON response."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("body"))
