"""Structured Streaming forms: the answer cache with state, first sightings, change feeds, stage latency by window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.operators.tracing import ANSWER_SECONDS


def cache_hits(asked: DataFrame, seconds: int = ANSWER_SECONDS) -> DataFrame:
    """(key, ts, hit) of a stream of requests (key string, ts): the state of a key is the time of its last write."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        written = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        hits = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            hit = written is not None and now - written < seconds
            written = written if hit else now
            hits.append(hit)
        state.update((written,))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "hit": hits})

    return asked.groupBy("key").applyInPandasWithState(walk, "key string, ts timestamp, hit boolean", "written double", "append", "NoTimeout")


def first_texts(texts: DataFrame) -> DataFrame:
    """A text is embedded the first time it is seen; its MD5 is the state."""
    return texts.withColumn("text_md5", F.md5("text")).dropDuplicates(["text_md5"])


def upsert_feed(changes: DataFrame, path: str, key: str = "id", at: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each micro-batch into the Parquet table at ``path``, in turns of two folders.

    Of several rows of a key in a batch the one of the greatest ``at`` counts (by default the greatest row), so a batch that is run again gives the same table. The state after batch n is in folder n % 2, so a batch that is run again reads what it read before.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        row = F.struct(*[c for c in batch.columns if c != key])
        new = batch.groupBy(key).agg(F.max_by(row, F.struct(F.col(at), row) if at else row).alias("_r")).select(key, "_r.*").select(*batch.columns)
        merged = new if number == 0 else store.upsert(spark.read.parquet(f"{path}/{(number + 1) % 2}"), new, key)
        merged.write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return merge


def stage_latency(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """An extension: latency of each stage by tumbling window; rows later than ``late`` are dropped."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_ms")).select("window.start", "event_type", "n", "mean_ms")
