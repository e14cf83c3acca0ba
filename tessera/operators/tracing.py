"""Request traces: cost, latency, cache hits; and the answer cache with its fixed life."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dollars for a million tokens in and out, seconds that an answer lives in the cache.
PRICE_IN, PRICE_OUT, ANSWER_SECONDS = 0.05, 0.08, 300


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT, 6)


def requests(stages: DataFrame, chars: int = 80) -> DataFrame:
    """One row for each request of (request, stage, latency_ms, tokens_in, tokens_out, cache_hit), and the first characters of
    its query where stages have one."""
    asked = [F.substring(F.any_value("query"), 1, chars).alias("query")] if "query" in stages.columns else []
    return stages.groupBy("request").agg(
        *asked,
        F.count(F.lit(1)).alias("stages"), F.round(F.sum("latency_ms"), 3).alias("total_ms"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.round(F.sum(cost(F.col("tokens_in"), F.col("tokens_out"))), 6).alias("cost_usd"),
        F.array_sort(F.collect_set(F.when(F.col("cache_hit"), F.col("stage")))).alias("hit_stages"),
    )


def hit_rate(events: DataFrame, hit: Column) -> DataFrame:
    return events.agg(
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"),
        F.round(F.count_if(hit) * 100.0 / F.greatest(F.lit(1), F.count(F.lit(1))), 1).alias("hit_rate_pct"),
    )


def with_cache_hits(asked: DataFrame, key: list[str], at: str = "ts", seconds: int = ANSWER_SECONDS) -> DataFrame:
    """Each request with ``hit``: an answer written for its key less than ``seconds`` before is read, not renewed.

    Whether a request hits depends on the last miss, not on the last request, so keys are walked in time order.
    Rows arrive sorted by key and time and are walked as a stream: what is held is one key's last write.
    """
    life = pd.Timedelta(seconds=seconds)
    laid = asked.repartition(*key).sortWithinPartitions(*key, at)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, written = None, None
        for rows in batches:
            hits = []
            for k, ts in zip(zip(*(rows[c] for c in key), strict=True), rows[at], strict=True):
                if k != own or ts - written >= life:
                    own, written = k, ts
                    hits.append(False)
                else:
                    hits.append(True)
            yield rows.assign(hit=hits)

    from pyspark.sql import types as T

    return laid.mapInPandas(walk, T.StructType([*asked.schema.fields, T.StructField("hit", T.BooleanType())]))


def last_status(changes: DataFrame, key: str, status: str, at: Column, *, expires_seconds: int | None = None, now: Column | None = None) -> DataFrame:
    """(key, status): the newest status of each key; pending ones that are older than ``expires_seconds`` go."""
    last = changes.groupBy(key).agg(F.max_by(status, at).alias("status"), F.max(at).alias("_at"))
    if expires_seconds is not None:
        age = F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("_at.ts" if "struct" in dict(last.dtypes)["_at"] else "_at")
        last = last.where((F.col("status") != "pending_review") | (age < expires_seconds))
    return last.drop("_at")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The newest row of each key."""
    newest = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
