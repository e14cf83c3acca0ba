"""The chunk table: lookups, merges and snapshot differences on plain Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(chunks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The chunks of the ids, each with score 0."""
    return chunks.join(ids.select(key).distinct(), key).withColumn("score", F.lit(0.0))


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace stored ones of their id."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def delete(stored: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def snapshot_difference(old: DataFrame, new: DataFrame, key: str = "id", digest: str = "content_hash") -> DataFrame:
    """(key, status): added, changed, removed or unchanged."""
    both = old.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_in_old")).join(new.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_in_new")), key, "full")
    status = (
        F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    )
    return both.select(key, status.alias("status"))


def to_embed(new: DataFrame, stored: DataFrame, key: str = "id", digest: str = "content_hash") -> DataFrame:
    """New rows whose content differs from what is stored under their id."""
    return new.join(stored.select(key, digest), [key, digest], "left_anti")


def obsolete(stored: DataFrame, changed_files: DataFrame, new: DataFrame, key: str = "id", file: str = "file") -> DataFrame:
    """Stored rows of changed files whose id was not made again."""
    return stored.join(changed_files.select(file).distinct(), file, "left_semi").join(new.select(key), key, "left_anti")


def counters(difference: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return difference.agg(
        is_("added").alias("added"), is_("changed").alias("changed"), is_("removed").alias("removed"), is_("unchanged").alias("skipped"),
        (is_("added") + is_("changed")).alias("embedded"),
    )


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def callers_changed(old: DataFrame, new: DataFrame, key: str = "id", callers: str = "called_by") -> DataFrame:
    """Rows whose set of callers differs from the stored one."""
    return new.join(old.select(key, F.col(callers).alias("_old")), key).where(~same_set(F.col(callers), F.col("_old"))).drop("_old")


def probe_cache(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Texts with what the cache holds for their MD5 and whether it does."""
    return texts.withColumn("text_md5", F.md5(text)).join(cache.withColumn("cached", F.lit(True)), "text_md5", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def repo_profile(chunks: DataFrame, classes: int = 20, functions: int = 30, imports: int = 15) -> DataFrame:
    """(repo_id, profile): the first classes, functions and imports of each repository, in the order of files and lines."""
    from pyspark.sql import Window

    def first(rows: DataFrame, value: str, n: int, label: str) -> DataFrame:
        once = rows.groupBy("repo_id", value).agg(F.min(F.struct("file", "line_start", "id")).alias("at"))
        order = Window.partitionBy("repo_id").orderBy("at")
        top = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
        return top.groupBy("repo_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", value))), lambda x: x[value]), ", ").alias(label))

    named = first(chunks.where("type = 'class'"), "name", classes, "classes").join(first(chunks.where("type <> 'class'"), "name", functions, "functions"), "repo_id", "full")
    whole = named.join(first(chunks.select("repo_id", "file", "line_start", "id", F.explode("imports").alias("module")), "module", imports, "imports"), "repo_id", "full")
    line = lambda c: F.concat(F.lit(f"{c.capitalize()}: "), F.coalesce(c, F.lit("")))
    return whole.select("repo_id", F.concat_ws("\n", line("classes"), line("functions"), line("imports")).alias("profile"))
