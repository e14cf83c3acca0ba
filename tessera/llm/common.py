"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import session

#: Arrow batches hold whole texts here, so they are smaller than Spark's defaults (the second value of each).
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("1000", "10000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("8388608", "67108864")}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and lower the session's Arrow batch sizes (``ARROW``) where they are Spark's defaults."""
    for key, (ours, default) in ARROW.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    session.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lets Spark delete the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: what was written survives the loss of any executor and is computed once, although
    several later plans read it. The shuffle files of the work behind it go as soon as it is written, the folder
    itself with release() or at the application's end.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{session.scratch(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete the folders of staged frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path is not None:
            files, at = _folder(df.sparkSession, path)
            files.delete(at, True)


def hot_join(large: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join on one key of which ``large`` may hold very many rows.

    An adaptive plan splits the rows of a hot key only where both sides come straight from a shuffle. ``small``
    is often an aggregate that is already dealt by the key, so both sides are dealt by a hash of it instead.
    """
    dealt = small.withColumn("_other", F.xxhash64(on)).withColumnRenamed(on, "_own")
    met = large.withColumn("_hot", F.xxhash64(on)).join(dealt, (F.col("_hot") == F.col("_other")) & (F.col(on) == F.col("_own")), how)
    return met.select(*large.columns, *([] if "semi" in how or "anti" in how else [c for c in small.columns if c != on]))


def trim() -> None:
    """Give a worker's freed memory back: it is kept for later stages, beside those of other tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def passed(df: DataFrame, inputs: dict[str, Column | str], fn, fields: str, keep: list[str] | None = None) -> DataFrame:
    """Run ``fn`` over Arrow batches and keep each row beside what fn makes of it.

    ``inputs`` names the columns that fn sees: fn gets a record batch of them and returns a list of Arrow
    arrays, one for each of ``fields`` (a DDL list). An input given as a string is a text column of ``df``; where the row
    keeps it, it is read from there and sent once. The rows themselves (their columns in ``keep``, or all)
    travel as one struct, so columns of any name, clashing ones included, pass through untouched as ``_row``.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    kept = df.columns if keep is None else keep
    kinds = dict(df.dtypes)
    inside = {n: kept.index(c) for n, c in inputs.items() if isinstance(c, str) and c in kept and kinds[c] == "string"}
    beside = {n: F.col(f"`{c}`").cast("string") if isinstance(c, str) else c for n, c in inputs.items() if n not in inside}
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *[c.alias(n) for n, c in beside.items()])
    out = spark_schema(packed, fields)
    names, at = list(inputs), {n: k + 1 for k, n in enumerate(beside)}

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(out)
        for batch in batches:
            row = batch.column(0)
            seen = pa.RecordBatch.from_arrays([row.field(inside[n]) if n in inside else batch.column(at[n]) for n in names], names=names)
            arrays = [row, *fn(seen)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, made, strict=True)], names=made.names)
            del row, seen, arrays, batch
        trim()

    return packed.mapInArrow(run, out)


def spark_schema(packed: DataFrame, fields: str):
    """The schema of ``packed``'s _row followed by ``fields``."""
    from pyspark.sql import types as T

    return T.StructType([packed.schema["_row"], *T.StructType.fromDDL(fields).fields])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node of each connected component, for every node of ``links``.

    Alternates large-star and small-star steps until the edges no longer change. Each step aggregates with
    partial minima and joins on the node, where a hub's rows can be split; edges stay in the cluster and are
    staged after each round, the round before being deleted.
    """

    def star(edges: DataFrame, both: bool) -> DataFrame:
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        near = edges.unionByName(turned) if both else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        met = hot_join(near, least, "u")
        moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if both else met.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not both:
            moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    edges = staged(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        size = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if size == before or not size[0]:
            break
        before, old = size, edges
        edges = staged(star(star(old, True), False))
        release(old)
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
