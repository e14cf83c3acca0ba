"""Source trees as DataFrames, and differences between snapshots of them."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no sources, and the largest file that is read.
SKIPPED = frozenset({".git", "__pycache__", "node_modules", "venv", ".venv", "env", "dist", "build"})
LARGEST = 500_000


def python_paths(root: str) -> list[str]:
    """Relative paths of Python files under ``root``, sorted; files whose names begin with an underscore too."""
    found = []
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if d not in SKIPPED)
        found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names if n.endswith(".py")]
    return sorted(found)


def scan_python_files(spark: SparkSession, root: str, largest: int = LARGEST) -> DataFrame:
    """(path, content) of Python files up to ``largest`` bytes; bytes that aren't UTF-8 are replaced.

    Spark's own file sources skip names that begin with an underscore, such as package markers, so only the
    list of paths is made on the driver; the files, on a folder that all executors see, are read by the tasks.
    """
    paths = spark.createDataFrame([(p,) for p in python_paths(root)], "path string")
    paths = paths.repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, paths.count() // 50 + 1)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                whole = os.path.join(root, path)
                if os.path.getsize(whole) <= largest:
                    with open(whole, "rb") as f:
                        rows.append((path, f.read().decode("utf-8", errors="replace")))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return paths.mapInPandas(read, "path string, content string")


def snapshot(files: DataFrame) -> DataFrame:
    return files.select("path", F.md5("content").alias("content_hash"))


def changed_files(old: DataFrame, new: DataFrame, suffix: str | None = ".py") -> DataFrame:
    """(path, status) of files that were added, changed or removed between two snapshots."""
    from tessera.operators.store import snapshot_difference

    out = snapshot_difference(old, new, key="path").where("status <> 'unchanged'")
    return out if suffix is None else out.where(F.endswith("path", F.lit(suffix)))
