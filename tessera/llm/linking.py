"""Links and classes among the members of candidate groups, by exact similarity of their item sets.

A group (band) has any number of keys. Small groups are compared whole inside a task. The keys of large ones meet
one centre first; what is in several classes still is divided again by its members' rarest items, and only
what can't be divided goes in pairs of blocks. All of it is exact: no pair of a group is passed over unless sizes,
rare items or the classes found so far rule it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hot_join, release, staged, trim

#: Items of all members of a group that one task holds (8 bytes each), and of a block of a larger group.
GROUP_ITEMS = 1 << 20
#: Members that meet a copy of their centre in one run.
RUN = 500
LINK = "a {0}, b {0}, similarity double"


def heads(n: int, least: float) -> int:
    """Of two sets alike by ``least`` or more, each has one of their common items among so many of its first, in any order of all items."""
    return n - ceil(least * n - 1e-9) + 1


def pairs_of(items: list[np.ndarray], class_: list, least: float, own: list[int] | None = None) -> Iterator[tuple[int, int, float]]:
    """Links (i, j, similarity) that join all members alike by ``least`` or more into classes, ``class_`` being known.

    Members come by size; each is looked up under its rarest items only. Members of one class are never compared,
    nor, with ``own``, those of one block.
    """
    size = np.array([len(x) for x in items])
    _, code, often = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    code = rank[code]  # rare items first
    often = np.sort(often)
    starts = np.concatenate([[0], np.cumsum(size)])
    first: dict = {}
    parent = [first.setdefault(c, k) for k, c in enumerate(class_)]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    listed: dict[int, list[int]] = {}
    mark = np.zeros(len(often), bool)
    for i in np.argsort(size, kind="stable").tolist():
        mine = code[starts[i] : starts[i + 1]]
        n = len(mine)
        head = np.sort(mine)[: heads(n, least)]
        head = head[often[head] > 1].tolist()
        met = {j for c in head for j in listed.get(c, ())}
        if met:
            mark[mine] = True
            for j in met:
                if size[j] < least * n or (own is not None and own[i] == own[j]) or root(i) == root(j):
                    continue
                both = int(np.count_nonzero(mark[code[starts[j] : starts[j + 1]]]))
                if both / (n + size[j] - both) >= least:
                    parent[root(i)] = root(j)
                    yield i, j, both / (n + int(size[j]) - both)
            mark[mine] = False
        for c in head:
            listed.setdefault(c, []).append(i)


def _links(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((kind, kind, pa.float64()))], names=["a", "b", "similarity"])


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as views."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    at = at - at[0]
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def compared(rows: DataFrame, names: list[str], least: float) -> DataFrame:
    """Links inside the groups of ``rows`` (the columns ``names``, own, key, class, items), each in one task."""

    def run(batches):
        group: list[tuple] = []
        kind = None

        def done() -> list[tuple]:
            own = [g[1] for g in group]
            found = pairs_of([g[4] for g in group], [g[3] for g in group], least, own if len(set(own)) > 1 else None)
            return [(*sorted((group[i][2], group[j][2])), s) for i, j, s in found]

        for batch in batches:
            out = []
            kind = batch.schema.field("key").type
            keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            for row in zip(keys, *(batch.column(n).to_pylist() for n in ("own", "key", "class")), _arrays(batch.column("items")), strict=True):
                if group and row[0] != group[0][0]:
                    out += done() if len(group) > 1 else []
                    group = []
                group.append(row)
            yield _links(out, kind)
        if len(group) > 1:
            yield _links(done(), kind)
        trim()

    laid = rows.repartition(*names).sortWithinPartitions(*names).select(*names, "own", "key", "class", "items")
    return laid.mapInArrow(run, LINK.format(rows.schema["key"].dataType.simpleString()))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs (centre, key), those of similarity ``least`` or more.

    The pairs of a centre are dealt out in runs of some RUN members, each with a copy of the centre, so no task
    holds a large group and no set is moved more often than it has centres.
    """
    runs = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    member = hot_join(pairs.select("centre", "key"), runs, "centre").select("centre", F.pmod(F.xxhash64("key"), F.col("runs")).cast("int").alias("run"), F.lit(1).alias("is_member"), "key")
    centre = runs.select("centre", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("is_member"), F.col("centre").alias("key"))
    dealt = member.unionByName(centre).join(sets.select("key", "items"), "key")
    laid = dealt.repartition("centre", "run").sortWithinPartitions("centre", "run", "is_member").select("centre", "run", "is_member", "key", "items")

    def run(batches):
        at, middle = None, None
        for batch in batches:
            out = []
            for centre, turn, is_member, key, items in zip(*(batch.column(k).to_pylist() for k in range(4)), _arrays(batch.column(4)), strict=True):
                if not is_member:
                    if at != (centre, turn):
                        at, middle = (centre, turn), items
                    continue
                small, large = sorted((len(middle), len(items)))
                if small >= least * large:
                    both = len(np.intersect1d(middle, items, assume_unique=True))
                    if both / (small + large - both) >= least:
                        out.append((centre, key, both / (small + large - both)))
            yield _links(out, batch.schema.field("key").type)
        trim()

    return laid.mapInArrow(run, LINK.format(sets.schema["key"].dataType.simpleString()))


def _classed(near: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``near`` with each key's class, and only the bands that hold several."""
    if labels is None:
        classed = near.withColumn("class", F.col("key"))
    else:
        known = labels.select(F.col("node").alias("key"), F.col("component").alias("class"))
        classed = near.drop("class").join(known, "key", "left").withColumn("class", F.coalesce("class", "key"))
    weighed = classed.groupBy("band").agg(F.min("class").alias("_lo"), F.max("class").alias("_hi"), F.sum("size").alias("weight"))
    return staged(hot_join(classed, weighed.where("_lo <> _hi").select("band", "weight"), "band"))


def divided(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The groups (band, key, class, size, weight) cut into smaller ones that keep every pair alike by ``least`` together.

    Inside a band, items are ordered by how many members have them; a member goes to a new group for each of its
    rarest items (as many as heads() asks for) that another member has too.
    """
    items = rows.select("band", "key").join(sets.select("key", "items"), "key").select("band", "key", F.explode("items").alias("item"))
    items = staged(items.withColumn("place", F.xxhash64("band", "item")))
    often = items.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    listed = hot_join(items, often, "place").groupBy("band", "key").agg(F.sort_array(F.collect_list(F.struct("n", "place"))).alias("all"))
    first = F.size("all") - F.ceil(F.size("all") * F.lit(least) - 1e-9).cast("int") + 1
    cut = listed.select("band", "key", F.explode(F.slice("all", F.lit(1), first)).alias("one")).where("one.n > 1")
    made = cut.join(rows.select("band", "key", "class", "size"), ["band", "key"]).select(F.col("one.place").alias("band"), "key", "class", "size")
    weighed = made.groupBy("band").agg(F.min("class").alias("_lo"), F.max("class").alias("_hi"), F.sum("size").alias("weight"))
    out = staged(hot_join(made, weighed.where("_lo <> _hi").select("band", "weight"), "band"))
    release(items)
    return out


def in_blocks(rows: DataFrame, sets: DataFrame, least: float, block: int = GROUP_ITEMS) -> DataFrame:
    """Links inside groups (band, key, class, size, weight) of any size: each is dealt into blocks of about
    ``block`` items, and a task gets two blocks (or one)."""
    blocks = F.ceil(F.col("weight") / block).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key", "class")
    return compared(dealt.join(sets.select("key", "items"), "key"), ["band", "lo", "hi"], least)


def linked(multi: DataFrame, sets: DataFrame, least: float, *, centre_from: int = 0, group: int = GROUP_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(links, labels): links (a, b, similarity) that connect all alike among the (band, key, size) rows of ``multi``,
    and the (node, component) that they make. ``sets`` has (key, items), the distinct items of a key, ``size`` many.

    Bands with the same members are compared once. Members of bands of over ``centre_from`` items meet one centre first, the
    one with most company; pairs inside a class are never looked at again.
    """
    census = multi.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.bit_xor(F.xxhash64("key")).alias("all")
    ).where("lo <> hi")
    once = staged(census.groupBy("n", "weight", "lo", "hi", "all").agg(F.min("band").alias("band")).select("band", "n", "weight"))
    near = staged(hot_join(multi.select("band", "key", "size"), once, "band"))
    links, labels = [], None
    crowded = near.where(F.col("weight") > centre_from)
    if not crowded.isEmpty():
        degree = crowded.groupBy("key").agg(F.sum("n").alias("degree"))
        centres = crowded.join(degree, "key").groupBy("band").agg(F.min(F.struct((-F.col("degree")).alias("by"), "key")).alias("c"))
        tried = hot_join(crowded.select("band", "key"), centres.select("band", F.col("c.key").alias("centre")), "band").where("key <> centre").select("centre", "key").distinct()
        links.append(staged(verified(staged(tried), sets, least)))
        labels = staged(components(links[0]))
    rest = _classed(near.select("band", "key", "size"), labels)
    small = rest.where(F.col("weight") <= group).join(sets.select("key", "items"), "key").withColumn("own", F.lit(0))
    links.append(staged(compared(small, ["band"], least)))
    large = rest.where(F.col("weight") > group)
    if not large.isEmpty():
        cut = divided(large, sets, least)
        links.append(staged(in_blocks(cut, sets, least, group)))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    labels = staged(components(found))
    release(near, rest)
    return found, labels

