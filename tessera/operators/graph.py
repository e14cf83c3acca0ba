"""The call graph: inversion, name resolution, bounded expansion, explorer edges, call order.

``chunks`` has id, name, file, type and the arrays calls and called_by.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import bare_name, is_production, owner
from tessera.session import stored


def invert(chunks: DataFrame, *, qualified: bool = False) -> DataFrame:
    """(id, called_by): sorted distinct names of the chunks that call each chunk.

    A call that names a class also counts for its constructor. With ``qualified``, bare calls reach methods too.
    """
    calls = chunks.select(F.col("name").alias("caller"), F.explode("calls").alias("callee")).distinct()
    named = chunks.select("id", "name", "type")
    direct = calls.join(named, F.col("callee") == F.col("name")).select("id", "caller")
    classes = named.where("type = 'class'").select(F.col("name").alias("class"), F.concat("name", F.lit(".__init__")).alias("init")).distinct()
    built = calls.join(classes, F.col("callee") == F.col("class")).join(named.select("id", "name"), F.col("init") == F.col("name")).select("id", "caller")
    edges = direct.unionByName(built)
    if qualified:
        methods = named.where(F.col("name").contains(".")).select("id", bare_name(F.col("name")).alias("bare"))
        edges = edges.unionByName(calls.join(methods, F.col("callee") == F.col("bare")).select("id", "caller"))
    return edges.groupBy("id").agg(F.array_sort(F.collect_set("caller")).alias("called_by"))


def resolve(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request, id, tier): the chunks that a name at a call site stands for, each at its narrowest scope.

    ``requests`` has request, file, current (the calling chunk's name) and callee. Scopes: 1 the same file by
    exact name, 2 that name anywhere, 3 the caller's own class, 4 a suffix of a qualified name in the file, 5 such
    a suffix anywhere if nothing was found before, 6 the constructor of a class that was found. A suffix match is an
    equi-join: every name is listed under each of its dotted endings.
    """
    known = chunks.select("id", "name", F.col("file").alias("_file"), "type")
    parts = F.split("name", r"\.")
    endings = known.where(F.size(parts) > 1).select(
        "id", "_file", "type", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("ending")
    )
    exact = requests.join(known, F.col("callee") == F.col("name"))
    own = requests.withColumn("_own", F.concat(owner(F.col("current")), F.lit("."), F.col("callee")))
    suffix = requests.join(endings, F.col("callee") == F.col("ending"))
    row = ["request", "callee", "id", "type"]
    near = (
        exact.select(*row, F.when(F.col("file") == F.col("_file"), 1).otherwise(2).alias("tier"))
        .unionByName(own.join(known, F.col("_own") == F.col("name")).select(*row, F.lit(3).alias("tier")))
        .unionByName(suffix.where(F.col("file") == F.col("_file")).select(*row, F.lit(4).alias("tier")))
    )
    far = suffix.select(*row, F.lit(5).alias("tier")).join(near.select("request", "callee").distinct(), ["request", "callee"], "left_anti")
    found = near.unionByName(far.select(*near.columns))
    inits = found.where("type = 'class'").select("request", "callee", F.concat("callee", F.lit(".__init__")).alias("_init")).distinct()
    built = inits.join(known, F.col("_init") == F.col("name")).select(*row, F.lit(6).alias("tier"))
    return found.unionByName(built).groupBy("request", "callee", "id").agg(F.min("tier").alias("tier"))


def neighbour_edges(chunks: DataFrame, direction: str = "both", *, anchored: bool = False, of: DataFrame | None = None) -> DataFrame:
    """(src, dst, tier, name): resolved neighbours of every chunk that isn't a class (or of those whose id is in ``of``), tests and
    examples left out."""
    sides = {"callees": ["calls"], "callers": ["called_by"], "both": ["calls", "called_by"]}[direction]
    callers = chunks.where("type <> 'class'")
    if of is not None:
        callers = callers.join(of.select("id").distinct(), "id", "left_semi")
    named = F.flatten(F.array(*[F.coalesce(side, F.array().cast("array<string>")) for side in sides]))
    asked = callers.select(F.col("id").alias("request"), "file", F.col("name").alias("current"), F.explode(named).alias("callee")).distinct()
    found = resolve(asked, chunks)
    allowed = chunks.where(is_production(F.col("file"), anchored)).select("id")
    return found.join(allowed, "id", "left_semi").select(F.col("request").alias("src"), F.col("id").alias("dst"), "tier", F.col("callee").alias("name"))


def expand(
    seeds: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], depth: int = 1, max_expanded: int | None = 15,
    keep: Callable[[DataFrame], DataFrame] = stored,
) -> DataFrame:
    """(question, id, graph_distance, graph_score): breadth-first from each question's seeds.

    ``seeds`` has (question, id, score, pos). A neighbour's score is its parent's less 0.05, not below 0; the first
    visit wins, in the order of the parent, then scope, name and id. The cap on added rows is tested after each one is
    added, so every hop may add one row even where the cap is reached. One join for each hop, all questions at once;
    ``keep`` writes what a hop reached, as the next ones read it several times. ``edges``
    may be a function of the frontier, which then resolves only that. Where seeds have a direction, so
    have the edges and must share it; where seeds have a depth, it bounds their own hops.
    """
    carried = [c for c in ("direction", "depth") if c in seeds.columns]
    reached = keep(seeds.select("question", *carried, "id", F.lit(0).alias("graph_distance"), F.col("score").cast("double").alias("graph_score"), F.col("pos").cast("long").alias("pos")))
    frontier = reached
    for hop in range(1, depth + 1):
        start = frontier.withColumnRenamed("id", "src")
        if "depth" in carried:
            start = start.where(F.col("depth") >= hop)
        step = start.join(edges(frontier) if callable(edges) else edges, ["src", "direction"] if "direction" in carried else ["src"]).select(
            "question", *carried, F.col("dst").alias("id"), F.lit(hop).alias("graph_distance"), F.greatest(F.round(F.col("graph_score") - 0.05, 9), F.lit(0.0)).alias("graph_score"),
            F.struct("pos", "tier", "name", "dst").alias("_by"),
        )
        # The first visit of each node: a minimum, which is taken before rows are shuffled. Without a cap its place among
        # its parent's other visits decides nothing, and numbers alone are compared.
        if max_expanded is None and not carried:
            first = step.groupBy("question", "id").agg(F.min("_by.pos").alias("_p"), F.min_by("graph_score", "_by.pos").alias("graph_score"))
            first = first.select("question", "id", F.struct(F.struct("_p", "id").alias("_by"), F.lit(hop).alias("graph_distance"), "graph_score").alias("_v"))
        else:
            first = step.groupBy("question", "id").agg(F.min(F.struct("_by", *carried, "graph_distance", "graph_score")).alias("_v"))
        new = first.join(reached.select("question", "id"), ["question", "id"], "left_anti").select("question", "id", "_v.*")
        if max_expanded is None:
            new = new.withColumn("pos", F.row_number().over(Window.partitionBy("question").orderBy("_by")).cast("long")) if hop < depth else new.withColumn("pos", F.lit(0).cast("long"))
        else:
            order = Window.partitionBy("question").orderBy("_by")
            new = new.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= max(1, max_expanded))
            taken = reached.where("graph_distance > 0").groupBy("question").agg(F.count(F.lit(1)).alias("_taken"))
            new = new.join(taken, "question", "left").where(F.col("pos") <= F.greatest(F.lit(max_expanded) - F.coalesce("_taken", F.lit(0)), F.lit(1)))
        frontier = keep(new.select("question", *carried, "id", "graph_distance", "graph_score", "pos"))
        reached = reached.unionByName(frontier)
    return reached.drop("pos", *carried)


def ordered(expanded: DataFrame) -> DataFrame:
    """With ``rank``: direct neighbours come before the seeds, then by score, then the nearer first."""
    order = Window.partitionBy("question").orderBy((F.col("graph_distance") != 1).cast("int"), F.desc("graph_score"), "graph_distance", "id")
    return expanded.withColumn("rank", F.row_number().over(order))


def explorer_edges(nodes: DataFrame) -> DataFrame:
    """(source, target): calls among the shown nodes, by name, distinct."""
    calls = nodes.select(F.col("name").alias("source"), F.explode("calls").alias("target")).distinct()
    return calls.join(nodes.select(F.col("name").alias("target")).distinct(), "target", "left_semi").select("source", "target")


def find_symbols(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, name, file, type, total): names that contain the query, one row a name, the first by id; ``total`` counts all."""
    hits = chunks.where(F.contains(F.lower("name"), F.lit(query.lower())))
    once = hits.groupBy("name").agg(F.min_by(F.struct("id", "file", "type"), "id").alias("c"))
    total = once.agg(F.count(F.lit(1)).alias("total"))
    top = once.orderBy("c.id").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("c.id", "name", "c.file", "c.type", "total")


def call_order(rows: DataFrame, hoist: tuple[str, ...] = ()) -> DataFrame:
    """Each question's chunks with ``call_pos``: depth-first from those that none of them calls, callees in order.

    A call reaches chunks by their whole or their bare name. Names in ``hoist`` come first, in its order. A question's context is a few dozen rows, walked together.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("call_pos", T.IntegerType())])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable").reset_index(drop=True)
        called_as: dict[str, list[int]] = {}
        for k, name in enumerate(group["name"]):
            for known in dict.fromkeys([name, name.rpartition(".")[2]]) if name else ():
                called_as.setdefault(known, []).append(k)
        callees = [[t for c in (calls if calls is not None else ()) for t in called_as.get(c, ())] for calls in group["calls"]]
        called = {group["id"][t] for listed in callees for t in listed}
        place: dict = {}  # by id, in the order of visits
        for root in [*(k for k, i in enumerate(group["id"]) if i not in called), *range(len(group))]:
            open_ = [root]
            while open_:
                k = open_.pop()
                if group["id"][k] not in place:
                    place[group["id"][k]] = k
                    open_ += reversed(callees[k])
        rank = {name: k for k, name in reversed(list(enumerate(hoist)))}
        order = sorted(place.values(), key=lambda k: rank.get(group["name"][k], len(hoist)))  # stable: the rest stay as visited
        at = {group["id"][k]: n for n, k in enumerate(order)}
        return group.assign(call_pos=group["id"].map(at).astype("int32"))

    return rows.groupBy("question").applyInPandas(walk, schema)


def total_edges(chunks: DataFrame) -> DataFrame:
    """One row: the number of call edges."""
    return chunks.agg(F.coalesce(F.sum(F.size(F.coalesce("called_by", F.array().cast("array<string>")))), F.lit(0)).alias("edges"))


#: The stages of a request in a web framework, first to last.
LIFECYCLE = (
    "__call__", "Flask.__call__", "wsgi_app", "Flask.wsgi_app", "request_context", "Flask.request_context", "push", "AppContext.push", "full_dispatch_request",
    "Flask.full_dispatch_request", "preprocess_request", "Flask.preprocess_request", "dispatch_request", "Flask.dispatch_request", "finalize_request", "Flask.finalize_request",
    "process_response", "Flask.process_response", "pop", "AppContext.pop", "do_teardown_request", "Flask.do_teardown_request",
)


def pages_as_chunks(pages: DataFrame) -> DataFrame:
    """Stand-in chunks for tables without code: a page calls what it links to."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1)))
    return pages.select(F.col("page_id").alias("id"), F.col("url").alias("name"), links.alias("calls"))
