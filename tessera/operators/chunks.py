"""Python source files to rows: one for each function, method and class."""

from __future__ import annotations

import ast
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import chunk_id, content_hash
from tessera.session import ship

UNIT = (
    "name string, bare_name string, parent string, type string, file string, language string, line_start int, line_end int, raw_source string, "
    "docstring string, decorators array<string>, calls array<string>, imports array<string>, complexity int"
)
#: Fixed value: the nodes that add a branch.
BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.BoolOp)
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def called_names(node: ast.AST) -> list[str]:
    """Names of everything called anywhere below ``node``: the attribute of a method call, the name of a plain one."""
    found = set()
    for call in ast.walk(node):
        if isinstance(call, ast.Call):
            target = call.func
            if isinstance(target, ast.Attribute):
                found.add(target.attr)
            elif isinstance(target, ast.Name):
                found.add(target.id)
    return sorted(found)


def units_of(source: str, file: str) -> list[dict]:
    """Units of one file, breadth first; none for a file that doesn't parse; units of a single line are left out.

    Whatever is defined inside a class, closures in methods included, carries the innermost class in its name.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = source.splitlines()
    imports = sorted({a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module})
    out, queue = [], deque([(tree, None)])
    while queue:
        node, parent = queue.popleft()
        inner = node.name if isinstance(node, ast.ClassDef) else parent
        queue.extend((child, inner) for child in ast.iter_child_nodes(node))
        if not isinstance(node, _DEFINITIONS):
            continue
        text = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        if node.end_lineno - node.lineno < 1:
            continue
        class_ = isinstance(node, ast.ClassDef)
        out.append(
            {
                "name": f"{parent}.{node.name}" if parent else node.name, "bare_name": node.name, "parent": parent,
                "type": "class" if class_ else "method" if parent else "function", "file": file, "language": "python",
                "line_start": node.lineno, "line_end": node.end_lineno, "raw_source": text, "docstring": ast.get_docstring(node) or "",
                "decorators": ["@" + (ast.get_source_segment(source, d) or "") for d in node.decorator_list],
                "calls": [] if class_ else called_names(node), "imports": imports,
                "complexity": 1 if class_ else 1 + sum(isinstance(n, BRANCHES) for n in ast.walk(node)),
            }
        )
    return out


def chunk_python(files: DataFrame, repo_id: str) -> DataFrame:
    """Chunk rows of (path, content) files. Parsing is per file, so the work spreads as the files do."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(files.sparkSession)
    kind = StructType.fromDDL(UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = to_arrow_schema(kind)
        for batch in batches:
            rows = [u for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for u in units_of(text or "", path)]
            yield pa.RecordBatch.from_pylist(rows, schema=made)

    return with_ids(files.select("path", "content").mapInArrow(run, kind), repo_id)


#: What stands before the parts of the text that is embedded and indexed.
LABELS = {"file": "File: ", "parent": "Class: ", "docstring": "Description: ", "calls": "Calls: ", "decorators": " Registered via: "}


def with_ids(units: DataFrame, repo_id: str) -> DataFrame:
    """Adds id, repo_id, qualified_name, text, content_hash, registered_by and an empty called_by."""
    repo = F.lit(repo_id)
    head = F.concat_ws(
        "\n", F.concat(F.lit(LABELS["file"]), "file"), F.concat(F.initcap("type"), F.lit(": "), "name"), F.concat(F.lit(LABELS["parent"]), "parent"),
        F.when(F.col("docstring") != "", F.concat(F.lit(LABELS["docstring"]), F.substring("docstring", 1, 200))),
        F.when(F.size("calls") > 0, F.concat(F.lit(LABELS["calls"]), F.array_join(F.slice("calls", 1, 8), ", "))),
        F.when(F.size("decorators") > 0, F.concat(F.lit(LABELS["decorators"]), F.array_join("decorators", ", "))),
    )
    return units.select(
        chunk_id(repo, F.col("file"), F.col("bare_name"), F.col("line_start")).alias("id"), repo.alias("repo_id"), "*",
        F.concat("file", F.lit("::"), "name").alias("qualified_name"), F.concat(head, F.lit("\n\n"), "raw_source").alias("text"),
        content_hash(F.col("raw_source")).alias("content_hash"), F.col("decorators").alias("registered_by"), F.array().cast("array<string>").alias("called_by"),
    )


#: Columns of a chunk that graph and lexical work need, and those that are stored.
META = ("id", "repo_id", "name", "type", "file", "line_start", "calls", "called_by", "decorators", "imports")
PAYLOAD = (*META, "qualified_name", "bare_name", "parent", "language", "line_end", "raw_source", "docstring", "text", "content_hash", "registered_by", "complexity")


def meta(chunks: DataFrame) -> DataFrame:
    return chunks.select(*META)


def payload(chunks: DataFrame) -> DataFrame:
    """What is stored beside a vector: all but the vector itself."""
    return chunks.select(*PAYLOAD)


def counted(chunks: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """One row: chunks, files, and how many texts the embedding cache (text_md5) has or lacks."""
    held = chunks.select("file", F.md5("text").alias("text_md5"))
    if cached is None:
        held = held.withColumn("cached", F.lit(False))
    else:
        held = held.join(cached.select("text_md5").distinct().withColumn("cached", F.lit(True)), "text_md5", "left")
    hit = F.coalesce("cached", F.lit(False))
    return held.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file").alias("files"), F.count_if(hit).alias("cached"), F.count_if(~hit).alias("fresh"))


def is_abstract(source: str | None, decorators: list[str] | None = None) -> bool:
    """Marked abstract, or with no body beside a docstring but pass, an ellipsis or a NotImplementedError."""
    if any("abstractmethod" in d for d in decorators or ()):
        return True
    try:
        node = ast.parse(_dedented(source)).body[0]
    except (SyntaxError, IndexError, ValueError):
        return False
    if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return False
    if any("abstractmethod" in ast.unparse(d) for d in node.decorator_list):
        return True
    body = node.body[1:] if ast.get_docstring(node) is not None else node.body
    if not body:
        return True
    if len(body) > 1:
        return False
    only = body[0]
    if isinstance(only, ast.Pass) or (isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant) and only.value.value is Ellipsis):
        return True
    raised = only.exc.func if isinstance(only, ast.Raise) and isinstance(only.exc, ast.Call) else getattr(only, "exc", None)
    return isinstance(raised, ast.Name) and raised.id == "NotImplementedError"


def is_runtime(type_: str, source: str | None, decorators: list[str] | None = None) -> bool:
    """A function or method that does something itself: not abstract, not one call that forwards."""
    if type_ not in ("function", "method") or is_abstract(source, decorators):
        return False
    try:
        node = ast.parse(_dedented(source)).body[0]
    except (SyntaxError, IndexError, ValueError):
        return False
    if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return False
    body = node.body[1:] if ast.get_docstring(node) is not None else node.body
    if len(body) != 1:
        return True
    value = getattr(body[0], "value", None)
    value = value.value if isinstance(value, ast.Await) else value
    return not (isinstance(body[0], (ast.Return, ast.Expr)) and isinstance(value, ast.Call))


def _dedented(source: str | None) -> str:
    import textwrap

    return textwrap.dedent(source or "")


def with_implementation_flags(chunks: DataFrame) -> DataFrame:
    """Adds abstract and runtime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("type", "raw_source", "decorators")), strict=True))
            flags = [[is_abstract(s, d) for _, s, d in rows], [is_runtime(t, s, d) for t, s, d in rows]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, pa.bool_()) for f in flags)], names=[*batch.schema.names, "abstract", "runtime"])

    from pyspark.sql.types import BooleanType, StructField, StructType

    ship(chunks.sparkSession)
    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, StructField("abstract", BooleanType()), StructField("runtime", BooleanType())]))
