"""Small literal inputs for operators that the driver's tables can't exercise, with their expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODULE = '''import os
from pathlib import Path


class Basket:
    """Things to buy."""

    def __init__(self, limit):
        self.limit = limit
        self.items = []

    def add(self, item):
        """Put one more thing in."""
        if len(self.items) >= self.limit:
            raise ValueError(item)
        for known in self.items:
            if known == item and self.limit:
                return
        self.items.append(item)

    def total(self): return sum(self.items)


async def load(path):
    basket = Basket(3)
    with open(path) as lines:
        for line in lines:
            basket.add(line)
    return basket


@cached
def helper(x):
    def inner(y):
        return y + x
    return inner(os.getpid())
'''
BROKEN = "def broken(:\n    pass\n"


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("shop/basket.py", MODULE), ("shop/broken.py", BROKEN)], "path string, content string")


#: name, type, line_start, line_end, calls, complexity
EXPECTED_CHUNKS = [
    ("Basket", "class", 5, 21, "", 1),
    ("load", "function", 24, 29, "Basket,add,open", 3),
    ("helper", "function", 33, 36, "getpid,inner", 1),
    ("Basket.__init__", "method", 8, 10, "", 1),
    ("Basket.add", "method", 12, 19, "ValueError,append,len", 5),
    ("inner", "function", 34, 35, "", 1),
]

_GRAPH = [
    # pos, id, name, file, type, calls
    (0, "a", "main", "app.py", "function", ["Basket", "save", "run"]),
    (1, "b", "Basket", "shop.py", "class", []),
    (2, "c", "Basket.__init__", "shop.py", "method", ["reset"]),
    (3, "d", "Basket.reset", "shop.py", "method", []),
    (4, "e", "Disk.save", "disk.py", "method", ["flush"]),
    (5, "f", "Net.save", "net.py", "method", []),
    (6, "g", "run", "app.py", "function", []),
    (7, "h", "run", "other.py", "function", []),
]


def graph_chunks(spark: SparkSession) -> DataFrame:
    rows = [(*r, []) for r in _GRAPH]
    return spark.createDataFrame(rows, "pos int, id string, name string, file string, type string, calls array<string>, called_by array<string>")


EXPECTED_INVERSION = [("b", "main"), ("c", "main"), ("g", "main"), ("h", "main")]
_REQUESTS = [(1, "app.py", "main", "Basket"), (2, "app.py", "main", "save"), (3, "app.py", "main", "run"), (4, "shop.py", "Basket.__init__", "reset"), (5, "disk.py", "Disk.save", "flush"), (6, "disk.py", "load", "save")]
EXPECTED_NEIGHBOURS = [(1, "b", 2), (1, "c", 6), (2, "e", 5), (2, "f", 5), (3, "g", 1), (3, "h", 2), (4, "d", 3), (6, "e", 4)]


def neighbour_requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_REQUESTS, "request int, file string, current string, callee string")


# By hand: main calls Basket (the class), save (both methods, by their bare name) and run (twice); then what nothing reaches.
EXPECTED_ORDER = [("main", 0), ("Basket", 1), ("Disk.save", 2), ("Net.save", 3), ("run", 4), ("run", 5), ("Basket.__init__", 6), ("Basket.reset", 7)]

_SYMBOLS = [("Basket.add", "add"), ("Basket.add", "Basket.add"), ("add", "Basket.add"), ("Basket.add", "Disk.add"), ("Basket.add", "Basket"), ("save", "load")]
EXPECTED_SYMBOLS = [(*s, same) for s, same in zip(_SYMBOLS, (True, True, True, True, False, False), strict=True)]


def symbol_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SYMBOLS, "symbol string, name string")


_REWRITES = [
    ("how does add work", '```json\n{"implementation_summary": "adds", "phrases": ["add", "put"], "intent": "understand_flow", "graph": {"direction": "callees", "depth": 9}}\n```'),
    ("where is x", "sorry, no JSON"),
    ("who calls y", '{"phrases": ["1","2","3","4","5","6","7","8","9","10"], "intent": "dance", "graph": {"direction": "up", "depth": 0}}'),
]
EXPECTED_REWRITES = [("how does add work", "adds", 2, "understand_flow", "callees", 2), ("where is x", "where is x", 1, "find_function", "both", 1), ("who calls y", "who calls y", 8, "find_function", "both", 1)]


def rewrites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_REWRITES, "question string, answer string")


def values(rows: list[tuple], columns: str) -> str:
    """Rows as a DuckDB query of literals."""
    one = lambda v: "TRUE" if v is True else "FALSE" if v is False else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


EXPECTED_REPAIRS = [
    ('{"a": "b', '{"a": "b"}'), ('{"a": [1, {"b": 2', '{"a": [1, {"b": 2}]}'), ('{"a": 1, "b":', '{"a": 1}'), ('{"a": 1,', '{"a": 1}'), ('{"a": "x [ y"', '{"a": "x [ y"}'), ('{"a": 1}', '{"a": 1}'),
]
EXPECTED_SYMBOL_WORDS = [("what is Basket", "Basket"), ("how does it work", "-"), ("show the", "-"), ("where is dispatch_request", "dispatch_request")]


def broken_json(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b, _ in EXPECTED_REPAIRS], "broken string")


def symbol_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q,) for q, _ in EXPECTED_SYMBOL_WORDS], "question string")


SEED = "Basket.add"


def asked(spark: SparkSession) -> DataFrame:
    """Rewritten questions about the fixture's files."""
    rows = [
        ("q1", "how is the total of a Basket made", "adds up prices", ["total", "price"], "understand_flow", "callees", 2),
        ("q2", "where is add", "adds an item", ["add"], "find_function", "both", 1),
        ("q3", "zzz qqq", "zzz", ["zzz"], "debug", "callers", 1),
    ]
    return spark.createDataFrame(rows, "question string, question_text string, summary string, phrases array<string>, intent string, direction string, depth int")
