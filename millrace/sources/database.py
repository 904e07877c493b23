"""Database tables over JDBC, read by ranges of a whole-number key.

The database counts the rows of even steps between the key's bounds, those of dense steps in finer ones; steps are then put
together to partitions of about equal rows, so gaps in the key and dense stretches of it make no uneven tasks. Each partition is a predicate of its own, which
the database evaluates beside the filters and columns that Spark pushes down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of a partition, and steps that are counted for each partition.
ROWS, STEPS = 500_000, 8
#: Most steps of the first count, and parts of a step that holds too many rows. The driver holds the counts, which are at
#: most so many for each partition.
MOST, FINER = 20_000, 64


def is_whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType) or isinstance(kind, T.DecimalType) and kind.scale == 0


def quoted(spark: SparkSession, url: str, name: str) -> str:
    """A column's name as the database quotes it."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)


def cut_points(counts: Sequence[tuple[int, int]], rows: int) -> list[int]:
    """Where partitions of about `rows` rows begin, but for the first, of (begin of a step, its rows) in order."""
    out, held = [], 0
    for begin, n in counts:
        if held and held + n > rows:
            out.append(begin)
            held = 0
        held += n
    return out


def key_predicates(key: str, cuts: Sequence[int]) -> list[str]:
    """One condition per partition; together they hold for each row once, rows without key in the first."""
    if not cuts:
        return ["1 = 1"]
    middle = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *middle, f"{key} >= {cuts[-1]}"]


def plan_ranges(spark: SparkSession, url: str, relation: str, key: str, rows: int, **properties: str) -> list[str]:
    """The predicates of a relation's partitions, from counts that the database makes."""
    ask = lambda query: spark.read.format("jdbc").options(**properties).option("url", url).option("query", query).load().collect()
    low, high, n = ask(f"SELECT MIN({key}) AS low, MAX({key}) AS high, COUNT(*) AS n FROM {relation}")[0]
    if low is None or n <= rows or low == high:
        return key_predicates(key, [])
    low, high = int(low), int(high)
    step = 1 << ((high - low) // min(STEPS * -(-int(n) // rows), MOST)).bit_length()
    counts: dict[int, int] = {}
    spans = [(low, high + 1)]
    while spans:
        rest = f"({key} - ({low})) % {step}" if url.startswith("jdbc:sqlite") else f"MOD({key} - ({low}), {step})"
        within = " OR ".join(f"{key} >= {a} AND {key} < {b}" for a, b in spans)
        counts |= {int(b): int(n) for b, n in ask(f"SELECT s.b AS b, COUNT(*) AS n FROM (SELECT {key} - {rest} AS b FROM {relation} WHERE {within}) s GROUP BY s.b")}
        dense = sorted(b for b, n in counts.items() if n > rows) if step > 1 else []
        spans = merged([(b, b + step) for b in dense])
        for b in dense:
            del counts[b]
        step = max(1, step // FINER)
    return key_predicates(key, cut_points(sorted(counts.items()), rows))


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def read_database(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, key: str | None = None, rows: int = ROWS, **properties: str) -> DataFrame:
    """A table or a query's result, in partitions of about `rows` rows by ranges of a whole-number key.

    key None: the table's first whole-number column; without any, or with no more than `rows` rows, there is one
    partition. A single value of the key is never split. Rows without key are in the first partition.
    """
    if (table is None) == (query is None):
        raise ValueError("a database needs a table or a query")
    relation = table if table is not None else f"({query}) q"
    plain = spark.read.format("jdbc").options(**properties).option("url", url).option("dbtable", relation).load()
    fields = [f for f in plain.schema.fields if (f.name.lower() == key.lower() if key else is_whole(f.dataType))]
    if key and not (fields and is_whole(fields[0].dataType)):
        raise ValueError(f"{key!r} is no whole-number column of the table")
    if not fields:
        return plain
    predicates = plan_ranges(spark, url, relation, quoted(spark, url, fields[0].name), rows, **properties)
    return spark.read.jdbc(url, relation, predicates=predicates, properties=properties) if len(predicates) > 1 else plain
