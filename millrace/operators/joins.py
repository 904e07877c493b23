"""The join workbench: equi-joins with named keys, renames, conflict handling, statistics and lookups.

Physical strategy is Spark's: nothing is broadcast by hint unless its size is fixed by the operator.
"""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import col
from millrace.operators.columns import rename

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "anti": "left_anti", "left_anti": "left_anti", "semi": "left_semi"}
#: Parts of column names that hint at a key.
KEY_WORDS = ("id", "email", "sku", "code", "key")


@dataclass
class JoinSpec:
    """What to join and how. rename maps old to new names per side before the join."""

    left_on: Sequence[str] = ()
    right_on: Sequence[str] = ()
    how: str = "inner"
    suffix: str = "_right"
    prefer: str = "left"
    keep_right_keys: bool = False
    left_rename: Mapping[str, str] = field(default_factory=dict)
    right_rename: Mapping[str, str] = field(default_factory=dict)


def infer_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """The first common column by name."""
    both = sorted(set(left.columns) & set(right.columns))
    if not both:
        raise ValueError("the tables have no column in common; name the keys")
    return both[:1]


def check_keys(left_on: Sequence[str], right_on: Sequence[str]) -> None:
    """Pairs of keys must be complete and each column used once per side."""
    if len(left_on) != len(right_on) or not all([*left_on, *right_on]):
        raise ValueError("each left key needs a right key")
    for side, names in (("left", left_on), ("right", right_on)):
        if len(set(names)) < len(names):
            raise ValueError(f"a {side} key is named twice")


def prepared(left: DataFrame, right: DataFrame, spec: JoinSpec) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    if spec.left_rename:
        left = rename(left, list(spec.left_rename), list(spec.left_rename.values()))
    if spec.right_rename:
        right = rename(right, list(spec.right_rename), list(spec.right_rename.values()))
    left_on = list(spec.left_on) or infer_keys(left, right)
    right_on = list(spec.right_on) or left_on
    check_keys(left_on, right_on)
    return left, right, left_on, right_on


def equi_join(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """Join on the keys. Right columns whose name the left has get the suffix; with prefer "right" the right value wins
    where it is filled and the suffixed column goes. Right keys are left out unless asked for; right and full joins
    take a missing left key from the right. null keys match nothing."""
    if spec.how not in KINDS:
        raise ValueError(f"unknown join {spec.how!r}")
    how = KINDS[spec.how]
    left, right, left_on, right_on = prepared(left, right, spec)
    inner = right.select(*[col(c).alias(f"__r{i}") for i, c in enumerate(right.columns)])
    at = {c: F.col(f"__r{i}") for i, c in enumerate(right.columns)}
    same = reduce(lambda a, b: a & b, [col(l) == at[r] for l, r in zip(left_on, right_on, strict=True)])  # noqa: E741
    out = left.join(inner, same, how)
    if how in ("left_anti", "left_semi"):
        return out
    key_of = dict(zip(left_on, right_on, strict=True))
    columns: dict[str, Column] = {c: F.coalesce(col(c), at[key_of[c]]) if c in key_of and how in ("right", "full") else col(c) for c in left.columns}
    for c in right.columns:
        if c in right_on and not spec.keep_right_keys:
            continue
        if c not in columns:
            columns[c] = at[c]
        elif spec.prefer == "right":
            columns[c] = F.coalesce(at[c], columns[c])
        else:
            columns[c + spec.suffix] = at[c]
    return out.select(*[x.alias(c) for c, x in columns.items()])


def join_statistics(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """One row: rows of each side, of the join, and rows of each side without a match, from key counts alone."""
    left, right, left_on, right_on = prepared(left, right, spec)
    count = lambda df, on, n: df.groupBy(*[col(c).alias(f"k{i}") for i, c in enumerate(on)]).agg(F.count("*").alias(n))
    keys = [f"k{i}" for i in range(len(left_on))]
    both = count(left, left_on, "l").join(count(right, right_on, "r"), keys, "full").select(F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    joined = {"inner": "l * r", "left": "l * greatest(r, 1)", "right": "r * greatest(l, 1)", "full": "CASE WHEN l = 0 THEN r WHEN r = 0 THEN l ELSE l * r END", "left_anti": "CASE WHEN r = 0 THEN l ELSE 0 END", "left_semi": "CASE WHEN r > 0 THEN l ELSE 0 END"}[KINDS[spec.how]]
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        zero(F.col("l")).alias("left_rows"), zero(F.col("r")).alias("right_rows"), zero(F.expr(joined)).alias("joined_rows"),
        zero(F.when(F.col("r") == 0, F.col("l"))).alias("left_unmatched"), zero(F.when(F.col("l") == 0, F.col("r"))).alias("right_unmatched"),
    )


def unmatched(left: DataFrame, right: DataFrame, spec: JoinSpec, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(left rows, right rows) without a match; up to `sample` of each for a report."""
    left, right, left_on, right_on = prepared(left, right, spec)

    def missing(a: DataFrame, a_on: Sequence[str], b: DataFrame, b_on: Sequence[str]) -> DataFrame:
        keys = b.select(*[col(c).alias(f"__k{i}") for i, c in enumerate(b_on)])
        out = a.join(keys, reduce(lambda x, y: x & y, [col(c) == F.col(f"__k{i}") for i, c in enumerate(a_on)]), "left_anti")
        return out if sample is None else out.limit(sample)

    return missing(left, left_on, right, right_on), missing(right, right_on, left, left_on)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, which would multiply rows of a join: (keys, rows)."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("rows")).where("rows > 1")


#: Distinct values over rows of a column that is nearly a key.
NEARLY = 0.9


def suggest_keys(left: DataFrame, right: DataFrame, least: float = 0.75, most: int = 3) -> DataFrame:
    """(left_key, right_key, similarity, containment, left_unique, right_unique) of likely key pairs, best first.

    Names propose: equal names that hold a key word, else similar names. The data rank: containment is the share of
    distinct left keys that the right side has.
    """
    named = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    pairs = [(c, c, 1.0) for c in left.columns if c in right.columns and any(w in c.lower() for w in KEY_WORDS)]
    if not pairs:
        scored = sorted(((a, b, named(a, b)) for a in left.columns for b in right.columns), key=lambda x: (-x[2], x[0], x[1]))
        pairs = [x for x in scored if x[2] >= least][:most]
    return measured(left, right, pairs, most)


def discover_keys(left: DataFrame, right: DataFrame, least: float = 0.5, most: int = 3) -> DataFrame:
    """As suggest_keys, but from the data alone: all pairs of columns, whatever their names.

    Each table is read once for a sketch of every column's set of values; the sketches' intersections give the containment
    of every pair. Pairs of an estimated containment of `least` or more whose right side is nearly a key, fewest chance
    matches (most distinct left values) first, are then measured exactly, 2 * most of them.
    """
    a, b = column_sketches(left), column_sketches(right)
    share = lambda x, y: F.theta_sketch_estimate(F.theta_intersection(x, y))
    both = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns)).join(F.broadcast(b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))), F.lit(True))
    scored = both.select("a_column", "b_column", "a_distinct", (share("a_sketch", "b_sketch") / F.col("a_distinct")).alias("contained"), (F.col("b_distinct") / F.col("b_filled")).alias("key"))
    likely = scored.where((F.col("contained") >= least) & (F.col("key") >= NEARLY) & (F.col("a_distinct") > 1))
    pairs = likely.orderBy(F.desc(F.round("contained", 1)), F.desc("a_distinct"), "a_column", "b_column").limit(2 * most).collect()
    named = lambda x, y: difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio()
    return measured(left, right, [(r.a_column, r.b_column, named(r.a_column, r.b_column)) for r in pairs], most)


def column_sketches(df: DataFrame) -> DataFrame:
    """(column, sketch, distinct, filled) of each column, in one pass: a row for each of a table's columns."""
    names = df.columns
    row = df.agg(*(F.struct(F.lit(n).alias("column"), F.theta_sketch_agg(col(n).cast("string")).alias("sketch"), F.count(col(n)).alias("filled")).alias(f"c{i}") for i, n in enumerate(names)))
    flat = row.select(F.explode(F.array(*[f"c{i}" for i in range(len(names))])).alias("c")).select("c.*")
    return flat.where("filled > 0").withColumn("distinct", F.theta_sketch_estimate("sketch"))


def measured(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str, float]], most: int) -> DataFrame:
    """The exact figures of (left column, right column, similarity of names), best first."""
    parts = []
    for a, b, score in pairs:
        x = left.groupBy(col(a).cast("string").alias("k")).agg(F.count("*").alias("l"))
        y = right.groupBy(col(b).cast("string").alias("k")).agg(F.count("*").alias("r"))
        both = x.where("k IS NOT NULL").join(y.where("k IS NOT NULL"), "k", "full")
        parts.append(both.agg(
            F.lit(a).alias("left_key"), F.lit(b).alias("right_key"), F.lit(round(score, 4)).alias("similarity"),
            F.try_divide(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()), F.count("l")).alias("containment"),
            F.try_divide(F.count("l"), F.sum("l")).alias("left_unique"), F.try_divide(F.count("r"), F.sum("r")).alias("right_unique"),
        ))
    if not parts:
        return left.sparkSession.createDataFrame([], "left_key string, right_key string, similarity double, containment double, left_unique double, right_unique double")
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("containment"), F.desc("similarity"), "left_key", "right_key").limit(most)


def consistency_check(df: DataFrame, mapping: DataFrame, lhs: str, rhs: str, auto_fix: bool = False, flag_col: str | None = None, suggest_col: str | None = None) -> DataFrame:
    """Flag rows whose rhs differs from what a two-column map gives for lhs; suggest it, and put it in with auto_fix.

    Of several map rows of a key the largest value counts; lhs without a map row is no mismatch.
    """
    k, v = mapping.columns[:2]
    table = mapping.groupBy(col(k).cast("string").alias("__k")).agg(F.max(col(v).cast("string")).alias("__v"))
    out = df.join(table, F.coalesce(col(lhs).cast("string"), F.lit("")) == F.col("__k"), "left")
    flag, suggest = flag_col or f"{lhs}__{rhs}__mismatch", suggest_col or f"{lhs}__{rhs}__suggestion"
    wrong = F.col("__v").isNotNull() & ~col(rhs).cast("string").eqNullSafe(F.col("__v"))
    made = {flag: wrong, suggest: F.when(wrong, F.col("__v"))}
    if auto_fix:
        made[rhs] = F.when(wrong, F.col("__v")).otherwise(col(rhs).cast("string"))
    return out.withColumns(made).drop("__k", "__v")


def lookup(df: DataFrame, table: DataFrame, keys: Mapping[str, str], fields: Mapping[str, str]) -> DataFrame:
    """Add fields (table column to output name) of the table's row for each key (df column to table column), null where
    there is none; of several rows of a key the smallest counts."""
    inner = table.select(*[col(r).cast("string").alias(f"__k{i}") for i, r in enumerate(keys.values())], F.struct(*[col(c).alias(f"f{i}") for i, c in enumerate(fields)]).alias("__f"))
    one = inner.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min("__f").alias("__f"))
    same = reduce(lambda a, b: a & b, [col(l).cast("string") == F.col(f"__k{i}") for i, l in enumerate(keys)])  # noqa: E741
    out = df.join(one, same, "left").withColumns({name: F.col(f"__f.f{i}") for i, name in enumerate(fields.values())})
    return out.drop("__f", *[f"__k{i}" for i in range(len(keys))])


def geocode(df: DataFrame, column: str, gazetteer: DataFrame) -> DataFrame:
    """column__lat and column__lon from a gazetteer (address, lat, lon) by normalised address; null where unknown."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")))
    table = gazetteer.groupBy(norm(F.col("address")).alias("__a")).agg(F.min(F.struct("lat", "lon")).alias("__p"))
    out = df.join(table, norm(col(column)) == F.col("__a"), "left")
    return out.withColumns({f"{column}__lat": F.col("__p.lat"), f"{column}__lon": F.col("__p.lon")}).drop("__a", "__p")


def exchange(df: DataFrame, rates: DataFrame, amount: str, source: str, target: str, out: str) -> DataFrame:
    """out = amount in the target currency by rates (currency, rate) against one base; null where a rate is missing."""
    table = lambda n: rates.groupBy(F.upper("currency").alias(f"__c{n}")).agg(F.max("rate").alias(f"__r{n}"))
    both = df.join(table("f"), F.upper(col(source)) == F.col("__cf"), "left").join(table("t"), F.upper(col(target)) == F.col("__ct"), "left")
    return both.withColumn(out, F.try_divide(col(amount) * F.col("__rt"), F.col("__rf"))).drop("__cf", "__rf", "__ct", "__rt")
