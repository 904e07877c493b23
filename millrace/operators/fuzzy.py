"""Fuzzy matching of keys: exact sequence ratios over a lossless candidate join, leader clusters, MinHash matching.

The ratio is 2 * matches / (length of a + length of b) with matches by longest common blocks, argument order (candidate,
query). All pairs are never built: keys are made distinct, and a pair can reach the cutoff c only if its lengths have a
ratio of c / (2 - c) at least and, for c over 2/3, shares beta = (1.5 c - 1)(la + lb) - 1 bigrams.

Pairs of middling length are found by where their differences lie. With m characters matched, at least c (la + lb) / 2,
la + lb - 2 m are not. Either few of these come before the HEAD-th matched character, or few after the HEAD-th last, or
the part between has so few that it holds runs of RUN or more equal characters. So keys are filed under HEAD characters of their
start and of their end, with up to t skipped, and under their runs. These slots have four characters or more, so they stay
small. Other pairs meet in bigrams: each key is filed under its rarest ones, so many that two keys sharing beta bigrams
meet in one; keys too short for a positive beta are filed under their length.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import col
from millrace.operators.rows import freed, stable

#: Characters of a slot at the ends of a key, the least and most ones of a run, and the most characters skipped at an end.
HEAD, RUN, LONGEST, SKIPPED = 4, 4, 8, 3


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The sequence ratio of candidate a and query b; the matcher keeps its index of one query while it repeats."""
    matcher, last, out = difflib.SequenceMatcher(None), None, []
    for x, y in zip(a, b, strict=True):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """1 if equal in lower case, 0.95 if one contains the other, else the sequence ratio."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.95).otherwise(ratio(x, y))


def fingerprint(columns: Sequence[str]) -> Column:
    """The normalised key of several columns."""
    return F.lower(F.trim(F.concat_ws("||", *[F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) for c in columns])))


def numbered_grams(c: Column, size: int) -> Column:
    """The numbered runs of size characters of a text: the second "ab" is another one than the first."""
    n = F.length(c)
    raw = F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substr(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    def numbered(own: Column) -> Column:
        each = F.transform(own, lambda g, i: F.concat(g, F.size(F.filter(F.slice(own, 1, i + 1), lambda x: x == g)).cast("string")))
        return F.when(F.size(F.array_distinct(own)) == F.size(own), F.transform(own, lambda g: F.concat(g, F.lit("1")))).otherwise(each)

    # bound to a name, else it would be worked out anew for each of its runs
    return F.transform(F.array(raw), numbered)[0]


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all shuffle partitions by key: rows are small beside the work on them, so Spark would merge the parts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def filed(keys: DataFrame, cutoff: float, order: DataFrame) -> DataFrame:
    """(k, n, grams, slot): each key under the slots in which it must meet its matches."""
    spread = (2 - cutoff) / cutoff
    n = F.col("n")
    # the shared bigrams that any partner of the least allowed length must have
    beta = F.ceil((1.5 * cutoff - 1) * (n + F.ceil(n * (cutoff / (2 - cutoff)) - 1e-9)) - 1 - 1e-9) if cutoff > 2 / 3 else F.lit(0)
    keyed = keys.withColumn("beta", beta.cast("int")).withColumn("prefix", (n - 1 - F.col("beta") + 1).cast("int"))
    long = keyed.where("beta > 0").select("k", "n", "grams", "prefix", F.explode("grams").alias("g")).join(order, "g")
    rank = F.row_number().over(Window.partitionBy("k").orderBy("rarity", "g"))
    by_gram = long.withColumn("rank", rank).where("rank <= prefix").select("k", "n", "grams", F.concat(F.lit("g"), F.col("g")).alias("slot"))
    low = F.ceil(n / spread - 1e-9).cast("int")
    by_length = keyed.where("beta <= 0").select("k", "n", "grams", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.floor(n * spread + 1e-9).cast("int"))).alias("m")).select("k", "n", "grams", F.concat(F.lit("n"), F.col("m")).alias("slot"))
    return by_gram.union(by_length)


def matched(total: int, cutoff: float) -> int:
    """The characters that keys of together total ones must match."""
    return math.ceil(cutoff * total / 2 - 1e-9)


def skips(cutoff: float) -> dict[int, tuple[int, int, int]]:
    """For the total lengths of pairs that slots of characters find: the characters skipped at an end, and where both ends
    skip more the runs that the part between must share (0: both cannot) and their length, the longest of which it must
    share any: the longer a run, the fewer other keys hold it."""
    out = {}
    for total in range(4 * HEAD, 40 * HEAD):
        m = matched(total, cutoff)
        for t in range(SKIPPED + 1 if m >= 2 * HEAD else 0):
            left = total - 2 * m - 2 * (t + 1)
            shared = [(m - 2 * HEAD + 2 - (run - 1) * (left + 1), run) for run in range(LONGEST, RUN - 1, -1)]
            if left < 0 or shared[-1][0] > 0:
                out[total] = (t, *next((s for s in shared if s[0] > 0), (0, RUN))) if left >= 0 else (t, 0, RUN)
                break
    return out


def others(cutoff: float) -> list[bool]:
    """By a key's length, whether it has partners that only bigrams find; longer keys than the list have."""
    by_total = skips(cutoff)
    partners = lambda n: (m for m in range(math.ceil(n * (2 - cutoff) / cutoff) + 2) if min(n, m) >= matched(n + m, cutoff))
    return [cutoff <= 0 or any(n + m not in by_total for m in partners(n)) for n in range(max(by_total, default=0) + 1)]


def run_lengths(cutoff: float) -> list[int]:
    return sorted({p[2] for p in skips(cutoff).values() if p[1] > 0})


def filing(mine: DataFrame, theirs: DataFrame, cutoff: float) -> DataFrame:
    """(n, ends, runs4, runs5, ...): for each length n of keys (k), by the lengths of the keys on the other side, the slots at
    each end and the runs of each length it is filed under. A row a length, of short keys alone."""
    by_total = skips(cutoff)
    most = max(by_total, default=0)
    plan = [by_total.get(total) for total in range(most + 1)]
    ends = F.get(F.lit([math.comb(HEAD + p[0], HEAD) if p else 0 for p in plan]), F.col("n") + F.col("m"))
    lengths = lambda df, name: df.select(F.length("k").alias(name)).where(F.col(name) <= most).distinct()
    both = lengths(mine, "n").crossJoin(F.broadcast(lengths(theirs, "m"))).where((F.col("n") + F.col("m")).isin(sorted(by_total)))
    can = both.where(F.least("n", "m") >= needed(F.col("n") + F.col("m"), cutoff))

    def runs(run: int) -> Column:
        shared = F.get(F.lit([p[1] if p and p[2] == run else 0 for p in plan]), F.col("n") + F.col("m"))
        return F.when(shared > 0, F.greatest(F.col("n") - run + 2 - shared, F.lit(0))).otherwise(0)

    return can.groupBy("n").agg(F.max(ends).alias("ends"), *(F.max(runs(run)).alias(f"runs{run}") for run in run_lengths(cutoff)))


def needed(total: Column, cutoff: float) -> Column:
    """matched for columns."""
    return F.ceil(total * (cutoff / 2) - 1e-9).cast("int")


def end_slots(side: str, text: Column) -> Column:
    """(slot, skipped) of HEAD characters of the start of a text, those with fewer skipped first."""
    at = [F.substring(text, i + 1, 1) for i in range(HEAD + SKIPPED)]
    picks = [(x, (*some, HEAD + x - 1)) for x in range(SKIPPED + 1) for some in combinations(range(HEAD + x - 1), HEAD - 1)]
    return F.array(*(F.struct(F.xxhash64(F.lit(side), *(at[i] for i in some)).alias("slot"), F.lit(x).alias("skipped")) for x, some in picks))


def slots(keys: DataFrame, partners: DataFrame, cutoff: float) -> DataFrame:
    """(k, slot, skipped): each key (k) under its slots of characters, with the characters skipped."""
    known = dealt(keys, "k").join(F.broadcast(filing(keys, partners, cutoff)), F.length("k") == F.col("n"))

    def own(run: int) -> Column:
        # any order that all keys share will do for the runs; equal ones are numbered
        hashed = F.sort_array(F.transform(numbered_grams(F.col("k"), run), lambda g: F.xxhash64(F.lit("run"), g)))
        first = F.transform(F.slice(hashed, F.lit(1), F.col(f"runs{run}")), lambda h: F.struct(h.alias("slot"), F.lit(0).alias("skipped")))
        return F.when(F.col(f"runs{run}") > 0, first).otherwise(F.array().cast("array<struct<slot:bigint,skipped:int>>"))

    both = [F.slice(end_slots(side, text), F.lit(1), F.col("ends")) for side, text in (("start", F.col("k")), ("end", F.reverse("k")))]
    return known.select("k", F.inline(F.concat(*(own(run) for run in run_lengths(cutoff)), *both)))


def slot_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(a, b), once each: pairs of keys that share a slot of characters and can reach the cutoff."""
    by_total = skips(cutoff)
    if not by_total:
        return left.select(F.col("k").alias("a"), F.col("k").alias("b")).limit(0)
    side = lambda own, other, name: slots(own, other, cutoff).select(F.col("k").alias(name), "slot", F.col("skipped").alias(f"skipped_{name}"))
    both = side(left, right, "b").join(side(right, left, "a").hint("merge"), "slot")
    total = F.length("a") + F.length("b")
    need = needed(total, cutoff)
    most = F.get(F.lit([by_total[x][0] if x in by_total else -1 for x in range(max(by_total) + 1)]), total)
    can = (F.col("skipped_a") + F.col("skipped_b") <= most) & (F.least(F.length("a"), F.length("b")) >= need)
    # what does not match is deleted or inserted
    close = F.call_function("levenshtein", F.col("a"), F.col("b"), total - 2 * need) >= 0
    return both.where(can & close).select("a", "b").distinct()


def bigram_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(a, b), once each: pairs of keys that share a rare bigram or lie within a band of lengths and can reach the cutoff,
    without those that slots of characters find."""
    totals, known = sorted(skips(cutoff)), others(cutoff)
    wanted = (F.length("k") >= len(known)) | F.get(F.lit(known), F.length("k"))
    shape = lambda df: df.where(wanted).select("k", F.length("k").alias("n"), numbered_grams(F.col("k"), 2).alias("grams"))
    l, r = shape(left), shape(right)  # noqa: E741
    order = l.union(r).select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("rarity"))
    fl, fr = filed(l, cutoff, order), filed(r, cutoff, order)
    # a key that is filed by length meets partners of that length, however they are filed
    own_l = l.select("k", "n", "grams", F.concat(F.lit("n"), F.col("n")).alias("slot"))
    own_r = r.select("k", "n", "grams", F.concat(F.lit("n"), F.col("n")).alias("slot"))
    x = lambda df, s: df.select(F.col("k").alias(s), F.col("n").alias(f"n{s}"), F.col("grams").alias(f"g{s}"), "slot")
    met = x(fl.where("slot LIKE 'g%'"), "b").join(x(fr.where("slot LIKE 'g%'"), "a"), "slot")
    met = met.unionByName(x(fl.where("slot LIKE 'n%'"), "b").join(x(own_r, "a"), "slot")).unionByName(x(own_l, "b").join(x(fr.where("slot LIKE 'n%'"), "a"), "slot"))
    total = F.col("na") + F.col("nb")
    shared = F.size(F.array_intersect("ga", "gb"))
    near = met.where(~total.isin(totals)).where(F.least("na", "nb") >= F.greatest("na", "nb") * (cutoff / (2 - cutoff)) - 1e-9)
    if cutoff > 2 / 3:
        near = near.where(shared >= (1.5 * cutoff - 1) * total - 1 - 1e-9)
    return near.select("a", "b").distinct()


def candidates(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(a, b): distinct pairs of keys, a of right (candidate) and b of left (query), that can have a ratio of cutoff.

    left and right hold distinct keys in a column k.
    """
    return slot_pairs(left, right, cutoff).union(bigram_pairs(left, right, cutoff))


def matching_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(a, b, score) of candidates whose ratio reaches the cutoff. The keys are written once: the search reads them a dozen
    times, and what they come from may be far larger."""
    left, right = (stable(left),) * 2 if left is right else (stable(left), stable(right))
    scored = dealt(candidates(left, right, cutoff), "b").withColumn("score", ratio("a", "b"))
    return scored.where(F.col("score") >= cutoff)


def best_per_query(pairs: DataFrame) -> DataFrame:
    """For each query the candidate of highest score, of equal ones the larger text."""
    w = Window.partitionBy("b").orderBy(F.desc("score"), F.desc("a"))
    return pairs.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def fuzzy_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float = 0.8, prefix: str = "right__") -> DataFrame:
    """Left join to the best right key of ratio threshold or more; right columns get the prefix, of several right rows of
    a key the smallest joins, unmatched left rows stay, null keys match nothing."""
    lk = left.select(col(left_key).cast("string").alias("k")).where("k IS NOT NULL").distinct()
    rk = right.select(col(right_key).cast("string").alias("k")).where("k IS NOT NULL").distinct()
    best = best_per_query(matching_pairs(lk, rk, threshold)).select(F.col("b").alias("__b"), F.col("a").alias("__a"))
    return link(left, right, left_key, right_key, best, prefix)


def link(left: DataFrame, right: DataFrame, left_key: str, right_key: str, best: DataFrame, prefix: str) -> DataFrame:
    """left beside the right row whose key `best` (__b query, __a candidate) names."""
    named = right.select(*[col(c).alias(prefix + c) for c in right.columns])
    one = named.groupBy(col(prefix + right_key).cast("string").alias("__r")).agg(F.min(F.struct(*[col(prefix + c) for c in right.columns])).alias("__row"))
    out = left.join(best, col(left_key).cast("string") == F.col("__b"), "left").join(one, F.col("__a") == F.col("__r"), "left")
    return out.select(*[col(c) for c in left.columns], *[F.col("__row")[prefix + c].alias(prefix + c) for c in right.columns])


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))


def word_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, distance): names k of rows (k, w), a of right and b of left, whose distinct words w have a Jaccard similarity
    of threshold (over 0) or more. Exact: two such sets share a word among their n - ceil(threshold n) + 1 rarest."""
    shape = lambda df: df.where(F.size("w") > 0).select("k", "w", F.size("w").alias("n"))
    l, r = shape(left), shape(right)  # noqa: E741
    order = l.select("w").union(r.select("w")).select(F.explode("w").alias("g")).groupBy("g").agg(F.count("*").alias("often"))

    def under(df: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("k").orderBy("often", "g"))
        placed = df.select("k", "n", F.explode("w").alias("g")).join(order, "g").withColumn("place", place)
        rare = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
        return rare.select("g", F.col("k").alias(name), F.col("n").alias(f"n{name}"), F.col("place").alias(f"p{name}"))

    total = F.col("na") + F.col("nb")
    # at their first common word, the words from there on must suffice
    enough = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= total * (threshold / (1 + threshold)) - 1e-9
    met = under(r, "a").join(under(l, "b"), "g").where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9).where(enough).select("a", "b").distinct()
    sets = lambda df, x: df.select(F.col("k").alias(x), F.col("w").alias(f"w{x}"))
    both = met.join(sets(r, "a"), "a").join(sets(l, "b"), "b").withColumn("common", F.size(F.array_intersect("wa", "wb")))
    distance = 1 - F.col("common") / (F.size("wa") + F.size("wb") - F.col("common"))
    return both.select("a", "b", distance.alias("distance")).where(F.col("distance") <= 1 - threshold + 1e-9)


#: Least threshold at which sets are found by their parts; below it a part has too few words to be rare.
BY_PARTS = 0.6


def part_plan(threshold: float) -> tuple[list[int], list[int], list[int]]:
    """(least size, parts, most differing words) of each class of set sizes. Sets of a similarity of threshold have sizes of
    one class or of two that follow; a few parts more than could all differ leave one that is alike and not empty."""
    sizes, share = [1], (1 - threshold) / (1 + threshold)
    while sizes[-1] < 1 << 31:
        sizes.append(math.floor(sizes[-1] / min(threshold, 0.9) + 1e-9) + 1)
    differ = [math.floor(share * 2 * (b - 1) + 1e-9) for b in sizes[1:]]
    return sizes[:-1], [d + 1 + math.ceil(0.15 * d) for d in differ], differ


def part_rows(sets: DataFrame, threshold: float) -> DataFrame:
    """(k, need, slot) of sets (k, w) of whole numbers: a slot for what each part holds in their own class of sizes and in the
    next, where need is negative. Similar sets share that many slots, or as many as the other needs if it needs more.

    Parts that are empty in both sets are alike as well, so they count only for a set with so many that none other may be.
    """
    sizes, parts, differ = part_plan(threshold)
    own = F.size(F.filter(F.lit(sizes), lambda s: s <= F.size("w"))) - 1
    each = sets.where(F.size("w") > 0).withColumn("own", own).select("k", "w", "own", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("class"))
    m, d = (F.get(F.lit(x), F.col("class")).cast("long") for x in (parts, differ))
    where = F.transform("w", lambda h: F.pmod(h, m))
    each = each.withColumn("least", m - d - (m - F.size(F.array_distinct(where))))
    need = F.least(F.greatest("least", F.lit(1)), F.lit(100)).cast("byte")
    filled = F.transform("w", lambda h: F.struct(F.pmod(h, m).alias("part"), F.xxhash64(h).alias("held")))
    none = F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), m - 1), where), lambda j: F.struct(j.alias("part"), F.lit(0).cast("long").alias("held")))
    each = each.select("k", F.when(F.col("class") == F.col("own"), need).otherwise(-need).alias("need"), "class", F.explode(F.when(F.col("least") <= 0, F.concat(filled, none)).otherwise(filled)).alias("p"))
    held = each.groupBy("k", "need", "class", F.col("p.part").alias("part")).agg(F.bit_xor("p.held").alias("held"))
    return held.select("k", "need", F.xxhash64("class", "part", "held").alias("slot"))


def set_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, checkpointed: pairs of sets (k, w) of whole numbers that can have a Jaccard similarity of threshold or
    more, all that have it among them.

    Such sets differ in at most d = (1 - t) / (1 + t) (na + nb) words, so of more than d parts, by the words' hashes, they
    have some alike. What a part of some four words holds is rare, unlike the words, and no set goes beside another
    before they have met in as many parts as they must.
    """
    rows = part_rows(sets, threshold)
    side = lambda s: rows.select("slot", F.col("k").alias(s), F.col("need").alias(f"need{s}"))
    # sets of one class meet in theirs, others in the class of the larger
    met = side("a").join(side("b"), "slot").where("a < b AND (needa > 0 OR needb > 0)")
    met = met.groupBy("a", "b").agg(F.count("*").alias("met"), F.max(F.greatest(F.abs("needa"), F.abs("needb"))).alias("need"))
    return freed(met.where("met >= need").select("a", "b"))


def text_pairs(rows: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: the texts, named by pos, whose distinct words have a Jaccard similarity of threshold or more, of rows
    (pos, text) whose pos is in keys. Words count by their 64-bit hashes."""

    def sets(some: DataFrame) -> DataFrame:
        # a merge join at every size, so that the words of a text stay in one task and are grouped there
        return rows.join(some.hint("merge"), "pos", "left_semi").select(F.col("pos").alias("k"), F.array_distinct(F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w))).alias("w"))

    near = set_pairs(sets(keys.select("pos")), threshold)
    wanted = sets(near.select("a").union(near.select("b")).toDF("pos").distinct())
    for s in ("a", "b"):
        near = near.join(wanted.select(F.col("k").alias(s), F.col("w").alias(f"w{s}")), s)
    common = F.size(F.array_intersect("wa", "wb"))
    return freed(near.where(common >= (F.size("wa") + F.size("wb") - common) * threshold - 1e-9).select("a", "b"))


def minhash_pairs(left: DataFrame, right: DataFrame, threshold: float, num_perm: int = 16, seed: int = 42) -> DataFrame:
    """(a, b, distance): keys whose word sets have a Jaccard similarity of threshold or more. The search is exact, so
    num_perm and seed of the MinHash interface change nothing."""
    words = lambda df: df.select("k", tokens(F.col("k")).alias("w"))
    return word_pairs(words(left), words(right), threshold)


def minhash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float = 0.8, num_perm: int = 16, prefix: str = "right__") -> DataFrame:
    """Left join to the right key of least Jaccard distance, of equal ones the smaller text."""
    lk = left.select(col(left_key).cast("string").alias("k")).where("k IS NOT NULL").distinct()
    rk = right.select(col(right_key).cast("string").alias("k")).where("k IS NOT NULL").distinct()
    if lk.isEmpty():
        best = left.sparkSession.createDataFrame([], "__b string, __a string")
    else:
        best = minhash_pairs(lk, rk, threshold, num_perm).groupBy(F.col("b").alias("__b")).agg(F.min(F.struct("distance", "a")).alias("m")).select("__b", F.col("m.a").alias("__a"))
    return link(left, right, left_key, right_key, best, prefix)


def leaders(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, leader) for keys (k, pos) and linked pairs (a, b): what a greedy pass by pos gives, in parallel.

    A key leads unless an earlier leader is linked to it; else it joins the earliest such leader. In each round the
    undecided keys without undecided or leading earlier neighbours lead, and their later neighbours follow.
    """
    pos = keys.select("k", "pos")
    both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).where("a != b").distinct()
    early = both.join(pos.select(F.col("k").alias("a"), F.col("pos").alias("pa")), "a").join(pos.select(F.col("k").alias("b"), F.col("pos").alias("pb")), "b").where("pa < pb").select("a", "pa", "b")
    early = stable(early)  # a is the earlier neighbour of b
    state = stable(pos.select("k", F.lit(None).cast("boolean").alias("leads")))
    while not state.where("leads IS NULL").isEmpty():
        near = early.join(state.select(F.col("k").alias("a"), F.col("leads").alias("la")), "a").groupBy(F.col("b").alias("k")).agg(F.bool_or(F.coalesce("la", F.lit(False))).alias("led"), F.bool_or(F.col("la").isNull()).alias("waits"))
        state = stable(state.join(near, "k", "left").select("k", F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("led"), False).when(~F.coalesce("waits", F.lit(False)), True).alias("leads")))
    chosen = early.join(state.where("leads").select(F.col("k").alias("a")), "a").groupBy(F.col("b").alias("k")).agg(F.min_by("a", "pa").alias("to"))
    return state.join(chosen, "k", "left").select("k", F.when(F.col("leads"), F.col("k")).otherwise(F.col("to")).alias("leader"))


def dedupe_key(columns: Sequence[str]) -> Column:
    """The columns joined by "||", lower case, white space collapsed. Accents are removed by unicode steps before."""
    joined = F.concat_ws("||", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns])
    return F.trim(F.regexp_replace(F.lower(joined), r"\s+", " "))


def fuzzy_groups(df: DataFrame, key: Column, order: str, threshold: float, method: str = "difflib") -> DataFrame:
    """(pos, leader), and for difflib the key k, of each row, by its order column: the cluster of its key by greedy leaders in
    row order. The minhash method names a leader by its position, as keys can be whole texts, and tells keys by 128-bit hashes."""
    rows = df.select(col(order).alias("pos"), key.alias("k"))
    if method == "difflib":
        keys = stable(rows.groupBy("k").agg(F.min("pos").alias("pos")))
        own = keys.select("k")
        pairs = matching_pairs(own, own, threshold).where("a != b").select("a", "b")
        return rows.join(leaders(keys, pairs), "k")
    if method != "minhash":
        raise ValueError(f"unknown matching method {method!r}")
    hashed = rows.select("pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))
    keys = freed(hashed.groupBy("h1", "h2").agg(F.min("pos").alias("pos")))
    if threshold >= BY_PARTS:
        pairs = text_pairs(rows.select("pos", F.col("k").alias("text")), keys, threshold)
    else:
        sets = rows.join(keys.select("pos"), "pos", "left_semi").select(F.col("pos").alias("k"), tokens(F.col("k")).alias("w"))
        pairs = word_pairs(sets, sets, threshold).where("a != b").select("a", "b")
    led = leaders(keys.select(F.col("pos").alias("k"), "pos"), pairs).select(F.col("k").alias("first"), "leader")
    return hashed.join(keys.withColumnRenamed("pos", "first"), ["h1", "h2"]).join(led, "first").select("pos", "leader")


def fuzzy_dedupe(df: DataFrame, columns: Sequence[str], order: str, threshold: float = 0.85, method: str = "difflib") -> DataFrame:
    """The first row (by the unique column `order`) of each cluster of similar keys."""
    first = fuzzy_groups(df, dedupe_key(columns), order, threshold, method).groupBy("leader").agg(F.min("pos").alias("__pos"))
    return df.join(first.select("__pos"), col(order) == F.col("__pos"), "left_semi")


def cluster_report(df: DataFrame, columns: Sequence[str], order: str, threshold: float = 0.85, most: int = 10) -> DataFrame:
    """The largest clusters of more than one row: (leader, rows)."""
    groups = fuzzy_groups(df, dedupe_key(columns), order, threshold)
    return groups.groupBy("leader").agg(F.count("*").alias("rows")).where("rows > 1").orderBy(F.desc("rows"), "leader").limit(most)


def entity_resolution(df: DataFrame, keys: Sequence[str], order: str, threshold: float = 0.85) -> DataFrame:
    """One row per entity: the first row of each cluster of similar key fingerprints; clusters are disjoint."""
    first = fuzzy_groups(df, fingerprint(keys), order, threshold).groupBy("leader").agg(F.min("pos").alias("__pos"))
    return df.join(first.select("__pos"), col(order) == F.col("__pos"), "left_semi")


def entity_link(df: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "right__") -> DataFrame:
    """Left join to the right rows of equal key fingerprint, right columns prefixed; null keys count as empty."""
    named = right.select(fingerprint(keys).alias("__fp"), *[col(c).alias(prefix + c) for c in right.columns])
    return df.withColumn("__own", fingerprint(keys)).join(named, F.col("__own") == F.col("__fp"), "left").drop("__own", "__fp")


def spell_correct(df: DataFrame, column: str, vocabulary: DataFrame | None = None, abbreviations: dict[str, str] | None = None, max_dist: float = 0.8) -> DataFrame:
    """Expand abbreviated words, then replace the text by the closest vocabulary entry (column word) of ratio max_dist."""
    text = F.trim(col(column).cast("string"))
    if abbreviations:
        table = F.create_map(*(F.lit(x) for k, v in abbreviations.items() for x in (k, v)))
        text = F.array_join(F.transform(F.split(text, r"\s+"), lambda w: F.coalesce(table[F.lower(w)], w)), " ")
    df = df.withColumn(column, text)
    if vocabulary is None:
        return df
    words = df.select(col(column).alias("k")).where("k IS NOT NULL").distinct()
    best = best_per_query(matching_pairs(words, vocabulary.select(F.col("word").alias("k")).distinct(), max_dist)).select(F.col("b").alias("__b"), F.col("a").alias("__a"))
    return df.join(best, col(column) == F.col("__b"), "left").withColumn(column, F.coalesce("__a", col(column))).drop("__b", "__a")
