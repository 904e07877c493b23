"""Delimited text in splits, quoted newlines included.

A file whose every line has its quotes in pairs is read by Spark's own reader line by line. In any other, a line may lie
within a quoted value that began in an earlier split, so:

1. Each split tells whether a quoted value is open at its end, both if none is open at its start and if one is. Only lines
   with a quote count for that; the text of the table isn't moved.
2. Per file, these pairs are combined in the order of the splits, one row each. What is left are the few splits at whose
   end the state changes.
3. Each split joins its lines to records by its true state. A record that splits cut comes as fragments, two a split at
   most, which are joined by file and place.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What is left of a quoted value, its closing quote included.
CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
#: Values over several splits that are named in a condition; beyond that many, workers read all splits for fragments.
NAMED = 1000

#: For each file, in order: the splits at whose end the state changes, and the state from there on.
Changes = Mapping[int, tuple[list[int], list[bool]]]


def open_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted value is open at the end of a line. Quotes count where a value begins, or within a quoted one."""
    at = 0
    while True:
        if inside:
            m = CLOSING.match(line, at)
            if m is None:
                return True
            at, inside = m.end(), False
        elif at == 0 and line.startswith('"'):
            at, inside = 1, True
        else:
            at = line.find(sep + '"', max(at, 0))
            if at < 0:
                return False
            at, inside = at + len(sep) + 1, True


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines, in order within their split, with the file and the place where the split begins."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def is_plain(spark: SparkSession, path: str) -> bool:
    """Whether each line is a record of its own: quotes in pairs, no carriage return but at the end of a line."""
    lines = split_lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    lone = F.instr("value", "\r").between(1, F.length("value") - 1)
    return lines.where((quotes % 2 != 0) | lone).isEmpty()


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """(file, start, lines) of each split that a batch has lines of."""
    file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
    new = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *new], [*new, len(file)], strict=True):
        if a < b:
            yield int(file[a]), int(start[a]), batch.column("value").slice(a, b - a)


def state_changes(spark: SparkSession, path: str, sep: str) -> Changes:
    """The splits at whose end the state changes; splits whose values all close are none."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for batch in batches:
            for file, start, lines in runs(batch):
                if not rows or rows[-1][:2] != [file, start]:
                    rows.append([file, start, False, True])
                last = rows[-1]
                for line in lines.to_pylist():
                    same = last[2] == last[3]
                    last[2] = open_after(line, last[2], sep)
                    last[3] = last[2] if same else open_after(line, last[3], sep)
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "closed", "opened"), r, strict=True)) for r in rows], pa.schema([("file", pa.int64()), ("start", pa.int64()), ("closed", pa.bool_()), ("opened", pa.bool_())]))

    def combine(splits: pd.DataFrame) -> pd.DataFrame:
        state, out = False, []
        for row in splits.sort_values("start").itertuples():
            after = bool(row.opened if state else row.closed)
            if after != state:
                out.append((row.file, row.start, after))
            state = after
        return pd.DataFrame(out, columns=["file", "start", "state"])

    quoted = split_lines(spark, path).where(F.contains("value", F.lit('"')))
    told = quoted.mapInArrow(both, "file long, start long, closed boolean, opened boolean")
    changes = told.groupBy("file").applyInPandas(combine, "file long, start long, state boolean").orderBy("file", "start").collect()
    out: dict[int, tuple[list[int], list[bool]]] = {}
    for r in changes:
        starts, states = out.setdefault(r.file, ([], []))
        starts.append(r.start)
        states.append(r.state)
    return out


def open_before(changes: Changes, file: int, start: int) -> bool:
    starts, states = changes.get(file, ([], []))
    at = bisect_left(starts, start)
    return states[at - 1] if at else False


class Joiner:
    """Joins the lines of a split to records. kind 0: a whole one; 1: what goes on from the splits before; 2: what is still
    open at the split's end."""

    def __init__(self, file: int, start: int, inside: bool, sep: str) -> None:
        self.file, self.start, self.sep = file, start, sep
        self.inside, self.lead = inside, inside
        self.held: list[str] = []
        self.header = start == 0  # the next record is a header

    def add(self, lines: pa.Array) -> Iterator[tuple[pa.Array, int]]:
        before = np.zeros(len(lines), dtype=bool)
        at = 0
        for i in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)):
            before[at : i + 1] = self.inside
            self.inside, at = open_after(lines[i].as_py(), self.inside, self.sep), i + 1
        before[at:] = self.inside
        begins = np.flatnonzero(~before)
        end = begins[-1] if self.inside and len(begins) else len(lines)  # the open record that stays
        if len(begins) == 0 or begins[0] > 0:
            self.held += lines.slice(0, begins[0] if len(begins) else len(lines)).to_pylist()
        if self.held and (len(begins) or not self.inside):
            yield from self.close()
        begins = begins[begins < end]
        if len(begins):
            cuts = pa.array([*begins, end], pa.int32())
            whole = pc.binary_join(pa.ListArray.from_arrays(cuts, lines), "\n") if len(begins) < end - begins[0] else lines.slice(begins[0], end - begins[0])
            yield whole.slice(1) if self.header else whole, 0
            self.header = False
        if end < len(lines):
            self.held = lines.slice(end).to_pylist()

    def close(self) -> Iterator[tuple[pa.Array, int]]:
        if not self.header or self.lead:
            yield pa.array(["\n".join(self.held)]), int(self.lead)
        self.header, self.held, self.lead = self.header and self.lead, [], False

    def finish(self) -> Iterator[tuple[pa.Array, int]]:
        if self.held:
            yield pa.array(["\n".join(self.held)]), 1 if self.lead else 2


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(record) of all files, without headers."""
    changes = state_changes(spark, path, sep)
    held = spark.sparkContext.broadcast(changes)

    def joined(fragments: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(found: Iterator[tuple[pa.Array, int]]) -> Iterator[pa.RecordBatch]:
                for text, kind in found:
                    if len(text) and (kind > 0) == fragments:
                        n = len(text)
                        columns = [text, pa.array(np.full(n, now.file)), pa.array(np.full(n, now.start)), pa.array(np.full(n, kind, dtype=np.int32)), pa.array([now.header] * n)]
                        yield pa.RecordBatch.from_arrays(columns, names=["record", "file", "start", "kind", "header"])

            now: Joiner | None = None
            for batch in batches:
                for file, start, lines in runs(batch):
                    if lines.null_count:
                        continue
                    if now is None or (now.file, now.start) != (file, start):
                        if now is not None:
                            yield from out(now.finish())
                        now = Joiner(file, start, open_before(held.value, file, start), sep)
                    yield from out(now.add(lines))
            if now is not None:
                yield from out(now.finish())

        return run

    schema = "record string, file long, start long, kind int, header boolean"
    lines = split_lines(spark, path)
    whole = lines.mapInArrow(joined(False), schema).select("record")
    if not changes:
        return whole
    # Only splits from one that opens a value to the one that closes it have fragments. The text of others becomes null; as a
    # filter, this would choose among files, and fewer files are split at other places.
    spans = [(file, a, b) for file, (starts, _) in changes.items() for a, b in zip(starts[::2], [*starts[1::2], 1 << 62], strict=False)]
    within = F.lit(len(spans) > NAMED)
    for file, a, b in spans[: NAMED + 1]:
        within = within | ((F.col("file") == file) & F.col("start").between(a, b))
    fragments = lines.withColumn("value", F.when(within, F.col("value"))).mapInArrow(joined(True), schema)
    order = Window.partitionBy("file").orderBy("start", "kind")
    numbered = fragments.withColumn("number", F.sum((F.col("kind") == 2).cast("long")).over(order))
    pieces = numbered.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("p"), F.max(F.col("header") & (F.col("kind") == 2)).alias("header"))
    return whole.union(pieces.where("NOT header").select(F.array_join(F.col("p.record"), "\n").alias("record")))


def read_quoted(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Text columns of delimited files with header whose quoted values may hold newlines, read in splits.

    Records end by \\n or \\r\\n, a quote within a quoted value is doubled. Blank lines are no records; short records are
    filled with null, long ones cut. A value that never closes takes what is left of its file. Of several files each has
    its header, of which the first counts; a folder of empty files has no columns.
    """
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if is_plain(spark, path):
        return spark.read.options(**options).csv(path, header=True)
    names = spark.read.options(**options).csv(path, header=True, multiLine=True).columns
    ended = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record")).alias("record")
    rows = records(spark, path, sep).select(ended).where(F.trim("record") != "")
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    return rows.select(F.from_csv("record", schema, {**options, "multiLine": "true"}).alias("r")).select("r.*")
