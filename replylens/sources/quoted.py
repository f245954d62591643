"""Quoted CSV in byte ranges: one file is read by many tasks, whatever its quoted texts hold.

A line end is the end of a record only outside quotes, which a task that starts in the middle
of a file cannot know. So every range is first read for both cases: where it would leave off
if it started outside quotes, and if inside. The ranges of a file are then composed in order, which settles how
each one starts. In a second pass every range cuts its own records, and Spark's CSV
parser reads them. A record over a border is put together from the pieces that its ranges
have left over; there are two per range at most.

Lines are read by the text reader, so ranges are those of ``spark.sql.files.maxPartitionBytes`` and
files may lie in any store that Spark reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.session import materialise

OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}
SUMMARY = ("file long, start long, " + ", ".join(
    f"{c} struct<inside: boolean, ended: boolean, head: string, tail: string>" for c in ("outside", "within")))


def inside_after(line: str, inside: bool) -> bool:
    """Whether the next line starts inside quotes, given whether this one does.

    A field is quoted if its first character is a quote; two quotes in it are one. Whatever follows
    its closing quote up to the next comma is no quote of its own.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            close = line.find('"', at)
            while close >= 0 and line.startswith('""', close):
                close = line.find('"', close + 2)
            if close < 0:
                return True
            inside, at = False, line.find(",", close + 1) + 1
            if not at:
                return False
        elif line.startswith('"', at):
            inside, at = True, at + 1
        else:
            at = line.find(',"', at) + 1
            if not at:
                return False


class _Cutter:
    """Records of a range that starts inside quotes or not; the lines of the open one are held."""

    def __init__(self, inside: bool):
        self.inside, self.ended, self.head = inside, False, None
        self.foreign = inside           # the open record began before the range
        self.lines: list[str] = []

    def add(self, line: str) -> str | None:
        """The record that ``line`` completes, unless it began before the range or is empty."""
        self.lines.append(line)
        self.inside = inside_after(line, self.inside)
        if self.inside:
            return None
        record, self.lines = "\n".join(self.lines), []
        if self.foreign:
            self.foreign, self.head, self.ended = False, record, True
            return None
        if not record.rstrip("\r"):
            return None
        self.ended = True
        return record

    def summary(self) -> dict:
        return {"inside": self.inside, "ended": self.ended, "head": self.head,
                "tail": "\n".join(self.lines) if self.inside else None}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, as a hash of its path, and the first byte of their range."""
    return spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _stretches(batch):
    """((file, start), lines) of the ranges in a batch; a task reads one range after the other."""
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start")])
    cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield (int(keys[0, lo]), int(keys[1, lo])), batch.column("value").slice(lo, hi - lo).to_pylist()


def range_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One row per byte range: where it leaves off, and what it leaves over, for either start."""
    def run(batches):
        here, cutters = None, ()

        def row():
            return pa.RecordBatch.from_pylist(
                [{"file": here[0], "start": here[1], "outside": cutters[0].summary(), "within": cutters[1].summary()}],
                schema=arrow)

        for batch in batches:
            for key, lines in _stretches(batch):
                if key != here:
                    if here:
                        yield row()
                    here, cutters = key, (_Cutter(False), _Cutter(True))
                for line in lines:
                    for cutter in cutters:
                        cutter.add(line)
        if here:
            yield row()

    case = pa.struct([("inside", pa.bool_()), ("ended", pa.bool_()), ("head", pa.string()), ("tail", pa.string())])
    arrow = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("outside", case), ("within", case)])
    return materialise(_lines(spark, path).mapInArrow(run, SUMMARY), "ranges")


def compose(summaries) -> list[tuple[int, int, bool, int | None]]:
    """(file, start, inside, opener) of every range: how it starts, and which range began its open record.

    ``summaries`` are (file, start, outside, within) with ``inside`` and ``ended`` of either case.
    """
    out, before = [], None
    inside, opener = False, None
    for file, start, outside, within in sorted(summaries, key=lambda s: (s[0], s[1])):
        if file != before:
            before, inside, opener = file, False, None
        out.append((file, start, inside, opener))
        case = within if inside else outside
        if case["inside"] and (case["ended"] or not inside):
            opener = start          # the record still open at the end began here
        inside = case["inside"]
    return out


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """IO1, IO2, IO10: a CSV with quoted, possibly multi-line texts, read in byte ranges.

    The rows are those of the multi-line reader for files whose lines end in ``\\n`` or ``\\r\\n``. Empty lines
    are no records; the first record of a file is its header. A file that ends inside quotes has
    its rest as the last record. States of ranges, a few bytes each, pass through the driver.
    """
    found = range_summaries(spark, path)
    states = compose(map(tuple, found.select(
        "file", "start", *(F.struct(f"{c}.inside", f"{c}.ended").alias(c) for c in ("outside", "within"))).collect()))
    begins = spark.sparkContext.broadcast({(file, start): inside for file, start, inside, _ in states})

    def cut(batches):
        here, cutter, new = None, None, False
        for batch in batches:
            records, first = [], []
            for key, lines in _stretches(batch):
                if key != here:
                    if key not in begins.value:
                        raise RuntimeError("a file was cut into other ranges in the first pass")
                    here, cutter, new = key, _Cutter(begins.value[key]), key[1] == 0
                for line in lines:
                    record = cutter.add(line)
                    if record is not None:
                        records.append(record)
                        first.append(new)
                        new = False
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.array(first, pa.bool_())],
                                             names=["record", "first"])

    whole = _lines(spark, path).mapInArrow(cut, "record string, first boolean")
    # what crosses borders: the rest of the range that began the record, then the others' shares
    known = spark.createDataFrame(states, "file long, start long, inside boolean, opener long")
    ranges = found.join(F.broadcast(known), ["file", "start"]).withColumn(
        "case", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    begun = ranges.filter(F.col("case.tail").isNotNull() & (F.col("case.ended") | ~F.col("inside"))).select(
        "file", F.col("start").alias("opener"), "start", F.col("case.tail").alias("text"),
        ((F.col("start") == 0) & ~F.col("case.ended")).alias("first"))
    later = ranges.filter("inside").select("file", "opener", "start", F.coalesce(
        F.when(F.col("case.ended"), F.col("case.head")), F.col("case.tail")).alias("text"), F.lit(False).alias("first"))
    pieces = F.sort_array(F.collect_list(F.struct("start", "text")))
    across = (begun.unionByName(later).groupBy("file", "opener")
              .agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("record"),
                   F.bool_or("first").alias("first")).select("record", "first"))
    records = whole.unionByName(across)
    if header:
        records = records.filter(~F.col("first"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv(F.regexp_replace("record", "\r$", ""), columns, OPTIONS).alias("r")).select("r.*")
