"""JSON arrays in byte ranges: one file, even one line, is read by many tasks.

A text may hold any bracket, so a task that starts in the middle of a file cannot know whether
it stands in a text, or how deep in objects. Both cases of the former are read in a first pass: whether the
range leaves off in a text, and how much deeper. Composed in order, these settle how every range
starts. In a second pass each range cuts out the objects that lie in it; what crosses
borders is put together from the pieces, two per range at most.

Ranges are those of the text reader, cut at closing braces: such a brace is never escaped, so no
escape is open where a range starts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.session import materialise

LAST = (1 << 33) - 1        # the place of an object that goes on in the next range
_REST_OF_TEXT = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_TEXT = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)


def after(part: str, inside: bool) -> tuple[bool, int]:
    """(in a text, braces deeper) after ``part`` and the closing brace that ended it, given whether it began in a text."""
    if inside:
        rest = _REST_OF_TEXT.match(part)
        if not rest:
            return True, 0
        part = part[rest.end():]
    if '"' in part:
        part = _TEXT.sub("", part)
        open_text = part.find('"')
        if open_text >= 0:
            return True, part.count("{", 0, open_text)
    return False, part.count("{") - 1


class Walk:
    """One start case of a range: how it goes on, relative to the depth where it starts."""

    def __init__(self, inside: bool):
        self.inside, self.depth, self.least = inside, 0, 0

    def add(self, part: str) -> None:
        self.inside, more = after(part, self.inside)
        self.depth += more
        self.least = min(self.least, self.depth)

    def summary(self) -> dict:
        return {"inside": self.inside, "depth": self.depth, "least": self.least}


class Cutter:
    """Cuts the objects of a range whose start is known; ``head`` ends the object of a former range."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, depth
        self.foreign = depth > 0
        self.head: str | None = None
        self.parts: list[str] = []

    def add(self, part: str) -> str | None:
        """The object that ``part`` and its brace complete, unless it began before the range."""
        if not self.depth and not self.inside:
            begin = part.find("{")
            if begin < 0:               # what stands between objects, or after the last
                return None
            part = part[begin:]
        self.parts.append(part)
        self.inside, more = after(part, self.inside)
        self.depth += more
        if self.depth or self.inside:
            return None
        whole, self.parts = "}".join(self.parts) + "}", []
        if self.foreign:
            self.foreign, self.head = False, whole
            return None
        return whole

    def left(self) -> list[tuple[bool, str]]:
        """(begins an object, text) of what crosses the borders of the range."""
        out = [(False, self.head)] if self.head is not None else []
        if self.parts:
            out.append((not self.foreign, "}".join(self.parts) + "}"))
        return out


def compose(summaries) -> list[tuple[int, int, int, bool, int, int | None]]:
    """(file, start, number, inside, depth, opener) of every range in order: how it starts, and which range
    began the object open there. ``summaries`` are (file, start, outside, within)."""
    out, before = [], None
    inside, depth, opener = False, 0, None
    for number, (file, start, outside, within) in enumerate(sorted(summaries, key=lambda s: (s[0], s[1]))):
        if file != before:
            before, inside, depth, opener = file, False, 0, None
        out.append((file, start, number, inside, depth, opener))
        case = within if inside else outside
        ended = depth + case["least"] <= 0 or not depth
        inside, depth = case["inside"], max(0, depth + case["depth"])
        if depth and ended:
            opener = number
        elif not depth:
            opener = None
    return out


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="}").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _stretches(batch):
    """((file, start), parts) of the ranges in a batch; a task reads one range after the other."""
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start")])
    cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield (int(keys[0, lo]), int(keys[1, lo])), batch.column("value").slice(lo, hi - lo).to_pylist()


def range_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One row per byte range: (file, start, outside, within), how it goes on for either start."""
    case = pa.struct([("inside", pa.bool_()), ("depth", pa.int64()), ("least", pa.int64())])
    arrow = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("outside", case), ("within", case)])

    def run(batches):
        here, walks = None, ()

        def row():
            return pa.RecordBatch.from_pylist(
                [{"file": here[0], "start": here[1], "outside": walks[0].summary(), "within": walks[1].summary()}],
                schema=arrow)

        for batch in batches:
            for key, parts in _stretches(batch):
                if key != here:
                    if here:
                        yield row()
                    here, walks = key, (Walk(False), Walk(True))
                for part in parts:
                    for walk in walks:
                        walk.add(part)
        if here:
            yield row()

    struct = "struct<inside: boolean, depth: long, least: long>"
    return _parts(spark, path).mapInArrow(run, f"file long, start long, outside {struct}, within {struct}")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO11: the objects of files that each hold a JSON array, with ``ord``, their order in the file.

    ``ord`` rises in a file and is no running number. An object that does not parse, or that the file cuts off, is
    a row of nulls. Elements that are no objects are left out. Files of one object, or of
    objects one after the other, are read too. Three numbers per range pass through the driver.
    """
    states = compose(map(tuple, range_summaries(spark, path).collect()))
    begins = spark.sparkContext.broadcast({(s[0], s[1]): s[2:] for s in states})

    def cut(batches):
        here, cutter, n, number, opener = None, None, 0, 0, None

        def left():
            # a piece goes to the range that began its object
            rows = [(number if begin else opener, number, text) for begin, text in cutter.left()]
            return pa.RecordBatch.from_arrays(
                [pa.array([LAST] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=names)

        names = ["place", "opener", "number", "record"]
        for batch in batches:
            for key, parts in _stretches(batch):
                if key != here:
                    if here:
                        yield left()
                    if key not in begins.value:
                        raise RuntimeError("a file was cut into other ranges in the first pass")
                    number, inside, depth, opener = begins.value[key]
                    here, cutter, n = key, Cutter(inside, depth), 0
                records = [r for r in map(cutter.add, parts) if r is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n, n + len(records)), pa.int64()), pa.array([number] * len(records), pa.int64()),
                     pa.array([number] * len(records), pa.int64()), pa.array(records, pa.string())], names=names)
                n += len(records)
        if here:
            yield left()

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    order = (F.col("opener") * (LAST + 1) + F.col("place")).alias("ord")
    found = materialise(_parts(spark, path).mapInArrow(cut, "place long, opener long, number long, record string")
                        .withColumn("r", F.when(F.col("place") != LAST, F.from_json("record", columns)))
                        .withColumn("record", F.when(F.col("place") == LAST, F.col("record"))), "objects")
    whole = found.filter(F.col("place") != LAST).select("r", order)
    pieces = F.sort_array(F.collect_list(F.struct("number", "record")))
    across = (found.filter(F.col("place") == LAST).groupBy("opener", "place")
              .agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "").alias("record"))
              .select(F.from_json("record", columns).alias("r"), order))
    return whole.unionByName(across).select("r.*", "ord")
