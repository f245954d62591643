"""JSON arrays read in byte ranges, with borders at every place."""

import json
import random

import pytest
from pyspark.sql import types as T

from replylens.sources import arrays
from replylens.sources.readers import PASSAGES, read_passages

OBJECTS = [{"id": "1", "title": 'a "q" }{', "text": "x\\"}, {"id": "2", "title": "][", "text": '\\"}{"'}, {},
           {"id": "3", "title": "é{", "text": "}}}", "more": {"deep": [{"a": "}"}, {}], "b": "{"}},
           {"id": "4", "title": "", "text": "\n\\\\"}]
TEXT = json.dumps(OBJECTS)


def dealt(text, size):
    """Parts by the range that their first byte lies in, as the text reader deals them."""
    out, at = {}, 0
    parts = text.split("}")
    for n, part in enumerate(parts):
        if n < len(parts) - 1 or part:
            out.setdefault(at // size * size, []).append(part)
        at += len(part.encode()) + 1
    return out


def assembled(text, size):
    """The objects by the two passes, without Spark."""
    ranges = dealt(text, size)
    found = []
    for start, parts in ranges.items():
        cases = arrays.Walk(False), arrays.Walk(True)
        for part in parts:
            for walk in cases:
                walk.add(part)
        found.append((0, start, *(w.summary() for w in cases)))
    records, open_ones = {}, {}
    for _, start, number, inside, depth, opener in arrays.compose(found):
        cutter = arrays.Cutter(inside, depth)
        for n, record in enumerate(r for r in map(cutter.add, ranges[start]) if r is not None):
            records[number, n] = record
        for begins, piece in cutter.left():
            open_ones.setdefault(number if begins else opener, []).append(piece)
    records |= {(number, arrays.LAST): "".join(pieces) for number, pieces in open_ones.items()}
    return [json.loads(records[k]) for k in sorted(records)]


@pytest.mark.parametrize("text", [TEXT, json.dumps(OBJECTS, indent=2, ensure_ascii=False), " [] \n",
                                  json.dumps(OBJECTS, separators=(",", ":")) + "\n"])
def test_every_border(text):
    for size in range(1, len(text.encode()) + 2):
        assert assembled(text, size) == json.loads(text)


@pytest.fixture
def ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda size: [spark.conf.set(k, str(size)) for k in keys]
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [40, 61, 100_000])
def test_one_line_is_read_by_many_tasks(spark, tmp_path, ranges, size):
    rng = random.Random(size)
    parts = ['"', "\\", "{", "}", "[", "]", ",", "é", "\n", "word ", "\\\"", ":"]
    table = [{"id": str(i), "title": None if i % 7 == 0 else "".join(rng.choices(parts, k=rng.randint(0, 6))),
              "text": "".join(rng.choices(parts, k=rng.randint(0, 30)))} for i in range(60)]
    path = tmp_path / "one.json"
    path.write_text(json.dumps(table, ensure_ascii=size % 2 > 0), encoding="utf-8")
    ranges(size)
    if size < 100:
        assert spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 20
    got = [r.asDict() for r in read_passages(spark, str(path)).orderBy("ord").drop("ord").collect()]
    assert got == table


def test_several_files_and_broken_ones(spark, tmp_path, ranges):
    (tmp_path / "a.json").write_text('[{"id": "a"}, {"id": "b"}]')
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text('[1, "no object", {"id": 5, "title": {"x": 1}}, {"id": "e", "text": "cut o')
    ranges(16)
    rows = read_passages(spark, str(tmp_path)).collect()
    assert sorted(str(r["id"]) for r in rows) == ["5", "None", "a", "b"]
    assert read_passages(spark, str(tmp_path / "b.json")).count() == 0
    assert [f.name for f in read_passages(spark, str(tmp_path)).schema] == [*PASSAGES.names, "ord"]


def test_types_of_the_schema(spark, tmp_path):
    (tmp_path / "n.json").write_text('[{"n": 1, "l": [1, 2], "s": {"x": true}}, {"n": null}]')
    kind = T.StructType.fromDDL("n long, l array<int>, s struct<x: boolean>")
    rows = arrays.read_json_array(spark, str(tmp_path / "n.json"), kind).orderBy("ord").collect()
    assert (rows[0]["n"], rows[0]["l"], rows[0]["s"]["x"], rows[1]["n"]) == (1, [1, 2], True, None)
