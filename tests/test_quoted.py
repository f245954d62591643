"""The ranged CSV reader against the multi-line reader, with borders everywhere."""

import random

import pytest
from pyspark.sql import types as T

from replylens.sources import quoted
from replylens.sources.readers import read_csv

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()),
                       T.StructField("c", T.LongType())])


@pytest.fixture
def ranges(spark):
    """Sets how many bytes a range has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def set_size(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)
        spark.conf.set(names[2], 1)
    yield set_size
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lines_of_every_kind():
    after = quoted.inside_after
    assert not after('a,b,1', False) and after('a,b,1', True)
    assert after('"a', False) and not after('a"', True) and not after('"a"', False)
    assert after('""', True) and not after('"""', True) and not after('""', False) and after('"""', False)
    assert not after('a "b" c,d', False) and not after('5" wide,x', False) and after('x," y', False)
    assert not after('end" junk "more,"z"', True) and after('end","open', True) and not after('', False) and after('', True)


def test_composition_of_ranges():
    quiet = {"inside": False, "ended": True}, {"inside": True, "ended": False}
    opens = {"inside": True, "ended": True}, {"inside": False, "ended": True}
    got = quoted.compose([("f", 30, *opens), ("f", 0, *quiet), ("f", 20, *quiet), ("f", 10, *opens), ("g", 0, *quiet)])
    assert got == [("f", 0, False, None), ("f", 10, False, None), ("f", 20, True, 10), ("f", 30, True, 10), ("g", 0, False, None)]


TEXT = ('a,b,c\n1,"two\nlines",3\n"quote ""in"" it","",4\n,"comma, in",5\n\n"\n\n",x,6\n'
        'last,"""",8\n"""a""","""\n""",9\n5" wide,in "the" middle,10\nend,no line end,11')


def pieces(text, size):
    """Lines by range, as a reader of byte ranges deals them: a line belongs to where it begins."""
    out, at = {}, 0
    for line in text.split("\n"):
        out.setdefault(at // size * size if at else 0, []).append(line)
        at += len(line.encode()) + 1
    return out


def assembled(text, size):
    """The records by the two passes, without Spark."""
    dealt = pieces(text, size)
    cases = {}
    for start, lines in dealt.items():
        cutters = quoted._Cutter(False), quoted._Cutter(True)
        for line in lines:
            for c in cutters:
                c.add(line)
        cases[start] = [c.summary() for c in cutters]
    records, open_ones = [], {}
    for _, start, inside, opener in quoted.compose([(0, start, *c) for start, c in cases.items()]):
        cutter, case = quoted._Cutter(inside), cases[start][inside]
        records += [r for r in map(cutter.add, dealt[start]) if r is not None]
        if inside:
            open_ones[opener].append(case["head"] if case["ended"] else case["tail"])
        if case["tail"] is not None and (case["ended"] or not inside):
            open_ones[start] = [case["tail"]]
    return sorted(records + ["\n".join(r) for r in open_ones.values()])


def test_every_border():
    whole = assembled(TEXT, 10_000)
    assert len(whole) == 9
    for size in range(1, len(TEXT) + 2):
        assert assembled(TEXT, size) == whole


@pytest.mark.parametrize("size", [23, 64, 1000])
def test_equals_the_multi_line_reader(spark, tmp_path, ranges, size):
    (tmp_path / "t.csv").write_bytes(TEXT.encode())
    want = rows(read_csv(spark, str(tmp_path / "t.csv"), SCHEMA))
    ranges(size)
    got = quoted.read_quoted_csv(spark, str(tmp_path / "t.csv"), SCHEMA)
    assert len(want) == 8 and rows(got) == want


def write(path, table):
    quote = lambda v, always: '"' + v.replace('"', '""') + '"' if always or any(c in v for c in ',"\n\r') else v
    rng = random.Random(len(table))
    path.write_bytes("".join(",".join([quote(a, rng.random() < 0.5), quote(b, True), str(c)]) + rng.choice(["\n", "\r\n"])
                             for a, b, c in [("a", "b", "c"), *table]).encode())


@pytest.mark.parametrize("seed", range(2))
def test_any_texts_over_any_borders(spark, tmp_path, ranges, seed):
    """An empty text is read as null, as by Spark's own reader."""
    rng = random.Random(seed)
    parts = ['"', '""', ",", "\n", "\r\n", "x", "é", " ", ',"', '",', "word"]
    tables = [[("k" + "".join(rng.choices(parts, k=rng.randint(0, 8))), "".join(rng.choices(parts, k=rng.randint(0, 40))), i)
               for i in range(60)] for _ in range(3)]
    for i, table in enumerate(tables):
        write(tmp_path / f"{i}.csv", table)
    ranges(rng.randint(400, 700))
    got = quoted.read_quoted_csv(spark, str(tmp_path), SCHEMA)
    assert rows(got) == sorted(((a, b or None, c) for table in tables for a, b, c in table), key=repr)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    table = [("k", 'long "text"\n' * 30, i) for i in range(400)] + [("huge", "line\n" * 9000, 400)]
    write(tmp_path / "one.csv", table)
    ranges(10_000)
    lines = quoted._lines(spark, str(tmp_path / "one.csv"))
    assert lines.rdd.getNumPartitions() > 10
    per_task = [r["count"] for r in lines.groupBy("start").count().collect()]
    assert max(per_task) < 0.2 * sum(per_task)
    assert rows(quoted.read_quoted_csv(spark, str(tmp_path / "one.csv"), SCHEMA)) == sorted(table, key=repr)


def test_no_header_no_rows_open_end(spark, tmp_path, ranges):
    (tmp_path / "h.csv").write_text("only,a header,\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "o.csv").write_text('1,"open\nto the end')
    read = lambda name, **kw: rows(quoted.read_quoted_csv(spark, str(tmp_path / name), SCHEMA, **kw))
    assert read("h.csv") == [] and read("e.csv") == [] and read("h.csv", header=False) == [("only", "a header", None)]
    assert read("o.csv", header=False) == rows(spark.read.schema(SCHEMA).options(**quoted.OPTIONS).csv(str(tmp_path / "o.csv")))
