import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.operators import blocktopk as bt
from replylens.operators import vectorindex as vi


def frame(spark, matrix, ids=None, kind="id long, vector array<double>"):
    ids = range(len(matrix)) if ids is None else ids
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, matrix)], kind)


def brute(queries, rows, k, exclude=True):
    """Best k by a product summed in order, then id."""
    out = {}
    for i, q in enumerate(queries):
        score = [(-float(sum(a * b for a, b in zip(q, x))), j) for j, x in enumerate(rows) if not (exclude and i == j)]
        out[i] = [(j, -s) for s, j in sorted(score)[:k]]
    return out


def result(df):
    got = {}
    for r in df.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbour_id"], r["similarity"]))
    return got


def same(got, want):
    assert got.keys() == {i for i, w in want.items() if w}
    for i, hits in got.items():
        assert [h for h, _ in hits] == [h for h, _ in want[i]]
        assert [s for _, s in hits] == pytest.approx([s for _, s in want[i]], abs=1e-12)


SHAPES = {
    "free": lambda rng: rng.standard_normal((500, 24)),                                     # no structure at all
    "common": lambda rng: rng.standard_normal((300, 16)) * 0.1 + 1,                         # one shared direction
    "copies": lambda rng: np.repeat(rng.standard_normal((40, 8)), 6, axis=0),               # ties
    "uneven": lambda rng: rng.standard_normal((200, 12)) * np.logspace(0, -12, 12) * np.logspace(-3, 3, 200)[:, None],
    "zeros": lambda rng: np.vstack([np.zeros((5, 4)), rng.integers(-1, 2, (60, 4))]),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_bounds_hold(name):
    rng = np.random.default_rng(1)
    rows = SHAPES[name](rng)
    codes, scales, errors = vi.quantise(rows)
    queries = rng.standard_normal((50, rows.shape[1]))
    product = (queries.astype(np.float32) @ codes.T.astype(np.float32)).astype(float) * scales
    reach = np.linalg.norm(queries, axis=1)[:, None] * errors + \
        np.linalg.norm(queries, axis=1)[:, None] * 2.0 ** -22 * 127 * scales * np.sqrt(rows.shape[1])
    assert (np.abs(queries @ rows.T - product) <= reach).all()


@pytest.mark.parametrize("block, index_block", [(4096, 65536), (70, 100)])
@pytest.mark.parametrize("name", sorted(SHAPES))
def test_equals_brute_force(spark, name, block, index_block):
    rows = SHAPES[name](np.random.default_rng(2))
    v = frame(spark, rows)
    index = vi.build_vector_index(v.repartition(3), row_id="id")
    same(result(vi.nearest_quantised(v, index, 4, block=block, index_block=index_block)), brute(rows, rows, 4))


def test_others_ids_nulls_and_small_tables(spark):
    rows = np.random.default_rng(3).standard_normal((30, 6))
    v = frame(spark, rows, [f"r{i:02}" for i in range(30)], "id string, vector array<float>")
    index = vi.build_vector_index(v.unionByName(spark.createDataFrame([("null", None)], v.schema)), row_id="id")
    q = frame(spark, rows[:3], kind="id long, vector array<double>").unionByName(
        spark.createDataFrame([(9, None)], "id long, vector array<double>"))
    got = result(vi.nearest_quantised(q, index, 2, exclude_self=False))
    want = brute(rows[:3], rows.astype(np.float32).astype(float), 2, exclude=False)
    assert {i: [h for h, _ in w] for i, w in got.items()} == {i: [f"r{j:02}" for j, _ in w] for i, w in want.items()}
    assert len(result(vi.nearest_quantised(q, index, 99, exclude_self=False))[0]) == 30
    assert vi.nearest_quantised(q.limit(0), index, 2).collect() == []
    assert vi.nearest_quantised(q, vi.build_vector_index(v.limit(0), row_id="id"), 2).collect() == []
    with pytest.raises(Exception, match="no number"):
        vi.build_vector_index(frame(spark, [[1.0, float("nan")]]), row_id="id")


def size_of(folder):
    return sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder) if f.endswith("parquet"))


def test_little_is_read(spark, tmp_path):
    """The scan reads about an eighth of the vectors, and few rows are scored in full."""
    rows = np.random.default_rng(4).standard_normal((20_000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    ids = np.arange(len(rows))
    import pandas as pd
    v = spark.createDataFrame(pd.DataFrame({"id": ids, "vector": list(rows)}))
    vi.build_vector_index(v, str(tmp_path), row_id="id")
    index = vi.VectorIndex(spark, str(tmp_path))
    assert size_of(tmp_path / "codes") < size_of(tmp_path / "exact") / 6
    q = v.filter("id % 400 = 0")
    close = vi.candidates(q, index, 4, "id")
    assert close.count() < 50 * 40
    assert close.inputFiles() is not None
    wanted = vi.id_ranges(close.filter("id = 0"), "hit")
    picked = index.table("exact").filter(wanted)
    plan = picked._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(id" in plan
    got = result(vi.nearest_quantised(q, index, 4))
    for i, hits in got.items():
        score = rows @ rows[i]
        score[i] = -np.inf
        assert [h for h, _ in hits] == np.argsort(-score)[:4].tolist()


def test_blocks_hold_every_row_once_and_every_pair_meets_without_a_shuffle(spark):
    """Blocks are bounded, also when all rows have one key; the cross join moves neither side."""
    rows = spark.range(500).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 3).cast("int").alias("cell"))
    for by in ((), ("cell",)):
        blocks = bt.in_blocks(rows, 64, 500, "blocks", by)
        tables = [pa.ipc.open_stream(r["rows"]).read_all() for r in blocks.collect()]
        assert sorted(i for t in tables for i in t.column("id").to_pylist()) == list(range(500))
        assert max(t.num_rows for t in tables) <= 64
        if by:
            assert all(len(set(t.column("cell").to_pylist())) == 1 for t in tables)
    out = T.StructType([T.StructField("own", T.LongType()), T.StructField("met", T.LongType())])
    met = bt.every_pair(blocks, blocks, lambda t: [t.num_rows, 0], lambda own, t: own.__setitem__(1, own[1] + t.num_rows),
                        lambda own: pa.RecordBatch.from_pydict({"own": [own[0]], "met": [own[1] * own[0]]}), out)
    assert met.agg(F.sum("met")).first()[0] == 500 * 500
    assert "Exchange hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()


def test_bounds_hold_queries_of_any_length(spark):
    """Long, tiny, zero and infinite queries in blocks find what all products say; a missing number finds nothing."""
    rng = np.random.default_rng(3)
    index = rng.normal(size=(300, 6))
    asked = np.r_[rng.normal(size=(40, 6)) * 10.0 ** rng.integers(-20, 20, (40, 1)), np.zeros((1, 6)), np.full((1, 6), np.nan)]
    at = vi.build_vector_index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index)], "tweet_id long, vector array<double>"))
    queries = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(asked)], "id long, vector array<double>")
    got = {}
    for r in vi.nearest_quantised(queries, at, 3, block=16, index_block=50).collect():
        got.setdefault(r["id"] - 1000, {})[r["rank"]] = r["neighbour_id"]
    for i, q in enumerate(asked[:41]):
        want = sorted(range(300), key=lambda j: (-(q @ index[j]), j))[:3]
        assert [got[i][r] for r in (1, 2, 3)] == want
    assert 41 not in got


def test_rows_of_one_id_share_a_block(spark):
    """Ids that stand once, twice and a hundred times: no block of queries parts the rows of one."""
    rows = spark.createDataFrame([(i,) for i in range(60) for _ in range(100 if i == 7 else 1 + i % 2)], "id long").repartition(5)
    blocks = [set(pa.ipc.open_stream(r["rows"]).read_all().column("id").to_pylist())
              for r in bt.in_blocks(rows, 8, rows.count(), "blocks", together=True).collect()]
    assert sorted(i for b in blocks for i in b) == list(range(60))
