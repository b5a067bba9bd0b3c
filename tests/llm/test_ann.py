import numpy as np
import pytest

from actweave.llm import ann


def brute(rows, every, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out, seen = [], {}
    for i, v in ok:
        if i % every == 0:
            seen[i] = min(seen.get(i, v), v)
    for q, v in seen.items():
        s = sorted((-float(np.sum(np.array(v, float) * np.array(w, float))), j) for j, w in ok if j != q and len(w) == len(v))[:k]
        out += [(q, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block", [10**7, 900])
def test_matches_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(300, 400)]  # a large group of copies
    rows += [(None, rows[0][1]), (400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (420, [1.0, 2.0]), (421, [3.0, 1.0]), (440, [])]
    rows += [(20, rows[5][1]), (7, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.nearest(df, block_bytes=block).collect()))
    want = brute(rows, 20, 20)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=0, atol=1e-12)
    assert ann.nearest(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 64)) * 10.0 ** rng.integers(-3, 4, (50, 1)), rng.normal(size=(60, 64))
    x, off = ann.bounds(ann.Quantised(a), ann.Quantised(b), slice(None), slice(None))
    assert (np.abs(x - a @ b.T) <= off).all() and (off < 0.05 * np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))).all()


def test_oracle(spark):
    import duckdb

    path = "/root/testdata/sf0.001/embeddings.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert sorted(map(tuple, ann.nearest(spark.read.parquet(path)).collect())) == sorted(map(tuple, db.execute(ann.ORACLE).fetchall()))
