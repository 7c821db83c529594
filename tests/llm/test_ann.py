import collections

import numpy as np
import pytest

from arborlake.llm import ann

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=20, every=20):
    """query_id -> [(vec_id, score)] by scoring all rows; of rows with one id the best counts."""
    out = {}
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    by_dim = collections.defaultdict(list)
    for i, v in fine:
        by_dim[len(v)].append((i, v))
    for i, q in fine:
        if i % every:
            continue
        ids, x = zip(*by_dim[len(q)])
        best = out.setdefault(i, {})
        for j, s in zip(ids, (np.stack(x) * q).sum(1)):
            if j != i:
                best[j] = max(best.get(j, -np.inf), s)
    return {i: sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k] for i, found in out.items() if found}


def searched(spark, rows, columns=SCHEMA):
    df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, columns)
    got = collections.defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def listed(x):
    return [(i, v.tolist()) for i, v in enumerate(x)]


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 8))
    x[40:60] = x[20]
    rows = listed(x) + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [None] * 8), (480, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    rows += [(500 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 3)))] + [(600, [1e200] * 5), (601, [-1e160] * 5), (620, [1e-200] * 5), (640, [2.0])]
    want = brute(rows)
    assert searched(spark, rows) == want and 640 not in want
    assert searched(spark, spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS vid", "'x' AS raw", "2 AS o")) == want
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 8))
    rows = listed(x)
    rows += [(7, (x[7] * 9).tolist())] * 400 + [rows[20]] * 100 + [(i, x[33].tolist()) for i in range(1000, 1500)] + [(8, v.tolist()) for v in rng.standard_normal((60, 8)) * 5]
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert searched(spark, df.union(df)) == want and len(want) == 15 + 25


@pytest.mark.parametrize("kind", ["clusters", "curve"])
def test_windows_alone_find_neighbours_where_there_is_structure(spark, monkeypatch, kind):
    """Without the exact pass: recall of the orderings, and of the queries that they are trusted with."""
    rng = np.random.default_rng(10)
    if kind == "clusters":
        centres = rng.standard_normal((200, 32)) * 2
        x = centres[rng.integers(0, 200, 8000)] + 0.1 * rng.standard_normal((8000, 32))
    else:
        t = rng.uniform(0, 6, 8000)
        x = np.stack([np.sin((1 + i / 3) * t + i) for i in range(32)], 1) + 0.005 * rng.standard_normal((8000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, calls = listed(x), []
    monkeypatch.setattr(ann, "exact", lambda v, doubtful, k: calls.append(doubtful.count()) or v.sparkSession.createDataFrame([], ann._HITS_DDL))
    got = searched(spark, spark.createDataFrame(rows, SCHEMA).repartition(8))
    r = recall(got, brute(rows))
    print(kind, "recall of the windows", r, "queries left to the exact pass", calls, "of", len(got))
    assert r >= 0.9 and sum(calls) < 0.2 * 400


def test_queries_without_structure_are_not_trusted_to_the_windows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in d.collect()]
    got, want = searched(spark, d), brute(rows)
    assert recall(got, want) > 0.995


def test_tiles_hold_the_whole_window_of_every_place(spark, monkeypatch):
    monkeypatch.setattr(ann, "TILE", 50)
    monkeypatch.setattr(ann, "WINDOW", 20)
    keys = spark.range(1000).selectExpr("0 AS o", "3 AS dim", "id * 7 % 1000 AS key", "id AS vid", "id % 3 = 0 AS query").repartition(13)
    tiles = collections.defaultdict(set)
    for r in ann.tiled(keys, 13).collect():
        tiles[r.tile].add(r.place)
    for place in range(1000):
        assert set(range(max(0, place - 20), min(1000, place + 21))) <= tiles[place // 50]


def test_few_rows_are_not_written_in_many_files(spark, monkeypatch):
    """A table of few rows under many shuffle partitions: as many partitions are written and returned as its rows are worth, and nothing stays cached."""
    rng = np.random.default_rng(11)
    rows, written, cut = listed(rng.standard_normal((1500, 8))), [], ann.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(ann, "cut_lineage", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    cached = lambda: sorted(spark.sparkContext._jsc.getPersistentRDDs())
    df, held = spark.createDataFrame(rows, SCHEMA), cached()
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        parts = ann.search(df).rdd.getNumPartitions()
        got = searched(spark, df)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert parts <= 3 and max(written) <= 3
    assert got == brute(rows)
    assert cached() == held
