import collections
import random

import numpy as np
import pytest

from arborlake.llm import ngram_join, textvec
from tests.llm.test_llm import DOCS, ODD, brute_links, docs, near_copies


def classes(rows):
    """Row number -> (n_shingles, smallest linked id), by comparing all texts; ids may be null or stand on several texts."""
    found = brute_links([t for _, t in rows])
    least = {}
    for i, (n, root) in found.items():
        if rows[i][0] is not None:
            least[root] = min(least.get(root, 1 << 60), rows[i][0])
    return {i: (n, least.get(root) if n else rows[i][0]) for i, (n, root) in found.items()}, {i: root for i, (_, root) in found.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def mixed_rows(rng):
    texts = near_copies(rng, 20) + near_copies(rng, 20) + ["five words are one shingle", "", None, " ", "a b"]
    rows = [(rng.choice([None, rng.randint(0, 30)]), t) for t in texts for _ in range(rng.choice([1, 1, 3]))]
    return rows + [(7, "same id but another text here " + str(i)) for i in range(3)]


@pytest.mark.parametrize("limits", [{}, {"GROUP": 3}, {"HOT": 4, "SHARED": 2}, {"BLOCK": 4, "HOT": 1, "SHARED": 2}, {"BLOCK_BYTES": 2000}, {"HELD": 200, "BUCKET": 100}])
def test_ids_that_are_null_or_repeated(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(ngram_join, k, v)
    rows = mixed_rows(random.Random(31))
    want, _ = classes(rows)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(frame(spark, rows)).collect())
    assert got == collections.Counter((rows[i][0], *want[i]) for i in want)


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(32)
    rows = mixed_rows(rng)
    rows += rows[:5] + [(None, "the only text without an id that is long enough"), (40, "x y z x y z q"), (40, "x y z x y z q")]
    _, root = classes(rows)
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_first(frame(spark, rows)).collect()]
    empty = [r for r in rows if not (r[1] or "").split()]
    assert collections.Counter(r for r in kept if not (r[1] or "").split()) == collections.Counter(empty)
    by_root = collections.defaultdict(set)
    for i, r in enumerate(rows):
        if (r[1] or "").split():
            by_root[root[i]].add(r)
    full = [r for r in kept if (r[1] or "").split()]
    assert len(full) == len(by_root)
    for members in by_root.values():
        (mine,) = [r for r in full if r in members]
        ids = [i for i, _ in members if i is not None]
        assert mine[0] == (min(ids) if ids else None)
    assert ngram_join.keep_first(frame(spark, [])).count() == 0
    twin = frame(spark, [(1, "a b c d e f")]).withColumn("component_id", textvec.F.lit("clash")).withColumn("n", textvec.F.lit(1))
    assert ngram_join.keep_first(twin.union(twin)).collect() == twin.collect()


def test_sent_bytes_do_not_depend_on_the_number_of_buckets(spark):
    rng = random.Random(33)
    long = docs(spark, [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30_000))])
    none = np.zeros(0, np.uint64)

    def sent(buckets):
        return sum(len(r.tok) + len(r.key) + len(r.size) for r in ngram_join._send(long, none, none, none, buckets).collect())

    assert sent(16) == sent(1000) == sent(50_000) < len(long.first().text)


def test_groups_equal_brute_force():
    rng = np.random.default_rng(34)
    tok, key = rng.integers(0, 40, 600).astype(np.uint64), rng.integers(0, 30, 600)
    size = rng.integers(50, 200, 30)
    sig, k, n = ngram_join.groups_of(tok, key, size[key])
    got = collections.defaultdict(set)
    for s, x in zip(sig, k):
        got[s].add(x)
    want = set()
    for t in np.unique(tok):
        members = sorted({(size[x], x) for x in key[tok == t]})
        run = members[:1]
        for m in members[1:]:
            if 5 * run[-1][0] < 4 * m[0]:
                want.add(frozenset(x for _, x in run))
                run = []
            run.append(m)
        want.add(frozenset(x for _, x in run))
    assert {frozenset(x) for x in got.values()} == {w for w in want if len(w) > 1} and (n == size[k]).all()


def test_long_texts(spark):
    rng = random.Random(35)
    words = [f"w{i}" for i in range(300_000)]
    rng.shuffle(words)
    a, b = " ".join(words), " ".join(words[20:])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(spark, [a, b, "x" * 5_000_000, *ODD])).collect()}
    assert got[0] == (299_996, 0) and got[1] == (299_976, 0) and got[2] == (1, 2)
