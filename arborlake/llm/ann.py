"""Nearest neighbours by shifted Hilbert orderings (operator 2).

Equal vectors are one, with their smallest ids. Vectors are projected to a few
dimensions, in a form in which a large inner product is a small distance, and
get the Hilbert key of their cell, once for each of several orderings. Cells
are bounded by shifted quantiles of a bounded sample. Each ordering is range
partitioned and numbered; tiles of consecutive rows overlap by a window, so a
query meets all rows of the window around its key, also across partitions.
The windows of all orderings merge and are scored again on whole vectors.

How often the orderings found the same neighbours tells how much they miss:
with p for one ordering, 1 - (1 - p)**ORDERINGS are found. Queries whose
neighbours were found by a share of ``TRUST`` of the orderings or more are
done. The others, which is all of them where vectors have no structure that
an ordering could follow, go to an exact pass: blocks of these queries meet
blocks of all rows, which are skipped when centre and radius show that no row
can reach the windows' k-th score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.graph import cut_lineage

ORDERINGS = 4
PROJECTED = 6
CELL_BITS = 5
#: Rows on each side of a query's key, and rows of a tile.
WINDOW, TILE = 128, 2048
#: Vectors of the sample that bounds the cells.
SAMPLE = 4096
#: Mean share of the orderings that must have found a query's neighbours.
TRUST = 0.8
BLOCK = 4096
QUERY_BLOCK = 1024
EVERY = 20
K = 20
#: Scores of a matrix product are off by less than this times the norms; rows so close to the bound are scored again.
SLACK = 1e-9
#: Rows that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Rows of the table for a partition of what is written, up to the session's shuffle partitions.
PART_ROWS = 512

_HITS = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("o", pa.int32())])
_HITS_DDL = "query long, vec_id long, score double, o int"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows), by Skilling's transpose (public, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))


def parts(vectors: DataFrame) -> int:
    """Partitions that are worth a task and a file each: Hadoop starts a process for every local file, and meanwhile a JVM's memory counts twice."""
    return max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // PART_ROWS)))


def distinct(vectors: DataFrame, k: int, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (query_id, raw) of the queries, and the different vectors: vid, dim, raw (little-endian doubles), ids (the k + 1 smallest that carry the vector), asked (whether one of all its ids is a query); in ``most`` partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset : b.column(1).offset + b.num_rows + 1])
            flat, at = b.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0, np.cumsum([0, *dims])  # -0.0 is 0.0
            raw = [flat[a:z].tobytes() for a, z in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    rows = cut_lineage(usable(vectors).mapInArrow(run, "vec_id long, raw binary").distinct().coalesce(most))
    r = F.row_number().over(Window.partitionBy("raw").orderBy("vec_id"))
    first = rows.withColumn("r", r).filter(F.col("r") <= k + 1).select("raw", "vec_id", F.lit(False).alias("asked"))
    queries = rows.filter(F.col("vec_id") % every == 0)
    asked = queries.withColumn("r", r).filter(F.col("r") <= 1).select("raw", "vec_id", F.lit(True).alias("asked"))
    one = first.union(asked).groupBy("raw").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked"))
    v = cut_lineage(one.coalesce(most)).select(F.monotonically_increasing_id().alias("vid"), F.floor(F.octet_length("raw") / 8).cast("int").alias("dim"), "raw", "ids", "asked")
    return queries.withColumnRenamed("vec_id", "query_id"), v


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1)


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow on the way."""
    top = np.abs(x).max(1, keepdims=True)
    return top[:, 0] * np.sqrt(((x / np.where(top > 0, top, 1.0)) ** 2).sum(1))


def projections(x: np.ndarray, longest: float, o: int, query: bool) -> np.ndarray:
    """Directions of ordering ``o`` applied to rows: vectors get a further component that makes all of one length, queries are stretched to it."""
    rng = np.random.Generator(np.random.PCG64([x.shape[1], o]))
    way = rng.standard_normal((x.shape[1] + 1, PROJECTED))
    if query:
        top = np.abs(x).max(1, keepdims=True)
        unit = x / top
        return unit / np.sqrt((unit**2).sum(1, keepdims=True)) @ way[:-1]
    y = x / longest
    return y @ way[:-1] + np.sqrt(np.maximum(1 - (y**2).sum(1), 0))[:, None] * way[-1]


class Cells:
    """Cell bounds of each dimension and ordering, shifted quantiles of a sample."""

    def __init__(self, sample: list[bytes], longest: dict[int, float]):
        self.longest = longest
        self.cuts: dict[tuple[int, int], np.ndarray] = {}
        by_dim: dict[int, list[bytes]] = {}
        for r in sample:
            by_dim.setdefault(len(r) // 8, []).append(r)
        steps = 1 << CELL_BITS
        for d, raw in by_dim.items():
            for o in range(ORDERINGS):
                at = (np.arange(1, steps) - o / ORDERINGS) / steps
                self.cuts[d, o] = np.quantile(projections(_matrix(raw), longest[d], o, False), at, axis=0)

    def keys(self, x: np.ndarray, o: int, query: bool) -> np.ndarray:
        d = x.shape[1]
        p, cuts = projections(x, self.longest[d], o, query), self.cuts.get((d, o))
        if cuts is None:  # a dimension that the sample lacks
            return np.zeros(len(x), np.int64)
        cell = np.stack([np.searchsorted(cuts[:, i], p[:, i], side="right") for i in range(PROJECTED)], 1)
        return hilbert_key(cell, CELL_BITS)


def fit_cells(v: DataFrame) -> Cells:
    """Cells from at most ``SAMPLE`` vectors, drawn by hash, and the largest norm of each dimension."""

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best: dict[int, float] = {}
            for raw in b.column(0).to_pylist():
                best[len(raw) // 8] = max(best.get(len(raw) // 8, 0.0), float(_norm(_matrix([raw]))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], names=["dim", "norm"])

    norms = {r.dim: r.norm for r in v.select("raw").mapInArrow(longest, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm")).collect()}
    h = F.xxhash64("raw")
    slots = max(1, v.count() // (2 * SAMPLE))
    sample = [r.raw for r in v.filter(F.pmod(h, F.lit(slots)) == 0).select("raw", h.alias("h")).orderBy("h").limit(SAMPLE).collect()]
    return Cells(sample, norms)


def keyed(v: DataFrame, cells: Cells) -> DataFrame:
    """o, dim, key, vid, query: every vector in every ordering, and the asked ones once more at the key of their query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vid, dim, raw, asked = (b.column(i).to_pylist() for i in range(4))
            for d in sorted(set(dim)):
                rows = np.flatnonzero(np.array(dim) == d)
                x = _matrix([raw[i] for i in rows])
                ids, ask = np.array(vid, np.int64)[rows], np.array(asked, bool)[rows]
                for o in range(ORDERINGS):
                    for who, query in ((np.ones(len(rows), bool), False), (ask, True)):
                        if who.any():
                            n = int(who.sum())
                            yield pa.RecordBatch.from_arrays([pa.array([o] * n, pa.int32()), pa.array([d] * n, pa.int32()), pa.array(cells.keys(x[who], o, query)), pa.array(ids[who]), pa.array([query] * n, pa.bool_())], names=["o", "dim", "key", "vid", "query"])

    return v.select("vid", "dim", "raw", "asked").mapInArrow(run, "o int, dim int, key long, vid long, query boolean")


def ordered(keys: DataFrame, partitions: int) -> DataFrame:
    """The rows in ranges, each in order, with ``at`` (range and place in it). No two rows are alike, so a lost range comes back the same."""
    order = ["o", "dim", "key", "vid", "query"]
    return keys.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())


def tiled(keys: DataFrame, partitions: int, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """o, tile, place, vid, query: rows of each ordering in tiles of ``TILE``, the last and first ``WINDOW`` places also in the next tile. ``keep`` holds the ordered rows, which are read twice."""
    put = keep(ordered(keys, partitions))
    part = F.shiftright("at", 33)
    counts = put.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    past = counts.withColumn("past", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # a row for each partition
    rows = put.withColumn("part", part).join(F.broadcast(past), "part").withColumn("place", F.col("past") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    own, inside = F.floor(F.col("place") / TILE).cast("long"), F.pmod("place", F.lit(TILE))
    near = F.when(inside < WINDOW, F.array(own, own - 1)).when(inside >= TILE - WINDOW, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.select("o", "dim", "place", "vid", "query", F.explode(near).alias("tile"))


def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q, each summed alike, so equal vectors get equal scores."""
    with np.errstate(all="ignore"):  # beyond the range of doubles they are infinite
        return (x * q).sum(axis=1)


def top(ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids and their best scores, ties to the smaller id."""
    by = np.lexsort((ids, -s))
    first = np.unique(ids[by], return_index=True)[1]
    if len(first) < len(by):
        by = by[np.sort(first)]
    return ids[by[:k]], s[by[:k]]


class Ids:
    """The ids of several vectors end to end."""

    def __init__(self, flat: np.ndarray, count: np.ndarray):
        self.flat, self.count, self.start = flat, count, np.cumsum(count) - count

    @classmethod
    def of(cls, ids: list[list[int]]) -> Ids:
        return cls(np.array([i for x in ids for i in x], np.int64), np.array(list(map(len, ids)), np.int64))

    def best(self, rows: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.count[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return top(self.flat[at], np.repeat(s, n), k)


def _hits(found: list[tuple[int, np.ndarray, np.ndarray]], o: int) -> pa.RecordBatch:
    q = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
    cat = lambda i, kind: np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(cat(1, np.int64)), pa.array(cat(2, float)), pa.array(np.full(len(q), o, np.int32))], schema=_HITS)


def _windows(k: int):
    """Scores the queries of each tile against the rows around them; rows come tile by tile, in order."""

    def solved(o: int, tile: int, rows: list[tuple]) -> pa.RecordBatch:
        place, vid, query, dim, raw, ids = zip(*rows)
        place, dim, query = np.array(place), np.array(dim), np.array(query)
        found = []
        for d in np.unique(dim):
            data = np.flatnonzero((dim == d) & ~query)
            if not len(data):
                continue
            x, names = _matrix([raw[i] for i in data]), Ids.of([ids[i] for i in data])
            for i in np.flatnonzero(query & (dim == d) & (place // TILE == tile)):
                lo, hi = np.searchsorted(place[data], [place[i] - WINDOW, place[i] + WINDOW + 1])
                near = np.arange(lo, hi)
                if len(near):
                    found.append((vid[i], *names.best(near, score(x[near], np.frombuffer(raw[i])), k + 1)))
        return _hits(found, o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for o, tile, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (o, tile) != now:
                    if rows:
                        yield solved(*now, rows)
                    now, rows = (o, tile), []
                rows.append(row)
        if rows:
            yield solved(*now, rows)

    return run


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Packed blocks of vectors of one dimension: dim, vids, raw, ids, counts, centre, radius, bounds."""
    fields = [("dim", pa.int32()), *((n, pa.binary()) for n in ("vids", "raw", "ids", "counts", "centre")), ("radius", pa.float64()), ("bound", pa.binary())]
    schema = pa.schema(fields)

    def packed(part: list[tuple]) -> pa.RecordBatch:
        x, names = _matrix([r[1] for r in part]), Ids.of([r[2] for r in part])
        with np.errstate(all="ignore"):
            c = (x / len(x)).sum(0)
            radius = float(_norm(x - c).max())
        bound = np.array([r[3] if r[3] is not None else -np.inf for r in part])
        row = (x.shape[1], np.array([r[0] for r in part], np.int64).tobytes(), x.tobytes(), names.flat.tobytes(), names.count.tobytes(), c.tobytes(), radius, bound.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                part = held.setdefault(len(row[1]), [])
                part.append(row)
                if len(part) == size:
                    yield packed(held.pop(len(row[1])))
        for part in held.values():
            yield packed(part)

    return rows.mapInArrow(run, "dim int, vids binary, raw binary, ids binary, counts binary, centre binary, radius double, bound binary")


def _certify(k: int):
    """Scores pairs of a query block (q_*) and a row block, unless the bound rules the pair out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q = np.frombuffer(r["q_raw"]).reshape(-1, r["dim"])
                vid, bound, c = np.frombuffer(r["q_vids"], np.int64), np.frombuffer(r["q_bound"]), np.frombuffer(r["centre"])
                with np.errstate(all="ignore"):
                    norm = _norm(q)
                    live = np.flatnonzero(~(q @ c + norm * r["radius"] + SLACK * (1 + norm) < bound))  # what cannot be told stays
                if not len(live):
                    continue
                x, names = np.frombuffer(r["raw"]).reshape(-1, r["dim"]), Ids(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int64))
                alone = len(names.flat) == len(x) == len(np.unique(names.flat))  # an id a vector, a vector an id
                found = []
                with np.errstate(all="ignore"):
                    slack = SLACK * (1 + norm * _norm(x).max())
                    for i, row in zip(live, q[live] @ x.T):
                        near = np.flatnonzero(~(row < bound[i] - slack[i]))
                        if alone and len(near) > 4 * (k + 1):
                            low = np.partition(row[near], -(k + 1))[-(k + 1)]
                            near = near[~(row[near] < low - 2 * slack[i])]
                        if len(near):
                            found.append((vid[i], *names.best(near, score(x[near], q[i]), k + 1)))
                yield _hits(found, -1)

    return run


def best(hits: DataFrame, k: int) -> DataFrame:
    """query, rank, vec_id, score, found (orderings that found it): the k best distinct ids of each query, ties to the smaller one."""
    once = hits.groupBy("query", "vec_id").agg(F.max("score").alias("score"), F.count_if(F.col("o") >= 0).alias("found"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "vec_id", "score", "found")


def _small(df: DataFrame) -> DataFrame:
    """Marks a side for broadcast when a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def windows(v: DataFrame, k: int) -> DataFrame:
    """What the orderings alone find: query (vid), rank, vec_id, score, found; k + 1 ids, as a query's own is among them."""
    partitions, most, held = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), v.rdd.getNumPartitions(), []
    keep = lambda df: held.append(df.persist(StorageLevel.MEMORY_AND_DISK)) or held[-1]
    tiles = tiled(keyed(v, fit_cells(v)), partitions, keep).join(v.select("vid", "raw", "ids"), "vid").select("o", "tile", "place", "vid", "query", "dim", "raw", "ids")
    dealt = tiles.repartition(partitions, "o", "tile").sortWithinPartitions("o", "tile", "place")
    try:
        return cut_lineage(best(dealt.mapInArrow(_windows(k), _HITS_DDL), k + 1).coalesce(most))
    finally:
        for df in held:
            df.unpersist()


def exact(v: DataFrame, doubtful: DataFrame, k: int) -> DataFrame:
    """Hits of the queries (vid, bound) against all rows, in blocks."""
    partitions = v.rdd.getNumPartitions()
    asked = v.join(_small(doubtful), "vid").select("vid", "raw", "ids", "bound")
    q = _blocks(asked.repartition(max(1, partitions // 4)), QUERY_BLOCK).select("dim", *(F.col(c).alias(f"q_{c}") for c in ("vids", "raw", "bound")))
    x = _blocks(v.select("vid", "raw", "ids", F.lit(None).cast("double").alias("bound")), BLOCK).drop("bound", "vids")
    # every query block meets every row block of its dimension: salted, so no dimension's pairs fall to one task
    sides = max(1, partitions // 2)
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    x = x.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(sides)).cast("int"))
    pairs = q.join(x, ["dim", "salt"]).select("dim", "q_vids", "q_raw", "q_bound", "raw", "ids", "counts", "centre", "radius")
    return pairs.mapInArrow(_certify(k), _HITS_DDL)


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows, by inner product, of each row whose vec_id is divisible by ``every``.

    Vectors that are null, zero or hold nulls or non-finite numbers take no
    part; a query meets rows of its own dimension. Ties go to the smaller
    vec_id; of rows with equal vec_id the best counts, so repeated rows change
    nothing. An empty table gives no rows; other columns are ignored.
    """
    most = parts(vectors)
    queries, v = distinct(vectors, k, every, most)
    near = windows(v, k)
    seen = near.groupBy("query").agg((F.avg("found") / ORDERINGS).alias("share"), F.count("*").alias("n"), F.min("score").alias("bound"))
    sure = seen.filter((F.col("share") >= TRUST) & (F.col("n") == k + 1)).select(F.col("query").alias("vid"))
    doubtful = v.filter("asked").select("vid").join(sure, "vid", "left_anti").join(seen.filter(F.col("n") == k + 1).select(F.col("query").alias("vid"), "bound"), "vid", "left")
    doubtful = cut_lineage(doubtful.coalesce(most))
    found = near.select("query", "vec_id", "score", F.lit(0).alias("o"))
    if not doubtful.isEmpty():
        found = best(found.union(exact(v, doubtful, k)), k + 1)
    asked = queries.join(v.filter("asked").select("raw", F.col("vid").alias("query")), "raw").select("query_id", "query")
    merged = asked.join(found.select("query", "vec_id", "score"), "query").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").coalesce(most)
