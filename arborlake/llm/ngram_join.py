"""N-gram Jaccard self-join into components (operator 3).

Texts become sets of 64-bit hashes of their 5-word shingles; equal sets are
one node (a 128-bit hash), so copies never meet as pairs. Exactly:

1. A set's tokens are ordered, those that many texts share last, and only the
   first n - ceil(0.8 n) + 1 are sent out, each with the set's key and size,
   20 bytes a token: two linked sets share one of them.
2. Tokens meet in buckets. The sets that share one, less those of sizes that
   cannot link, are a group; equal groups count once. Groups fetch the hashed
   bitmaps of their sets, once a group: popcount(a & ~b) elements of a are
   surely missing from b, which bounds the intersection from above. Pairs that
   could still link are joined into candidate components, a superset of the
   true ones. A token that very many texts share, and a group beyond
   ``GROUP``, join their sets unseen, as nothing is lost by that.
3. Sets of one candidate component meet again in tiles of bounded bytes, now
   with their sorted arrays; pairs not yet connected are intersected exactly.
   Large components meet a hub block first; the sets that this does not
   connect to the component's largest part then meet all blocks.

Only the order of step 1 uses frequencies (bounded table of the most shared
tokens); any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.graph import components, cut_lineage
from arborlake.llm.textvec import WordHasher, mix, project, shingles, tidy, tidy_group

K = 5
#: Links have 100 * intersection >= 80 * union, so intersection >= 4/9 of the sum of sizes.
NUM, DEN = 4, 9
#: Bits of the smallest bitmap; a larger set has twice as many until they outnumber its elements.
BITS = 512
_LANES = BITS // 64
#: Tokens of a bucket, about.
BUCKET = 1_500_000
MIN_BUCKETS = 16
#: Texts that share a token in one task before it counts as a shared one, how many such tokens are put last, and texts that make one of these a hot one.
SHARED, MOST_SHARED, HOT = 8, 1 << 16, 20_000
#: Tasks' worths of hot tokens that one task joins.
SPREAD = 256
#: Tokens held before they are counted or sent out.
HELD = 1_500_000
#: Sets of a group that are compared by their bitmaps.
GROUP = 4096
#: Sets and bytes of a block; a tile holds two blocks.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Rows of candidates that may be broadcast to fetch their texts.
BROADCAST_ROWS = 1_000_000


def need(a, b):
    """Smallest intersection that links sets of these sizes."""
    return -(-NUM * (a + b) // DEN)


def sets_of(texts: pa.Array, hasher: WordHasher) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: none without words, one for fewer than K words."""
    for i, j, words, first in hasher.passes(texts):
        all_h = shingles(words, K) if len(words) >= K else words[:0]
        for t in range(j - i):
            a, b = first[t], first[t + 1]
            if b - a >= K:
                yield np.unique(all_h[a : b - K + 1])
            elif b > a:
                yield mix(shingles(words[a:b], b - a) + np.uint64(b - a))
            else:
                yield words[:0]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Hash of a set, as two signed 64-bit numbers."""
    n = np.uint64(len(s))
    if not len(s):
        return 0, 0
    x = np.bitwise_xor.reduce(mix(s + n), keepdims=True)
    return int(mix(x + np.add.reduce(mix(s ^ n), keepdims=True)).view(np.int64)[0]), int(x.view(np.int64)[0])


def band(n: np.ndarray) -> np.ndarray:
    """Size band: its bitmaps have BITS * 2**band bits, at least as many as a set has elements."""
    return np.ceil(np.log2(np.maximum(n, BITS) / BITS)).astype(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Hashed bits of a set, in 64-bit lanes; OR of its halves is the bitmap of the band below."""
    bits = np.zeros(BITS << int(band(np.array(len(s)))), np.uint8)
    bits[(s >> np.uint64(20)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).view(np.uint64)


class Bitmaps:
    """Bitmaps of many sets by band, each also folded to the band below: sets that can link are at most one band apart."""

    def __init__(self, n: np.ndarray, lanes: np.ndarray):
        """``lanes``: the sets' bitmaps end to end."""
        self.n, self.band = n, band(n)
        width = _LANES << self.band
        start = np.cumsum(np.r_[0, width])[:-1]
        self.rows: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        for c in range(int(self.band.max(initial=-1)) + 1):
            w = _LANES << c
            own, above = np.flatnonzero(self.band == c), np.flatnonzero(self.band == c + 1)
            wide = lanes[start[above, None] + np.arange(2 * w)].reshape(len(above), 2, w)
            self.rows[c] = np.concatenate([lanes[start[own, None] + np.arange(w)], wide[:, 0] | wide[:, 1]])
            self.at[c] = np.full(len(n), -1)
            self.at[c][np.r_[own, above]] = np.arange(len(own) + len(above))

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Upper bounds of the intersections of sets a[i] and b[i], at most one band apart."""
        out = np.empty(len(a), np.int64)
        low = np.minimum(self.band[a], self.band[b])
        for c in np.unique(low):
            i = np.flatnonzero(low == c)
            table, at = self.rows[c], self.at[c]
            step = max(1, 400_000 // table.shape[1])
            for k in range(0, len(i), step):
                j = i[k : k + step]
                p, q = table[at[a[j]]], table[at[b[j]]]
                only_p = np.bitwise_count(p & ~q).sum(1, dtype=np.int64)
                only_q = np.bitwise_count(q & ~p).sum(1, dtype=np.int64)
                out[j] = np.minimum(self.n[a[j]] - only_p, self.n[b[j]] - only_q)
        return out

    def could_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        least = need(self.n[a], self.n[b])
        ok = np.minimum(self.n[a], self.n[b]) >= least
        i = np.flatnonzero(ok)
        ok[i] = self.most(a[i], b[i]) >= least[i]
        return ok


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, jid (the id, or for rows without one a hash of the text), th (hash of the text)."""
    rows = project(docs)
    th = F.xxhash64("text")
    return rows.select("doc_id", "text", F.coalesce("doc_id", th).alias("jid"), th.alias("th"))


_MEASURED = pa.schema([*((n, pa.int64()) for n in ("doc_id", "jid", "th", "n", "k1", "k2")), ("bits", pa.binary()), ("token", pa.int64()), ("texts", pa.int64())])


def _measure(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, jid, th, n, k1, k2, bits once a task and set) of texts, and rows (token, texts that have it) of shared tokens."""

    def shared(held: list[np.ndarray]) -> pa.RecordBatch:
        tok, n = np.unique(np.concatenate(held), return_counts=True)
        tok, n = tok[n >= SHARED], n[n >= SHARED]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(tok), f.type) for f in list(_MEASURED)[:7]), pa.array(tok.view(np.int64)), pa.array(n.astype(np.int64))], schema=_MEASURED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size, seen = WordHasher(), [], 0, set()
        for b in batches:
            n, key, bits = [], [], []
            for s in sets_of(b.column(1), hasher):
                k = set_key(s)
                n.append(len(s))
                key.append(k)
                fresh = len(s) and k not in seen
                bits.append(bitmap(s).tobytes() if fresh else None)
                if fresh:
                    seen.add(k)
                    held.append(s)
                    size += len(s)
                if size >= HELD:
                    yield shared(held)
                    held, size, seen = [], 0, set()
            none = pa.nulls(b.num_rows, pa.int64())
            keys = np.array(key, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(bits, pa.binary()), none, none], schema=_MEASURED)
        if held:
            yield shared(held)

    return _texts(docs).mapInArrow(tidy(run), "doc_id long, jid long, th long, n long, k1 long, k2 long, bits binary, token long, texts long")


def prefix(s: np.ndarray, late: np.ndarray, late_rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 tokens: rare ones by hash, then shared ones from the least shared on."""
    p = len(s) - -(-8 * len(s) // 10) + 1
    if not len(late):
        return s[:p]
    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
    is_late = late[at] == s
    rare = s[~is_late][:p]
    if len(rare) == p:
        return rare
    last = at[is_late]
    return np.concatenate([rare, late[last[np.argsort(late_rank[last], kind="stable")]][: p - len(rare)]])


def _send(docs: DataFrame, late: np.ndarray, late_rank: np.ndarray, hot: np.ndarray, buckets: int) -> DataFrame:
    """Packed prefix tokens: a row for each bucket and batch of texts. Hot tokens get buckets below 0, dealt by batch."""
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("tok", "key", "size"))])

    def packed(keys: list[int], toks: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
        tok, many = np.concatenate(toks), [len(t) for t in toks]
        bucket = ((tok >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, tok), len(hot) - 1)
            bucket[hot[at] == tok] = -1 - abs(keys[0]) % SPREAD
        by = np.argsort(bucket, kind="stable")
        bucket, tok, key, size = bucket[by], tok[by], np.repeat(np.array(keys, np.int64), many)[by], np.repeat(np.array(sizes, np.int32), many)[by]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        rows = [(int(bucket[a]), tok[a:b].tobytes(), key[a:b].tobytes(), size[a:b].tobytes()) for a, b in zip(edge, edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        keys, sizes, toks, held = [], [], [], 0
        for b in batches:
            for s in sets_of(b.column(1), hasher):
                if not len(s) or (k := set_key(s)) in seen:
                    continue
                seen.add(k)
                keys.append(k[0])
                sizes.append(len(s))
                toks.append(prefix(s, late, late_rank))
                held += len(toks[-1])
                if held >= HELD:
                    yield packed(keys, toks, sizes)
                    keys, sizes, toks, held, seen = [], [], [], 0, set()
        if keys:
            yield packed(keys, toks, sizes)

    return project(docs).mapInArrow(tidy(run), "bucket int, tok binary, key binary, size binary")


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the components of a[i] and b[i]; labels stay the smallest member."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def candidates_of(bits: Bitmaps) -> np.ndarray:
    """Labels that join sets of one group, in order of size, whose bitmaps allow a link."""
    n, label = bits.n, np.arange(len(bits.n))
    for i in range(0, len(n), 256):
        rows = np.arange(i, min(i + 256, len(n)))
        if (label[i:] == label[i]).all():
            break
        reach = np.searchsorted(n, n[rows[-1]] * 5 // 4, side="right")
        for j in range(i, max(reach, i + 1), 256):
            cols = np.arange(j, min(j + 256, reach))
            a, b = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
            new = (label[a] != label[b]) & (a < b)
            a, b = a[new], b[new]
            if len(a):
                ok = bits.could_link(a, b)
                label = hook(label, a[ok], b[ok])
    return label


def groups_of(tok: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, key, n) of sets that share a token and lie in a run of sizes that could link; equal groups once."""
    by = np.lexsort((key, n, tok))
    tok, key, n = tok[by], key[by], n[by]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])
    tok, key, n = tok[new], key[new], n[new]  # a set that several tasks sent counts once
    cut = np.ones(len(tok), bool)
    cut[1:] = (tok[1:] != tok[:-1]) | (5 * n[:-1] < 4 * n[1:])
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(tok)))
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return np.zeros(0, np.int64), key[:0], n[:0]
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    key, n, first = key[at], n[at], np.cumsum(size) - size
    word = mix(key.view(np.uint64) + n.astype(np.uint64))
    name = mix(np.add.reduceat(word, first) ^ mix(np.bitwise_xor.reduceat(mix(word), first) + size.astype(np.uint64))).view(np.int64)
    one = np.unique(name, return_index=True)[1]
    keep = np.repeat(np.isin(np.arange(len(name)), one), size)
    return np.repeat(name, size)[keep], key[keep], n[keep]


_MET = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _meet(sent: DataFrame) -> DataFrame:
    """Rows (sig, a: key, b: size) of the groups to compare, and rows (null, a, b) of sets that are joined unseen."""

    def one(t: pa.Table) -> pa.Table:
        tok, key, n = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("tok", np.uint64), ("key", np.int64), ("size", np.int32)))
        if t.column("bucket")[0].as_py() < 0:  # hot tokens: each stands as a node that joins the sets that have it
            return pa.Table.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(key), pa.array(mix(tok).view(np.int64))], schema=_MET)
        sig, key, n = groups_of(tok, key, n.astype(np.int64))
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(sig)))
        large = np.repeat(size > GROUP, size)
        return pa.Table.from_arrays([pa.array(sig, mask=large), pa.array(key), pa.array(np.where(large, np.repeat(key[start], size), n))], schema=_MET)

    return sent.groupBy("bucket").applyInArrow(tidy_group(one), "sig long, a long, b long")


def _compared(groups: DataFrame, bits: DataFrame, partitions: int) -> DataFrame:
    """Candidate edges (a, b) between the keys of each group, from (sig, key, n) and (key, n, bits)."""

    def edges(part: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        part.sort(key=lambda x: x[1])
        keys = np.array([x[0] for x in part], np.int64)
        label = candidates_of(Bitmaps(np.array([x[1] for x in part], np.int64), np.concatenate([np.frombuffer(x[2], np.uint64) for x in part])))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return keys[moved], keys[label[moved]]

    def pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, []
        for batch in batches:
            found = []
            for sig, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if sig != now:
                    if len(part) > 1:
                        found.append(edges(part))
                    now, part = sig, []
                part.append(row)
            yield pairs(found)
        if len(part) > 1:
            yield pairs([edges(part)])

    rows = groups.join(bits, ["key", "n"]).select("sig", "key", "n", "bits")
    return rows.repartition(partitions, "sig").sortWithinPartitions("sig").mapInArrow(tidy(run), "a long, b long")


def connect(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Labels of exact components among the sets, starting from known labels (index of the smallest member)."""
    n = np.array([len(s) for s in sets], np.int64)
    bits = Bitmaps(n, np.concatenate([bitmap(s) for s in sets]))
    by = np.argsort(n, kind="stable")
    for at in range(1, len(by)):
        i = by[at]
        lo = np.searchsorted(n[by[:at]], -(-4 * n[i] // 5))
        others = by[lo:at]
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        others = others[bits.could_link(np.full(len(others), i), others)]
        close = bits.most(np.full(len(others), i), others) / (n[others] + n[i])
        for j in others[np.argsort(-close, kind="stable")]:
            if label[j] != label[i] and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= need(n[i], n[j]):
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return label


def _tiles(rows: DataFrame, partitions: int) -> DataFrame:
    """Exact edges between keys from rows (comp, bi, bj, key, known, arr): one tile at a time is held in memory."""

    def solved(tile: dict[str, tuple[str | None, bytes]]) -> tuple[list[str], list[str]]:
        keys, first = list(tile), {}
        label = np.array([first.setdefault(known or k, i) for i, (k, (known, _)) in enumerate(tile.items())])
        label = connect([np.frombuffer(arr, np.uint64) for _, arr in tile.values()], label)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return [keys[i] for i in moved], [keys[label[i]] for i in moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, {}
        for b in batches:
            found = ([], [])
            for *at, key, known, arr in zip(*(c.to_pylist() for c in b.columns)):
                if at != now:
                    if len(tile) > 1:
                        for x, y in zip(found, solved(tile)):
                            x += y
                    now, tile = at, {}
                tile[key] = (known, arr)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in found], names=["a", "b"])
        if len(tile) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in solved(tile)], names=["a", "b"])

    dealt = rows.select("comp", "bi", "bj", "key", "known", "arr").repartition(partitions, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    return dealt.mapInArrow(tidy(run), "a string, b string")


def _small(df: DataFrame) -> DataFrame:
    """Marks a side for broadcast when a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _key() -> Column:
    """A set's name: both numbers of its hash."""
    return F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))


def _with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, comp, blocks, known, arr (the sorted hashes) for rows (jid, k1, k2, key, comp, blocks, known).

    An id may stand on several texts: only a text of the wanted set counts.
    """
    joined = _texts(docs).select("jid", "text").join(_small(wanted), "jid")
    schema = pa.schema([("key", pa.string()), ("comp", pa.int64()), ("blocks", pa.int64()), ("known", pa.string()), ("arr", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            keys = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            arr = [s.tobytes() if set_key(s) == k else None for s, k in zip(sets_of(b.column(0), hasher), keys)]
            out = pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3, 7)), pa.array(arr, pa.binary())], schema=schema)
            yield out.filter(out.column(4).is_valid())

    return joined.select("text", "k1", "k2", "key", "comp", "blocks", "known").mapInArrow(tidy(run), "key string, comp long, blocks long, known string, arr binary")


def _block(blocks: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(salt)), F.col(blocks))


def _blocks(members: Column, bytes_: Column) -> Column:
    return F.greatest(F.ceil(members / BLOCK), F.ceil(bytes_ / BLOCK_BYTES)).cast("long")


def _exact(docs: DataFrame, wanted: DataFrame, partitions: int) -> DataFrame:
    """node (key), root of the exact components inside candidate components (jid, k1, k2, key, n, comp)."""
    size = wanted.groupBy("comp").agg(_blocks(F.count("*"), 8 * F.sum("n")).alias("blocks"))
    wanted = cut_lineage(wanted.join(size, "comp").select("jid", "k1", "k2", "key", "n", "comp", "blocks", F.lit(None).cast("string").alias("known")))
    zero, far = F.lit(0).cast("long"), F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)
    sets = _with_sets(docs, wanted.drop("n")).withColumn("block", _block("blocks", 0))
    first = sets.withColumn("bj", F.explode(F.when(F.col("blocks") == 1, F.array(zero)).when(F.col("block") == 0, far).otherwise(F.array("block"))))
    edges = cut_lineage(_tiles(first.withColumn("bi", zero), partitions))
    roots = components(edges)
    split = wanted.filter("blocks > 2").drop("known").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("known", F.coalesce("root", "key")).drop("root")
    parts = split.groupBy("comp", "known").agg(F.count("*").alias("m"))
    main = parts.groupBy("comp").agg(F.count("*").alias("parts"), F.max(F.struct("m", "known")).alias("top")).filter("parts > 1").select("comp", F.col("top.known").alias("main"))
    mixed = cut_lineage(split.join(main, "comp").withColumn("rest", F.col("known") != F.col("main")).drop("main"))
    if mixed.isEmpty():
        return roots
    # sets outside the largest part meet every block; the others are connected already
    far_blocks = mixed.filter("rest").groupBy("comp").agg(_blocks(F.count("*"), 8 * F.sum("n")).alias("rest_blocks"))
    both = _with_sets(docs, mixed.drop("n", "rest")).join(mixed.select("key", "rest").join(far_blocks.join(mixed.select("comp", "key"), "comp"), "key"), ["key", "comp"])
    upto = lambda c: F.sequence(zero, F.col(c) - 1)
    as_all = both.withColumn("bj", _block("blocks", 0)).withColumn("bi", F.explode(upto("rest_blocks")))
    as_rest = both.filter("rest").withColumn("bi", _block("rest_blocks", 1)).withColumn("bj", F.explode(upto("blocks")))
    cols = ["comp", "bi", "bj", "key", "known", "arr"]
    return components(edges.union(_tiles(as_all.select(cols).union(as_rest.select(cols)), partitions)))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, jid, th, n, k1, k2) of all texts, and (k1, k2, root) of the sets with shingles."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    measured = cut_lineage(_measure(docs))
    rows = measured.filter("token is null").select("doc_id", "jid", "th", "n", "k1", "k2")
    late = measured.filter("token is not null").groupBy("token").agg(F.sum("texts").alias("texts")).orderBy(F.desc("texts"), "token").limit(MOST_SHARED).toPandas()
    tok, texts = late["token"].to_numpy(np.int64).view(np.uint64), late["texts"].to_numpy(np.int64)
    by = np.argsort(tok)
    total = rows.agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-int(total) // BUCKET))
    met = cut_lineage(_meet(_send(docs, tok[by], -by, np.sort(tok[texts >= HOT]), buckets)))
    groups = met.filter("sig is not null").select("sig", F.col("a").alias("key"), F.col("b").alias("n")).distinct()
    bits = measured.filter("bits is not null").select(F.col("k1").alias("key"), "n", "bits")
    bits = bits.join(groups.select("key", "n").distinct(), ["key", "n"], "left_semi").groupBy("key", "n").agg(F.first("bits").alias("bits"))
    found = components(met.filter("sig is null").select("a", "b").union(_compared(groups, bits, partitions)))
    nodes = rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("jid").alias("jid"), F.max("n").alias("n"))
    wanted = nodes.join(found.select(F.col("node").alias("k1"), F.col("root").alias("comp")), "k1").withColumn("key", _key())
    roots = _exact(docs, wanted.select("jid", "k1", "k2", "key", "n", "comp"), partitions)
    named = nodes.withColumn("key", _key()).join(roots.withColumnRenamed("node", "key"), "key", "left")
    return rows, named.select("k1", "k2", F.coalesce("root", "key").alias("root"))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Null texts and texts without words have no shingles and are alone. Ties
    and repeated rows share a component; a repeated doc_id gives a row each
    time, and if its texts differ each is linked by itself. Rows without an id
    are linked like others but name no component: one of such rows only has a
    null component_id. Texts of any length are read whole. An empty table
    gives no rows; other columns are ignored.
    """
    rows, roots = _classes(docs)
    smallest = rows.filter("n > 0").join(roots, ["k1", "k2"]).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = roots.join(smallest, "root").select("k1", "k2", "component_id")
    some = rows.filter("n > 0").join(of_set, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps one.

    That is the row of the smallest doc_id (rows without an id come last, ties
    go by the hash of the text); of repeated rows one stays, by the order of
    the columns. Rows without words are linked with nothing, so all stay. An
    empty table stays empty.
    """
    rows, roots = _classes(docs)
    some = rows.filter("n > 0").groupBy("jid", "th", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("c"))
    some = cut_lineage(some.join(roots, ["k1", "k2"]).select("jid", "th", "doc_id", "c", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "jid", "c")
    first = cut_lineage(some.groupBy("root").agg(F.min(order).alias("w")).select("w.jid", "w.th", "w.c"))
    lost = some.join(first, ["jid", "th"], "left_anti").select("jid", "th")
    cols = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.withColumn("__th", F.xxhash64(text)).withColumn("__jid", F.coalesce(F.col("doc_id").cast("long"), F.col("__th")))
    names = {"jid": "__jid", "th": "__th"}
    kept = named.join(_small(lost.withColumnsRenamed(names)), ["__jid", "__th"], "left_anti")
    often = first.filter("c > 1").select("jid", "th").withColumnsRenamed(names)
    if often.isEmpty():
        return kept.select(*cols)
    often = _small(often)
    once = kept.join(often, ["__jid", "__th"], "left_anti").select(*cols)
    again = kept.join(often, ["__jid", "__th"], "left_semi").groupBy("__jid", "__th").agg(F.min(F.struct(*cols)).alias("r")).select("r.*")
    return once.union(again)
