"""Best-fit packing with swap-based local search (operator 7).

Pieces are written once and dealt into groups of about ``GROUP`` by a hash of
their place there, so no group follows a hot key or a long text. Each group is packed alone: best fit
decreasing, then moves, one-for-one and two-for-one exchanges between all
underfull bins, each raising the sum of squared fills, until a lower bound
shows that no fewer bins would do or no bin has one left. A group wastes less than a bin or so, which
against thousands of bins is lost in the total.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.bpe import byte_letters
from arborlake.llm.graph import cut_lineage
from arborlake.llm.textvec import UPPER_TO_LOWER, WordHasher, project, raw_passes, stretches, tidy, tidy_group

CAPACITY = 4096
GROUP = 16_384
END_ID = 1
_NONE = 1 << 30
#: Bytes of text that one pass works on, and letters of a word beyond which it is cut where a token must end.
_PASS, _LONG_CHARS = 1 << 20, 1 << 20
#: Behind such a mark, before a letter, a token ends.
_STRETCH = re.compile(r"(?<=[!-&(-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[^\W\d_])")
_LOWER = np.frombuffer(UPPER_TO_LOWER, np.uint8)
#: 1 letter, 2 digit, 3 ASCII mark but the apostrophe, 0 other; letters beyond ASCII are told apart by two bytes.
_KIND = np.array([1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if 33 <= b <= 126 and b != 39 else 0 for b in range(256)], np.int8)


class Encoder:
    """Ids of texts by a ``tokenizers`` BPE file with word ends whose pre-tokenizer drops white space.

    No token spans white space there, so words are encoded once and
    remembered by their 64-bit hash: at most ``MOST`` words of up to
    ``LONGEST`` bytes in flat arrays, all forgotten when these are full. Words
    of ASCII and Latin-1 letters, digits and marks are merged many at a time;
    the library encodes all others. Letter case is dropped by the tokenizer,
    so the hash drops that of A-Z.
    """

    MOST, LONGEST = 1 << 20, 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[x] << 20 | vocab[y] for x, y in pairs], np.int64)
        by = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[by], 1 << 62), np.append(by, 0).astype(np.int32)
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.hasher = WordHasher()
        self._forget()

    def _forget(self) -> None:
        self.slots = np.zeros(2 * self.MOST, np.uint64)  # hash of the word in each slot, 0 for none
        self.entry = np.zeros(2 * self.MOST, np.int32)
        self.count = np.zeros(self.MOST + 1, np.int32)
        self.start = np.zeros(self.MOST + 1, np.int64)
        self.flat = np.zeros(1 << 16, "<u4")
        self.words = self.used = 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of word hashes, -1 for words that are not remembered."""
        at, out, live = self._slot(h), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(live):
            key = self.slots[at[live]]
            hit = key == h[live]
            out[live[hit]] = self.entry[at[live[hit]]]
            live = live[~hit & (key != 0)]
            at[live] = at[live] + 1 & len(self.slots) - 1
        return out

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Places new, distinct hashes by open addressing."""
        at, left = self._slot(h), np.arange(len(h))
        while len(left):
            free = left[self.slots[at[left]] == 0]
            won = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[won]], self.entry[at[won]] = h[won], entry[won]
            left = left[self.slots[at[left]] != h[left]]
            at[left] = at[left] + 1 & len(self.slots) - 1

    def _append(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Adds words (their ids end to end, and how many each has); their entries."""
        n, total = len(count), self.used + len(ids)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(total, "<u4")])
        if self.words + n > len(self.count):
            self.count, self.start = (np.concatenate([x, np.zeros(self.words + n, x.dtype)]) for x in (self.count, self.start))
        self.flat[self.used : total] = ids
        new = np.arange(self.words, self.words + n)
        self.count[new] = count
        self.start[new] = self.used + np.cumsum(count) - count
        self.words, self.used = self.words + n, total
        return new

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids of each) of pre-tokens of one length, a matrix of bytes; in each round every row merges its lowest rank, the leftmost of equals."""
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        row, rank = np.arange(len(raw)), self._rank(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            n = np.arange(len(row))
            i = rank.argmin(1)
            low = rank[n, i]
            done = low == _NONE
            if done.any():
                yield row[done], ids[done]
                go = ~done
                row, ids, rank, i, low = row[go], ids[go], rank[go], i[go], low[go]
                n = np.arange(len(row))
            if not len(row):
                return
            col = np.arange(ids.shape[1] - 1)
            take = col + (col > i[:, None])
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take[:, :-1], 1)
            ids[n, i] = self.merged[low]
            if not rank.shape[1]:
                break
            left, right = np.flatnonzero(i > 0), np.flatnonzero(i < rank.shape[1])
            rank[right, i[right]] = self._rank(ids[right, i[right]], ids[right, i[right] + 1])
            rank[left, i[left] - 1] = self._rank(ids[left, i[left] - 1], ids[left, i[left]])
        yield row, ids

    def _simple(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words are of known letters, digits and marks only; the ids of these end to end, and how many each has."""
        size = end - start
        first = np.cumsum(size) - size
        buf = _LOWER[data[np.repeat(start - first, size) + np.arange(size.sum())]]
        kind = _KIND[buf]
        lead = np.flatnonzero(buf == 0xC3)  # valid UTF-8: a byte follows in the same word
        kind[lead] = kind[lead + 1] = np.where((buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7), 0, 1)
        upper = lead[buf[lead + 1] <= 0x9E] + 1
        buf[upper] = np.where(buf[upper] == 0x97, buf[upper], buf[upper] + 0x20)
        ok = np.minimum.reduceat(kind, first) > 0
        keep = np.repeat(ok, size)
        buf, kind, size = buf[keep], kind[keep], size[ok]
        if not len(size):
            return ok, np.zeros(0, np.int32), np.zeros(0, np.int32)
        first = np.cumsum(size) - size
        cut = np.ones(len(buf), bool)  # where a pre-token begins: a run of letters or marks, or one digit
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut[first] = True
        begin = np.flatnonzero(cut)
        past = np.append(begin[1:], len(buf))
        _, one, which = np.unique(self.hasher.hashes(buf, begin, past), return_index=True, return_inverse=True)
        count, blocks = np.zeros(len(one), np.int64), []
        long = past[one] - begin[one]
        for n in np.unique(long):
            same = np.flatnonzero(long == n)
            for at in range(0, len(same), 4096):
                some = same[at : at + 4096]
                for rows, ids in self._merge(buf[begin[one[some], None] + np.arange(n)]):
                    count[some[rows]] = ids.shape[1]
                    blocks.append((some[rows], ids))
        at = np.cumsum(count) - count
        ids = np.zeros(count.sum(), np.int32)
        for rows, block in blocks:
            ids[at[rows, None] + np.arange(block.shape[1])] = block
        many = count[which]
        out = ids[np.repeat(at[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        return ok, out, np.add.reduceat(many, np.searchsorted(begin, first))

    def _library(self, word: str) -> list[int]:
        """Ids by the library, a long word in stretches that end where a token must end."""
        out, held, size = [], [], 0
        for part in _STRETCH.split(word) if len(word) > _LONG_CHARS else [word]:
            if size + len(part) > _LONG_CHARS and held:
                out += self.tok.encode("".join(held), add_special_tokens=False).ids
                held, size = [], 0
            held.append(part)
            size += len(part)
        return out + self.tok.encode("".join(held), add_special_tokens=False).ids

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: bool) -> np.ndarray:
        """Appends words and gives their entries; ``plain`` ones may be merged here."""
        out = np.empty(len(start), np.int64)
        ok = np.zeros(len(start), bool)
        if plain:
            ok, ids, count = self._simple(data, start, end)
            out[ok] = self._append(ids, count)
        others = np.flatnonzero(~ok)
        if len(others):
            found = [self._library(data[start[i] : end[i]].tobytes().decode()) for i in others]
            out[others] = self._append(np.array([x for f in found for x in f], np.int64), np.array(list(map(len, found))))
        return out

    def _ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and where each text's begin with the end appended."""
        if self.words >= self.MOST // 2:
            self._forget()
        h, start, end, first = self.hasher.spans(data, offs)
        h[h == 0] = 1
        at = self._find(h)
        raw = data.tobytes()
        if b"<|" in raw:  # a special token may stand there, whose case counts: such words are not looked up
            where = np.array([m.start() for m in re.finditer(rb"<\|", raw)], np.int64)
            at[np.unique(np.searchsorted(start, where, side="right") - 1)] = -2
        new = np.flatnonzero((at == -1) & (end - start <= self.LONGEST))
        if len(new):
            kind, one, which = np.unique(h[new], return_index=True, return_inverse=True)
            entry = self._learn(data, start[new[one]], end[new[one]], True)
            self._insert(kind, entry)
            at[new] = entry[which]
        kept = self.words, self.used
        odd = np.flatnonzero(at < 0)
        if len(odd):
            at[odd] = self._learn(data, start[odd], end[odd], False)
        count = self.count[at]
        past = np.append(0, np.cumsum(count))
        ids = self.flat[np.repeat(self.start[at] - past[:-1], count) + np.arange(past[-1])]
        self.words, self.used = kept  # long words and those with special tokens are not remembered
        return ids, past[first]

    def passes(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids end to end, where each text's begin with the end appended) of runs of texts in order."""
        for _, _, data, offs in raw_passes(texts, _PASS):
            if len(data) <= 2 * _PASS:
                yield self._ids(data, offs)
            else:
                ids = np.concatenate([self._ids(x, np.array([0, len(x)]))[0] for x in stretches(data, _PASS)])
                yield ids, np.array([0, len(ids)])

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, 4 little-endian bytes each."""
        return [ids[a:b].tobytes() for ids, at in self.passes(pa.array(texts, pa.large_string())) for a, b in zip(at, at[1:])]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id in pieces of at most ``capacity``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            docs, rows, n = b.column(0).to_pylist(), [], 0
            for ids, at in enc.passes(b.column(1)):
                for a, z in zip(at.tolist(), at[1:].tolist()):
                    raw = ids[a:z].tobytes() + end
                    rows += [(docs[n], k, x // 4, len(part := raw[x : x + 4 * capacity]) // 4, zlib.crc32(part)) for k, x in enumerate(range(0, len(raw), 4 * capacity))]
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return project(docs).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of item lengths, with an index of underfull bins by free space."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []  # sorted (length, item)
        self.free: list[int] = []
        self.open: list[tuple[int, int]] = []  # sorted (free, bin) of underfull bins

    def _leave(self, b: int) -> None:
        if self.free[b]:
            self.open.pop(bisect_left(self.open, (self.free[b], b)))

    def change(self, b: int, out: list[tuple[int, int]], new: list[tuple[int, int]]) -> None:
        self._leave(b)
        for x in out:
            self.items[b].pop(bisect_left(self.items[b], x))
        for x in new:
            insort(self.items[b], x)
        self.free[b] += sum(x[0] for x in out) - sum(x[0] for x in new)
        if self.free[b] and self.items[b]:
            insort(self.open, (self.free[b], b))

    def best_fit(self, x: tuple[int, int]) -> None:
        at = bisect_left(self.open, (x[0], -1))
        if at == len(self.open):
            self.items.append([])
            self.free.append(self.capacity)
            b = len(self.free) - 1
            insort(self.open, (self.capacity, b))
        else:
            b = self.open[at][1]
        self.change(b, [], [x])


class Search:
    """Moves and exchanges over all underfull bins.

    A bin gives one or two documents to another for one document or none (an
    entry of length 0 for each bin stands for that), if the sum of squared
    fills rises. ``size`` and ``bin`` hold every document, then those entries.
    """

    def __init__(self, bins: Bins, lengths: list[int]):
        self.capacity, self.n = bins.capacity, len(lengths)
        self.items = [{i for _, i in x} for x in bins.items]
        self.free = np.array(bins.free, np.int64)
        self.size = np.array([*lengths, *[0] * len(self.items)], np.int64)
        self.bin = np.zeros(len(self.size), np.int64)
        for b, items in enumerate(self.items):
            self.bin[[*items, self.n + b]] = b
        self.changed: list[int] = []
        #: bin -> how many changes there were when it last had nothing to give
        self.seen: dict[int, int] = {}

    def _partners(self, e: int) -> np.ndarray:
        """Entries to try: all of underfull bins, or those of bins changed since ``e``, unchanged itself, was tried."""
        new = set(self.changed[self.seen[e] :]) if e in self.seen else {e}
        if e in new or len(new) * 4 > len(self.items):
            return np.flatnonzero(self.free[self.bin])
        return np.array([y for b in sorted(new) for y in (*sorted(self.items[b]), self.n + b)], np.int64)

    def improve(self, e: int) -> bool:
        """The move or exchange out of bin ``e`` that raises the sum of squared fills most."""
        mine: dict[int, list[int]] = {}
        for i in sorted(self.items[e]):
            mine.setdefault(int(self.size[i]), []).append(i)
        one = np.array(sorted(mine), np.int64)
        two = one[:, None] + one
        two = two[np.triu(np.ones(two.shape, bool), 1) | np.diag([len(mine[x]) > 1 for x in one.tolist()])]
        fits = np.zeros(self.capacity + 1, np.int64)  # the largest sum of one or two documents up to each length
        for sums in (one, two[two <= self.capacity]):
            fits[sums] = sums
        fits = np.maximum.accumulate(fits)
        at = self._partners(e)
        size, bin_ = self.size[at], self.bin[at]
        free = self.free[bin_]
        shift = fits[size + free] - size
        gain = np.where((shift > 0) & (bin_ != e), shift * (shift + self.free[e] - free), 0)
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] <= 0:
            self.seen[e] = len(self.changed)
            return False
        y, b, total = int(at[best]), int(bin_[best]), int(fits[size[best] + free[best]])
        if total in mine:
            give = [mine[total][0]]
        else:
            x = next(x for x in mine if total - x in mine and (total != 2 * x or len(mine[x]) > 1))
            give = [mine[x][0], mine[total - x][-1]]
        self.items[e].difference_update(give)
        self.items[b].update(give)
        self.bin[give] = b
        if y < self.n:
            self.items[b].remove(y)
            self.items[e].add(y)
            self.bin[y] = e
        self.free[e] += shift[best]
        self.free[b] -= shift[best]
        self.changed += [e, b]
        return True

    def run(self, least: int) -> None:
        live = sum(map(bool, self.items))
        going = True
        while going and live > least:
            going = False
            for e in np.argsort(-self.free, kind="stable").tolist():  # the emptiest first
                if not self.items[e]:
                    continue
                while self.items[e] and self.free[e] and self.improve(e):
                    going = True
                live -= not self.items[e]
                if live <= least:
                    return


def fewest(lengths: list[int], capacity: int) -> int:
    """A number of bins that no packing can do without (Martello and Toth's second bound)."""
    x = np.sort(np.array(lengths, np.int64))
    total = np.append(0, np.cumsum(x))
    half = np.searchsorted(x, capacity // 2, "right")  # from here on each needs a bin of its own
    small = np.unique(np.append(x[:half], 0))  # documents shorter than this are left out
    low, high = np.searchsorted(x, small), np.maximum(half, np.searchsorted(x, capacity - small, "right"))
    room = (high - half) * capacity - (total[high] - total[half])
    return int((len(x) - half + np.maximum(0, -(-(total[half] - total[low] - room) // capacity))).max())


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items (indexes) of each bin. Lengths are at most ``capacity``."""
    bins = Bins(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bins.best_fit((lengths[i], i))
    least = fewest(lengths, capacity)
    if len(bins.items) <= least:
        return [[i for _, i in x] for x in bins.items]
    search = Search(bins, lengths)
    search.run(least)
    return [sorted(x, key=lambda i: (lengths[i], i)) for x in search.items if x]


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """A row per piece with its sequence and its place there.

    Null and empty texts are a piece of the end id alone. Rows are packed as
    they are, so repeated rows, and rows without an id, take room each. Texts
    of any length are cut, never shortened. Pieces of one length are alike;
    within a group ties go by doc_id and piece. An empty table gives no rows;
    columns other than doc_id and text are ignored.
    """
    pieces = cut_lineage(cut(docs, path, capacity))
    groups = max(1, -(-pieces.count() // group))
    # the place in the written pieces, so copies of a row are dealt like any others
    salted = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        lengths = t.column("length").to_pylist()
        seq, off = [0] * len(lengths), [0] * len(lengths)
        base = t.column("g")[0].as_py() << 32
        for b, items in enumerate(pack(lengths, capacity)):
            at = 0
            for i in items:
                seq[i], off[i] = base + b, at
                at += lengths[i]
        return pa.Table.from_arrays([*(t.column(n).combine_chunks() for n in schema.names[:5]), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], schema=schema)

    return salted.groupBy("g").applyInArrow(tidy_group(one), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
