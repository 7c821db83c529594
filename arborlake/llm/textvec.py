"""Shared helpers: Arrow columns of texts as Python bytes or NumPy word tables.

Every operator reads ``text`` through these, so null texts behave as empty
ones everywhere and extra columns of the input never reach the workers.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one NumPy pass works on; a longer single text gets a pass of its own.
PASS_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15

UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: U+0020 and U+0009..U+000D, the separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # a C library without it
    _TRIM = None


def give_back() -> None:
    """Hands freed memory to the system: a worker outlives its task, and the next stage's JVM and workers need the room."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable) -> Callable:
    """A function of batches that gives memory back after its last one."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(one: Callable) -> Callable:
    """The same for a function of one group's table."""

    @functools.wraps(one)
    def wrapped(t: pa.Table) -> pa.Table:
        try:
            return one(t)
        finally:
            give_back()

    return wrapped


def project(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (long) and the text (string, null as empty)."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def strings(column: pa.Array, rows: int = 256) -> Iterator[str]:
    """The texts of a column, nulls as empty ones; few are Python strings at a time."""
    for at in range(0, len(column), rows):
        for t in column.slice(at, rows).to_pylist():
            yield t or ""


def by_text(docs: DataFrame, one: Callable[[], Callable[[str], tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Applies a function to every text; ``one()`` builds it once a task.

    The function returns the values of the columns after ``doc_id``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = one()
        for batch in batches:
            rows = list(map(f, strings(batch.column(1))))
            cols = [batch.column(0), *(pa.array([r[i] for r in rows], type=schema.field(i + 1).type) for i in range(len(schema) - 1))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.mapInArrow(tidy(run), ddl)


class WordHasher:
    """Words of many texts at once: positions and 64-bit hashes, lower-casing A-Z.

    A word's hash is sum(T[byte_i] * R**(i - start)) mod 2**64 for a fixed
    random table T and odd R, mixed at the end. It comes from one running sum,
    so no Python code runs for a word.
    """

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(20240607))
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.table = self.table[np.frombuffer(UPPER_TO_LOWER, np.uint8)]
        self.r, self.rinv = _ODD | 1, pow(_ODD | 1, -1, 1 << 64)
        self.pow = self.inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.pow) < n:
            m = len(self.pow)
            self.pow = np.concatenate([self.pow, self.pow * np.uint64(pow(self.r, m, 1 << 64))])
            self.inv = np.concatenate([self.inv, self.inv * np.uint64(pow(self.rinv, m, 1 << 64))])

    def passes(self, texts: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, past the last, word hashes, index of each text's first word with the end appended)."""
        for i, j, data, offs in raw_passes(texts, most):
            if len(data) <= 2 * most:
                words, _, _, first = self.spans(data, offs)
            else:  # one long text: its words in stretches, so that only their hashes are held for all of it
                words = np.concatenate([self.spans(x, np.array([0, len(x)]))[0] for x in stretches(data, most)])
                first = np.array([0, len(words)])
            yield i, j, words, first

    def spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word of ``data``, and each text's first word with the end appended."""
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none, np.zeros(len(offs), np.int64)
        sep = SPACE[data]
        edge = np.ones(n + 1, bool)
        edge[1:n] = sep[:-1] | sep[1:]
        edge[offs] = True
        start = np.flatnonzero(edge[:-1] & ~sep)
        end = np.flatnonzero(edge[1:] & ~sep) + 1
        return self.hashes(data, start, end), start, end, np.searchsorted(start, offs)

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte runs data[start[i]:end[i]]."""
        self._powers(len(data))
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.pow[: len(data)], out=run[1:])
        return mix((run[end] - run[start]) * self.inv[start])


def raw_passes(texts: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, their bytes, each text's start there with the end appended): about ``most`` bytes, or one longer text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def stretches(data: np.ndarray, most: int = PASS_BYTES) -> Iterator[np.ndarray]:
    """The bytes of one text in parts of about ``most``, each ending before a separator; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + most
        while end < len(data):
            cut = np.flatnonzero(SPACE[data[end : end + most]])
            if len(cut):
                end += int(cut[0])
                break
            end += most
        yield data[at : min(end, len(data))]
        at = min(end, len(data))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of the public SplitMix64 generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows that start at each word (the last k - 1 run past the end and are cut)."""
    n = len(words) - k + 1
    h = words[:n].copy()
    for i in range(1, k):
        h = mix(h * np.uint64(_ODD) + words[i : n + i])
    return h
