"""Byte-level BPE encoding and decoding (operator 1).

A pre-token is a doubly linked list of symbols. A heap holds (rank, position)
of the pairs that can merge; an entry is stale, and skipped, when its left
symbol is gone or the pair that starts there has changed. Decoding
concatenates the vocabulary strings of the ids and reads them as UTF-8.

A text is first cut before every single space that a non-space follows. The
public pre-tokenizer's pattern always ends a token there, so each cut piece
can be encoded alone and remembered. What is remembered is bounded by bytes,
two generations of ``PIECE_BYTES`` and ``TOKEN_BYTES``, and leaves out pieces
beyond ``LONGEST`` letters. A long text is encoded in stretches that end at
such a space; no text is ever shortened.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from arborlake.llm.textvec import by_text, project

#: Bytes of a generation of remembered pieces and pre-tokens, letters of the longest one, letters of a stretch, ids that are hashed at once.
PIECE_BYTES, TOKEN_BYTES, LONGEST, STRETCH, LISTED = 96 << 20, 16 << 20, 64, 1 << 22, 1 << 20
#: Unicode White_Space. (Fixed values.)
_WS = "\t-\r \x85\xa0  -     　"
_BREAK = re.compile(f" (?=[^{_WS}])")
_UNSAFE = re.compile(f" [{_WS}]")


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte that byte-level vocabularies are written with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class Generations(dict):
    """A dict that computes missing values (bytes) and holds at most two generations of ``room`` bytes, about."""

    def __init__(self, make: Callable[[str], bytes], room: int):
        self.make, self.room, self.held, self.old = make, room, 0, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.held >= self.room:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += 200 + 2 * len(key) + len(value)
        self[key] = value
        return value


class ByteBPE:
    """Encoder and decoder for a ``tokenizers`` JSON file of kind byte-level BPE."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: left id * 2**20 + right id -> rank, and rank -> merged id
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (x, y) in enumerate(merges):
            self.ranks[vocab[x] << 20 | vocab[y]] = rank
            self.merged.append(vocab[x + y])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.names = [str(i) for i in range(size)]
        self.pattern = regex.compile(pattern)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = Generations(lambda t: array("I", self.merge(t)).tobytes(), TOKEN_BYTES)
        self.pieces = Generations(self.piece, PIECE_BYTES)

    def merge(self, token: str) -> list[int]:
        """Ids of one pre-token by the heap of merge ranks."""
        first = self.first
        ids = [first[b] for b in token.encode()]
        n, rank_of = len(ids), self.ranks.get
        #: rank of the pair that starts at each live symbol, -1 for none: a heap entry of another rank is stale
        pair = [rank_of(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        if not heap:
            return ids
        heapify(heap)
        pair.append(-1)
        before, after, merged = list(range(-1, n - 1)), list(range(1, n + 1)), self.merged
        if n > STRETCH:  # a symbol then takes 16 bytes and not some hundred
            ids, pair, before, after = (array("i", x) for x in (ids, pair, before, after))
        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            if pair[i] != rank:
                continue
            j = after[i]
            ids[i] = new = merged[rank]
            ids[j] = pair[j] = pair[i] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank_of(new << 20 | ids[k], -1)
                if r >= 0:
                    pair[i] = r
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                pair[h] = r = rank_of(ids[h] << 20 | new, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return [i for i in ids if i >= 0]

    def piece(self, rest: str) -> bytes:
        """Ids (little-endian, 4 bytes each) of a space followed by ``rest``."""
        if rest.isalpha():
            return array("I", self.merge(" " + rest)).tobytes()
        return self.whole(" " + rest)

    def whole(self, piece: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[t[1:]] if t[0] == " " and t[1:].isalpha() else self.tokens[t] for t in self.pattern.findall(piece)])

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def ids(self, text: str) -> array:
        if self.cut is None or "<" not in text:
            return self._plain(text)
        out = array("I")
        for i, part in enumerate(self.cut.split(text)):
            out.extend([self.special[part]] if i % 2 else self._plain(part))
        return out

    def _plain(self, text: str) -> array:
        ids, at = array("I"), 0
        while at < len(text):
            cut = _BREAK.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            end = cut.start() if cut else len(text)
            part = text[at:end]
            head, *rest = _BREAK.split(part) if _UNSAFE.search(part) else part.split(" ")
            ids.frombytes(self.whole(head))
            ids.frombytes(b"".join(map(self.pieces.__getitem__, rest)))
            at = end
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@cache
def loaded(path: str, pattern: str) -> ByteBPE:
    """One encoder a worker, so that its remembered pieces serve all its tasks."""
    return ByteBPE(path, pattern)


def digests(bpe: ByteBPE, text: str) -> tuple[int, str, str]:
    ids, listed = bpe.ids(text), hashlib.sha256()
    for at in range(0, len(ids), LISTED):
        listed.update(("," * (at > 0) + ",".join(map(bpe.names.__getitem__, ids[at : at + LISTED]))).encode())
    return len(ids), listed.hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int): one row per document; null and empty texts have no ids."""

    def one():
        bpe = loaded(path, pattern)
        return lambda text: (bpe.encode(text),)

    return by_text(project(docs), one, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), "doc_id long, ids array<int>")


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every whole text.

    Null and empty texts have no tokens and the digests of the empty string;
    texts of any length are encoded whole. Among pairs of equal rank the
    leftmost merges first. Repeated rows give repeated rows; an empty table
    gives no rows; columns other than doc_id and text are ignored.
    """

    def one():
        bpe = loaded(path, pattern)
        return lambda text: digests(bpe, text)

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return by_text(project(docs), one, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
