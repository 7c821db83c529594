"""Quality rules as a short-circuit cascade (operator 4).

Each rule turns the measures of one text into a verdict. A bounded sample of
documents gives every rule a cost (seconds) and a rejection rate; rules then
run in order of rejections per second and stop at the first one that rejects.
Measures that several rules share are computed once a text. The order changes
the time only: a document is kept when no rule rejects it, and the rule that
is reported is the first rejecting one in the order of the list.

The sample is at most ``SAMPLE_DOCS`` documents of at most ``SAMPLE_BYTES``
bytes each, drawn by a hash over all rows.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.textvec import project, strings, tidy

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bounds of the sample that costs and rejection rates are measured on: documents, and bytes of the largest.
SAMPLE_DOCS, SAMPLE_BYTES = 256, 1 << 16
_SYMBOL_BYTES = SYMBOLS.encode()
_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


class Text:
    """One text and the measures that rules share, each computed at most once."""

    def __init__(self, text: str):
        self.text, self.raw = text, text.encode()
        self.words = self.raw.split()  # bytes.split() cuts at exactly U+0020 and U+0009..U+000D
        self.n_words = len(self.words)

    @property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.raw.count, _SEPARATORS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOL_BYTES))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        grams = list(zip(*(w[i:] for i in range(WINDOW))))
        if len(set(grams)) == len(grams):
            return 0
        seen = Counter(grams)
        covered = done = 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                covered += i + WINDOW - max(i, done)
                done = i + WINDOW
        return covered


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_NEITHER = bytes(b for b in range(128) if b not in _LETTERS and b not in _SEPARATORS)


def _upper(t: Text) -> bool:
    up = len(t.raw) - len(t.raw.translate(None, _UPPER))
    return up > 20 and 2 * up > len(t.raw) - len(t.raw.translate(None, _LETTERS))


#: Too short; more than a fifth of the words in repeated windows.
BASE = (Rule("few_words", lambda t: t.n_words < 10), Rule("repeats", lambda t: 100 * t.n_repeat_words > 20 * t.n_words))
#: More than 3 symbols for 10 words; runs of exclamation marks; shouting; mostly repeated lines; no letters.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("exclamations", lambda t: t.n_words >= 10 and 2 * t.raw.count(b"!") > t.n_words),
    Rule("upper_case", _upper),
    Rule("dup_lines", lambda t: 2 * t.n_dup_lines > t.raw.count(b"\n") + 1),
    Rule("letters", lambda t: t.n_words > 0 and 2 * len(t.raw.translate(None, _NEITHER).split()) < t.n_words),
)


def plan(texts: list[str], rules: tuple[Rule, ...] = RULES) -> tuple[int, ...]:
    """Order of the rules by rejections per second on a sample (ties by position)."""
    sample, score = [Text(t) for t in texts], []
    for i, rule in enumerate(rules):
        began = time.process_time()
        hits = sum(rule.rejects(t) for t in sample)
        score.append((-(hits + 0.5) / max(time.process_time() - began, 1e-6), i))
    return tuple(i for _, i in sorted(score))


def sample_of(docs: DataFrame) -> list[str]:
    """Texts of the bounded sample. Rows are counted first, so that tasks send a few each and not a sample each."""
    rows = project(docs)
    slots = max(1, rows.count() // (4 * SAMPLE_DOCS))
    h = F.xxhash64("text")
    drawn = rows.filter(F.pmod(h, F.lit(slots)) == 0).filter(F.octet_length("text") <= SAMPLE_BYTES).select("text", h.alias("h")).distinct().orderBy("h", "text").limit(SAMPLE_DOCS)
    return [r.text for r in drawn.collect()]


def order_for(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[int, ...]:
    """The cascade's order, from a bounded sample."""
    return plan(sample_of(docs), rules)


def rejecting(t: Text, order: tuple[int, ...], rules: tuple[Rule, ...] = RULES) -> int | None:
    """Position of the first rule in the list that rejects a text: rules run in ``order`` until one does, then only those before it."""
    hit = next((i for i in order if rules[i].rejects(t)), None)
    if hit is None:
        return None
    passed = set(order[: order.index(hit)])
    return next((i for i in range(hit) if i not in passed and rules[i].rejects(t)), hit)


def measure(text: str, order: tuple[int, ...], rules: tuple[Rule, ...] = RULES) -> tuple:
    t = Text(text)
    failed = any(r.rejects(t) for r in BASE)
    hit = None if failed else rejecting(t, order, rules)
    return t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and hit is None, None if hit is None else rules[hit].name


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the rule that rejected.

    Null and empty texts have no words and fail the base; texts of any length
    are measured whole. Of several rejecting rules the first in the list is
    named. Repeated rows give repeated rows; an empty table gives no rows;
    other columns are ignored.
    """
    order = order_for(docs, rules)
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
    schema = pa.schema([("doc_id", pa.int64()), *((f.split()[0], t) for f, t in zip(_FIELDS.split(", "), types))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t, order, rules) for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], types[i]) for i in range(len(types)))], schema=schema)

    return project(docs).mapInArrow(tidy(run), f"doc_id long, {_FIELDS}")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base and every rule: one cascade, the base tests in it.

    Rows without words go; a text that is there several times stays or goes
    with all its rows; an empty table stays empty.
    """
    cascade = BASE + rules
    order, at = order_for(docs, cascade), docs.columns.index("text")

    def passes(text: str) -> bool:
        t = Text(text)
        return not any(cascade[i].rejects(t) for i in order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(list(map(passes, strings(b.column(at)))), pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
