"""Language identification by multilingual mixture inference (operator 6).

Training counts letter n-grams of words for each language. A word's
likelihood under a language is the product over its n-grams; a background
component, under which every learnt n-gram and an unseen one are alike, stands
for words of no learnt language. A document is a mixture: expectation-
maximisation estimates the share of its words in each component, and the set
of components is the one of highest likelihood less ``PENALTY`` for each in
it. A word that stands n times counts 1 + ln n, as repeats say little more
about the language. The prediction is the language with the largest share, the score that
share of all words, so text that the background explains scores low.

The classifier is fitted on a bounded sample: at most ``TRAIN_DOCS``
documents of each language, those of smallest hashed id, and of their n-grams
the ``GRAMS`` most frequent of each language. Neither bound depends on the
other languages.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.graph import cut_lineage
from arborlake.llm.textvec import strings, tidy

TRAIN_DOCS = 1_000
GRAMS = 20_000
ORDER = 3
PENALTY = 12.0
ROUNDS = 12
MIN_SHARE = 0.02
#: Words of up to so many letters whose likelihoods a worker remembers, and how many of them.
SEEN_LETTERS, SEEN = 64, 300_000
UNKNOWN = "und"
#: Rows of languages and ids that may be broadcast.
BROADCAST_ROWS = 1_000_000
_WORDS = re.compile(r"[^\W\d_]+")
#: Letters of a text that are split at once, up to the next gap between words.
_STRETCH = 1 << 20
_GAP = re.compile(r"\s")
#: Letters of one word beyond this many are looked at in pieces of this length.
_PIECE = 64


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(map(str.isalpha, w)) for w in words)


def grams_of(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + ORDER] for i in range(len(w) - ORDER + 1)] or [w]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    index: dict[str, int]
    #: a row of log-probabilities for each n-gram, the last for unseen ones; the last column is the background
    table: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under each component, less the word's largest."""
        found: list[int] = []
        first = []
        index, none = self.index, len(self.table) - 1
        for w in words:
            first.append(len(found))
            for at in range(0, len(w), _PIECE):
                found.extend([index.get(g, none) for g in grams_of(w[at : at + _PIECE])])
        logs = np.add.reduceat(self.table[found], first)
        return logs - logs.max(1, keepdims=True)


def build(counts: list[tuple[str, str, int]]) -> Model:
    """A model from (language, n-gram, count), additive smoothing of one half."""
    langs = tuple(sorted({x[0] for x in counts}))
    at = {lang: i for i, lang in enumerate(langs)}
    index = {g: i for i, g in enumerate(sorted({x[1] for x in counts}))}
    if not langs:
        return Model((), {}, np.zeros((1, 1)))
    table = np.zeros((len(index) + 1, len(langs)))
    for lang, gram, n in counts:
        table[index[gram], at[lang]] += n
    logs = np.log((table + 0.5) / (table.sum(0) + 0.5 * len(table)))
    return Model(langs, index, np.hstack([logs, np.full((len(table), 1), -np.log(len(table)))]))


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS, grams: int = GRAMS, held_out: bool = True) -> Model:
    """Fits on text and lang of rows with both; with ``held_out``, not on ids whose crc32 mod 3 is 1.

    Only ids and languages are ranked, and of a language only those whose hash
    lies under a bound that leaves some ``2 * per_lang`` of them; the texts of
    the chosen ids are then fetched.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null and doc_id is not null")
    if held_out:
        rows = rows.filter("crc32(cast(doc_id as string)) % 3 <> 1")
    ids = cut_lineage(rows.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h")))
    bound = ids.groupBy("lang").agg((F.lit(2.0 * per_lang * (1 << 40)) / F.count("*")).alias("bound"))
    few = ids.join(_small(cut_lineage(bound)), "lang").filter("h <= bound").select("doc_id", "lang", "h").distinct()
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= per_lang)
    chosen = rows.join(_small(cut_lineage(ranked.select("doc_id", "lang"))), ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in by_lang.items():
            seen: Counter = Counter()
            for w, n in words.items():
                for at in range(0, len(w), _PIECE):
                    for g in grams_of(w[at : at + _PIECE]):
                        seen[g] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = chosen.select("text", "lang").mapInArrow(tidy(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= grams)
    return build([(r.lang, r.gram, r.n) for r in top.select("lang", "gram", "n").collect()])


def _small(df: DataFrame) -> DataFrame:
    """Marks a side for broadcast when a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class Identifier:
    def __init__(self, model: Model):
        self.model = model
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs) + 1))

    def logs(self, words: list[str]) -> np.ndarray:
        """Rows of ``Model.words``, of which ``SEEN`` are remembered."""
        new = [w for w in words if w not in self.at]
        if not new:
            return self.rows[list(map(self.at.__getitem__, words))]
        if max(map(len, new)) > SEEN_LETTERS or len(new) > SEEN // 4:
            out = np.empty((len(words), self.rows.shape[1]))
            for a in range(0, len(words), 1 << 14):
                out[a : a + (1 << 14)] = self.model.words(words[a : a + (1 << 14)])
            return out
        if len(self.at) + len(new) > SEEN:
            self.at, new = {}, words
            self.rows = self.rows[:0]
        n = len(self.at)
        if len(self.rows) < n + len(new):
            self.rows = np.concatenate([self.rows[:n], np.zeros((n + len(new) + 4096, self.rows.shape[1]))])
        self.rows[n : n + len(new)] = self.model.words(new)
        self.at.update(zip(new, range(n, n + len(new))))
        return self.rows[list(map(self.at.__getitem__, words))]

    def counts(self, text: str) -> Counter:
        """Words and how often they stand; a long text is read in stretches."""
        out: Counter = Counter()
        at = 0
        while at < len(text):
            end = at + _STRETCH
            if end < len(text):
                gap = _GAP.search(text, end)
                end = gap.start() if gap else len(text)
            out.update(words_of(text[at:end]))
            at = end
        return out

    def mixture(self, text: str) -> tuple[str, dict[str, float]]:
        """The likeliest language alone (``und`` without letters or a trained language), and the shares of the languages selected."""
        counts = self.counts(text)
        langs = self.model.langs
        if not langs or not has_letter(list(counts)):
            return UNKNOWN, {}
        logs = self.logs(list(counts))
        n = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
        single = n @ logs
        rest = len(langs)  # the background's place
        best = int(single[:rest].argmax())
        # every word's largest log-likelihood is 0, so no mixture can exceed 0
        chosen, share, value = [best], np.ones(1), single[best] - PENALTY
        like = None
        while len(chosen) <= rest and -PENALTY > value:
            if like is None:
                like = np.exp(np.maximum(logs, -500.0))
            found = None
            for k in range(rest + 1):
                if k in chosen:
                    continue
                trial = [*chosen, k]
                pi, ll = self._em(like[:, trial], n)
                if pi[-1] < MIN_SHARE:
                    continue
                if pi.min() < MIN_SHARE:  # the new one takes the place of another
                    trial = [c for c, p in zip(trial, pi) if p >= MIN_SHARE]
                    pi, ll = self._em(like[:, trial], n)
                if ll - PENALTY * len(trial) > value and (found is None or ll - PENALTY * len(trial) > found[2]):
                    found = (trial, pi, ll - PENALTY * len(trial))
            if found is None:
                break
            chosen, share, value = found
        return langs[best], {langs[k]: float(p) for k, p in zip(chosen, share) if k != rest}

    @staticmethod
    def _em(like: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        pi = np.full(like.shape[1], 1 / like.shape[1])
        total = n.sum()
        for _ in range(ROUNDS):
            joint = like * pi
            norm = np.maximum(joint.sum(1), 1e-300)
            pi = (n / norm) @ joint / total
        return pi, float(n @ np.log(np.maximum(like @ pi, 1e-300)))

    def predict(self, text: str) -> tuple[str, float, dict[str, float]]:
        """Language, score and shares: ties go to the first name, and without a selected language the likeliest scores 0."""
        likely, shares = self.mixture(text)
        if not shares:
            return likely, 0.0, shares
        lang = min(shares, key=lambda k: (-shares[k], k))
        return lang, min(1.0, max(0.0, shares[lang])), shares


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the shares of all selected languages.

    Null, empty and letterless texts are ``und`` with score 0, and so is every
    text when no row could be learnt from. A text of no learnt language gets
    the likeliest one with a low score. Texts of any length are read whole;
    ties go to the first name. Repeated rows give repeated rows; an empty
    table gives no rows; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Identifier(model)
        for b in batches:
            ids = b.column(0).to_pylist()
            best, score, shares = zip(*map(who.predict, strings(b.column(1)))) if ids else ((), (), ())
            cols = [b.column(0), pa.array([is_held_out(i) for i in ids], pa.bool_()), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array([list(s.items()) for s in shares], schema.field(4).type)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double, shares map<string,double>")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.2) -> DataFrame:
    """The rows of ``docs``, all columns, with a language whose share is at least ``least``.

    Rows without letters go, and all rows when there was nothing to learn
    from; repeated rows stay or go together; an empty table stays empty.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Identifier(model)
        for b in batches:
            yield b.filter(pa.array([who.predict(t)[1] >= least for t in strings(b.column(at))], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
