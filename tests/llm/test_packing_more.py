import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from arborlake.llm import packing
from tests.llm.test_llm import DOCS, ODD, docs


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    return len(free)


def test_search_saves_bins_over_best_fit():
    rng = random.Random(11)
    n = [rng.randint(1000, 2000) for _ in range(600)]
    bins = packing.pack(n)
    assert sorted(i for b in bins for i in b) == list(range(600))
    assert packing.fewest(n, 4096) <= len(bins) < best_fit_decreasing(n, 4096)


def test_pieces_equal_the_library(spark):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    texts = [*ODD, "Ünder (the) sea's 3.5 % ÀÉ× ÷", "word " * 9000, "漢字，" * 5000, "<|endoftext|> <|ENDOFTEXT|>"]
    df = docs(spark, texts).union(spark.createDataFrame([(None, "no id", "en", "s", 5)] * 2 + [(3, "again", "en", "s", 5)] * 3, DOCS))
    rows = packing.pack_documents(df, P.path("word_bpe_49k.json")).toPandas()
    want = []
    for r in df.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((-1 if r.doc_id is None else r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    got = [(-1 if x.doc_id is None or x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in rows.itertuples()]
    assert sorted(got) == sorted(want)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    assert packing.pack_documents(docs(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing.Encoder, "MOST", 1 << 10)
    mine, tok = packing.Encoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(300)) for _ in range(40)] + ["字" * 5000]
    for t in texts:
        assert np.frombuffer(mine.many([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert mine.words <= 1024 and len(mine.slots) == 2048


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(packing, "_PASS", 1 << 10)
    monkeypatch.setattr(packing, "_LONG_CHARS", 50)
    mine, tok = packing.Encoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(13)
    for t in (" ".join(f"w{rng.randint(0, 999)}" for _ in range(9000)), "abc,def.ghi;" * 900, "字，" * 3000):
        assert np.frombuffer(mine.many([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
