import collections
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from arborlake.llm import ann, bpe, chat, html_extract, lang_id, license_scan, ngram_join, packing, quality, warc
from tests.llm.test_llm import DOCS, ODD, brute_links

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def fixture_rows():
    rng = random.Random(41)
    speak = {"aa": ["ka", "lo", "mi", "ve"], "bb": ["stra", "eun", "ich", "od"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(speak[lang], k=rng.randint(2, 4))) for _ in range(n))

    rows = [(i, text(lang, rng.randint(12, 200)), lang) for i, lang in enumerate(rng.choices(["aa", "bb"], k=90))]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(10)]  # exact copies
    rows += [(200 + i, rows[i][1] + " ka", rows[i][2]) for i in range(10, 20)]  # near copies
    rows += [(300 + i, t, "aa") for i, t in enumerate(ODD)]
    rows += [(400, "слова другого языка " * 9, "aa"), (401, text("aa", 40).upper() * 2, "aa"), (402, text("bb", 6), "bb"), (403, "ka lo mi ve ka lo " * 20, "aa"), (404, text("aa", 9000), None), (None, text("aa", 30), "aa"), (None, text("aa", 30), None)]
    return [*rows, rows[3], rows[3]]


def near(texts):
    """Root of each text by comparing all."""
    return {i: root for i, (_, root) in brute_links(texts).items()}


def test_every_stage_equals_brute_force(spark, tmp_path):
    rows = fixture_rows()
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.cut_lineage(stage(spark, docs, str(tmp_path)))
        kept[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    given, got = kept["language"]
    who = lang_id.Identifier(lang_id.train(spark.createDataFrame(given, DOCS)))
    assert collections.Counter(got) == collections.Counter(r for r in given if who.predict(r.text or "")[1] >= 0.2)
    ids = {r.doc_id for r in got}
    assert not ids & {300, 301, 302, 400} and set(range(100)) & ids == set(range(90))

    given, got = kept["quality"]
    order = tuple(range(len(quality.RULES)))
    assert collections.Counter(got) == collections.Counter(r for r in given if quality.measure(r.text, order)[6])
    assert not {r.doc_id for r in got} & {401, 402, 403} and 404 in {r.doc_id for r in got}

    given, got = kept["near_duplicates"]
    root = near([r.text for r in given])
    groups = collections.defaultdict(set)
    for i, r in enumerate(given):
        groups[root[i]].add(r)
    assert len(got) == len(groups) and all(len(g & set(got)) == 1 for g in groups.values())
    assert all(min((r.doc_id for r in g if r.doc_id is not None), default=None) in {r.doc_id for r in g & set(got)} for g in groups.values())

    given, got = kept["packing"]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    length = collections.Counter()
    for r in given:
        length[r.doc_id] += len(tok.encode(r.text, add_special_tokens=False).ids) + 1
    packed = collections.Counter()
    fill = collections.Counter()
    for r in got:
        packed[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert packed == length and max(fill.values()) <= 4096 and len(fill) == packing.fewest([r.length for r in got], 4096)

    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length) for r in again) == sorted((r.doc_id or -1, r.piece, r.length) for r in got)


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


BYTES, WORDS = (lambda: P.path("byte_bpe_50k.json")), (lambda: P.path("word_bpe_49k.json"))
OPERATORS = {
    "op1": lambda d: bpe.encoding_digests(d, BYTES(), P.PATTERN), "op1_ids": lambda d: bpe.encode_documents(d, BYTES(), P.PATTERN), "op3": ngram_join.link, "op3_keep": ngram_join.keep_first, "op4": quality.judge, "op4_keep": quality.keep,
    "op5": license_scan.scan_licenses, "op6": lambda d: lang_id.identify(d, lang_id.train(d)), "op6_keep": lambda d: lang_id.keep_identified(d, lang_id.train(d)), "op7": lambda d: packing.pack_documents(d, WORDS()),
}
#: Names that operators use themselves, as columns that they must leave alone.
CLASH = ["n", "key", "g", "k1", "th", "jid", "root", "held_out", "lang_pred", "score", "n_words", "kept", "piece", "length", "sequence_id", "component_id", "ids", "token", "h", "r", "labels", "bucket"]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    """Nulls in every column, empty and long texts, repeated rows, an empty table and columns with the operators' own names."""
    op, keeps = OPERATORS[name], name.endswith("keep")
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate(zip([*ODD, "plain words that stand here for a test of ten words or more"] * 2, ["aa", None, "bb"] * 9))] + [(None, None, None, None, None)] * 2 + [(5, "word " * 40_000, "aa", "s", 1)] * 2
    plain = spark.createDataFrame(rows, DOCS)
    clash = plain
    for c in CLASH:
        clash = clash.withColumn(c, warc.F.lit("clash"))
    a, b = op(plain).collect(), op(clash)
    if keeps:
        assert b.columns == clash.columns
        b = b.select(*plain.columns)
    key = lambda rows: sorted((repr(tuple(r)[:5]) for r in rows))
    assert key(a) == key(b.collect())
    if not keeps and name != "op7":
        assert len(a) == len(rows)
    assert op(clash.limit(0)).count() == 0


def test_encoding_equals_the_library_and_round_trips(spark):
    lib = Tokenizer.from_file(BYTES())
    texts = [*ODD, "long " * 300_000, "字" * 3000]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    mine = bpe.loaded(BYTES(), P.PATTERN)
    for r in bpe.encode_documents(d, BYTES(), P.PATTERN).collect():
        want = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and mine.decode(r.ids) == lib.decode(want, skip_special_tokens=False)


def test_remembered_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_BYTES", 10_000)
    monkeypatch.setattr(bpe, "TOKEN_BYTES", 10_000)
    monkeypatch.setattr(bpe, "STRETCH", 500)
    mine, lib, rng = bpe.ByteBPE(BYTES(), P.PATTERN), Tokenizer.from_file(BYTES()), random.Random(42)
    for n in (1, 5, 90, 3000):
        for _ in range(40):
            t = " ".join("".join(rng.choices("abcdé字", k=rng.randint(1, n))) for _ in range(rng.randint(1, 200) if n < 90 else 3))
            assert mine.encode(t) == lib.encode(t, add_special_tokens=False).ids
    for memo in (mine.pieces, mine.tokens):
        assert memo.held <= 12_000 and max(map(len, memo), default=0) <= bpe.LONGEST


def test_other_tables(spark):
    """Empty tables and clashing columns for the operators that do not read documents."""
    F = warc.F
    pages = spark.createDataFrame([(1, "u", "<p>some text stands here.</p>"), (None, None, None), (1, "u", "<p>some text stands here.</p>")], "page_id long, url string, html string")
    conv = spark.createDataFrame([(1, 0, "user", "a b c"), (1, 1, None, "> a b c\nyes"), (None, None, None, None), (1, 1, None, "> a b c\nyes")], "conv_id long, turn long, role string, text string")
    vecs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, None), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    cases = [(pages, html_extract.extract_pages), (pages, lambda d: warc.audit_pages(d, d.filter("page_id is null"))), (conv, chat.format_chat), (vecs, ann.search)]
    for table, op in cases:
        clash = table
        for c in ["hi", "part", "status", "place", "reply_to", "thread", "content", "vid", "raw", "rank", "n_chars", *([] if table is pages else ["html"])]:
            clash = clash.withColumn(c, F.lit("clash"))
        a, b = (sorted(map(repr, op(t).collect())) for t in (table, clash))
        assert a == b and a
        assert op(clash.limit(0)).count() == 0
    assert np.isfinite([r.score for r in ann.search(vecs).collect()]).all() and re.match("clash", clash.first().raw)
