import collections
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from arborlake.llm import ann, bpe, html_extract, lang_id, license_scan, ngram_join, packing, quality, textvec, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "one", "One two", "a b c d", "x " * 30_000, "\n\n\t", "é漢字🙂 <|endoftext|> it's 12"]


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def random_text(rng, letters, most=30):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


LETTERS = [*"ab cd  the\n\t \x1c\x85\xa0éçß½²٣漢🙂'sll.!?0123<|>Σσ", " the", " and", "\r\n", "́", "ﬁ", "<|endoftext|>", "<|startoftext|>"]


def test_byte_bpe_equals_library():
    mine, lib = bpe.ByteBPE(P.path("byte_bpe_50k.json"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for t in [random_text(rng, LETTERS) for _ in range(3000)] + [x or "" for x in ODD]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_word_bpe_equals_library():
    mine, lib = packing.Encoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = [random_text(rng, LETTERS) for _ in range(3000)] + [x or "" for x in ODD]
    for t, ids in zip(texts, mine.many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def brute_links(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(rng, n):
    base = [f"w{rng.randint(0, 300)}" for _ in range(200)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 99)}"
        out.append(" ".join(t[: rng.randint(150, 200)]))
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block):
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = ODD + near_copies(rng, 25) + near_copies(rng, 10) + [shared + " " + random_text(rng, ["q ", "r ", "z "], 40) for _ in range(8)] + ["same text again and again here"] * 5 + ["a b c d"] * 2
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SHARED", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(spark, texts)).collect()}
    assert got == brute_links(texts)


def test_ngram_join_empty_and_repeated_rows(spark):
    assert ngram_join.link(docs(spark, [])).count() == 0
    d = docs(spark, ["a b c d e f", None])
    assert sorted(tuple(r) for r in ngram_join.link(d.union(d)).collect()) == [(0, 2, 0), (0, 2, 0), (1, 0, 1), (1, 0, 1)]


def test_quality_measures(spark):
    assert quality.Text("a b  c\nx\x0by").word_chars == 5
    rng = random.Random(4)
    texts = [random_text(rng, ["a ", "b ", "c ", "d\n", "é# ", "|x<> ", "e\n\n"], 40) for _ in range(400)] + ODD
    got = {r.doc_id: r for r in quality.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(grams)
        seen = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(seen) > 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(seen))
        assert r.base_failed == failed and r.kept == (not failed and r.rejected_by is None)
    assert any(r.rejected_by for r in got.values()) and any(r.kept for r in got.values())
    assert quality.keep(docs(spark, ODD)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_cascade_verdicts_do_not_depend_on_the_order(spark):
    plain = " ".join(f"word{i}" for i in range(30))
    texts = {
        plain: None, plain + " # # # # # # # # # # #": "symbols", " ".join(f"w{i}!!" for i in range(20)): "exclamations", plain.upper(): "upper_case", "\n".join([*map(str.strip, ["aa bb cc"] * 9), *(f"w{i} x{i}" for i in range(6))]): "dup_lines",
        " ".join(str(i) for i in range(40)): "letters", plain.upper() + " ###############": "symbols",
    }
    count = len(quality.RULES)
    orders = [tuple(range(count)), tuple(reversed(range(count))), (2, 4, 0, 3, 1)]
    for t, want in texts.items():
        got = {quality.measure(t, o)[5:] for o in orders}
        base = any(r.rejects(quality.Text(t)) for r in quality.BASE)
        assert got == {(base, not base and want is None, None if base else want)}, (t, got)
    d = docs(spark, [*texts, None, "", "short"])
    judged = {r.doc_id for r in quality.judge(d).filter("kept").collect()}
    assert {r.doc_id for r in quality.keep(d).collect()} == judged == {0}
    assert quality.judge(docs(spark, [])).count() == 0 and quality.keep(docs(spark, [])).count() == 0
    assert sorted(quality.sample_of(d)) == sorted([*texts, "", "short"])


def test_suffix_automaton_finds_all_runs():
    rng = random.Random(5)
    for _ in range(60):
        templates = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(5, 14))] for _ in range(3)]
        text = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(60)]
        found = license_scan.Automaton(templates).runs(text)
        for k, t in enumerate(templates):
            want = []
            for i in range(60):
                for j in range(len(t)):
                    n = 0
                    while i + n < 60 and j + n < len(t) and text[i + n] == t[j + n]:
                        n += 1
                    if n >= 5 and not (i and j and text[i - 1] == t[j - 1]):
                        want.append((i, j, n))
            assert sorted(found.get(k, [])) == sorted(want)


def test_chain_equals_brute_force():
    rng = random.Random(15)

    def every(runs, reach):
        """The most words that any ordered chain covers."""
        top = 0
        for mask in range(1, 1 << len(runs)):
            c = [r for b, r in enumerate(runs) if mask >> b & 1]
            total = c[0][2]
            for (x, y, m), (i, j, n) in zip(c, c[1:]):
                if not (x < i and y < j and x + m < i + n and y + m < j + n and i - x - m <= reach):
                    break
                total += n - max(0, x + m - i, y + m - j)
            else:
                top = max(top, total)
        return top

    for _ in range(150):
        runs = sorted({(rng.randint(0, 40), rng.randint(0, 30), rng.randint(5, 12)) for _ in range(rng.randint(1, 8))})
        covered, first, past = license_scan.chain(runs, 15)
        assert covered == every(runs, 15) and first < past


def test_complete_templates_are_covered_whatever_surrounds_them():
    s = license_scan.Scanner()
    for k, (label, wording) in enumerate(license_scan.TEMPLATES):
        w = wording.split()
        if len(w) < license_scan.SHORT:
            continue
        for text in (" ".join(w[len(w) // 2 :][:12] + ["stray"] + w), " ".join(w[:-10] + w[-8:] + w[-10:]), " ".join(w + ["and"] + w[:9])):
            covered, *_ = s.automaton.spans(license_scan.words_of(text))[k]
            assert covered == s.automaton.sizes[k] and label in s.scan(text)[5].split(",")
    gpl = next(t for x, t in license_scan.TEMPLATES if x == "gpl")
    assert s.scan(gpl)[5] == "gpl"


def test_licence_places_equal_brute_force():
    rng, s = random.Random(16), license_scan.Scanner()
    pool = ["MIT", "license", "Apache", "LICENSE", "general", "public", "gnu", "x1", "é", "-", "mit-license", "."]
    for _ in range(400):
        t = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
        at = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        n_words, n_base, first, last, base, labels = s.scan(t)[:6]
        assert (n_words, n_base, first, last, base) == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))
        assert set(base.split(",")) - {""} <= set(labels.split(","))


def test_licence_labels(spark):
    s = license_scan.Scanner()
    assert s.scan("Released under the MIT License.")[:6] == (5, 1, 3, 3, "mit", "mit")
    full = s.scan(dict(reversed(license_scan.TEMPLATES))["mit"])
    assert full[4:7] == ("", "mit", 1.0)
    assert s.scan("The GNU General Public License and the general public license")[1:4] == (2, 2, 7)
    assert license_scan.scan_licenses(docs(spark, ODD)).count() == len(ODD)


def test_short_licence_notices():
    s = license_scan.Scanner()
    said = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Photo: CC BY": "cc-by", "cc-by-4.0": "cc-by", "CC BY-SA 3.0": "cc-by-sa", "CC BY-ND": "cc-by-nd", "CC-BY-NC-SA-4.0": "cc-by-nc-sa", "Dedicated under CC0 1.0.": "cc0",
        "under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd", "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa", "LGPL-2.1-or-later": "lgpl", "AGPL-3.0": "agpl",
        "under the Mozilla Public License": "mpl", "BSD-3-Clause": "bsd", "please cc by noon": "", "The commons are creative": "",
    }
    assert {t: s.scan(t)[5] for t in said} == said
    assert s.scan("x Licensed under CC BY-NC 4.0.")[4:] == ("", "cc-by-nc", 1.0, [{"label": "cc-by-nc", "first_word": 3, "end_word": 6, "cover": 1.0}])
    assert s.scan("GNU Lesser General Public License")[4:6] == ("gpl", "gpl,lgpl")


def test_short_templates_need_full_cover():
    s = license_scan.Scanner()
    said = {"sold under the terms of the agreement": ("", 0.0), "under the terms of the MIT License": ("mit", 0.5), "under the terms of the GNU General Public License": ("gpl", 1.0), "Licensed under the Apache License, Version 2.0": ("apache", 1.0)}
    assert {t: s.scan(t)[5:7] for t in said} == said


def say(rng, syllables, n=40):
    return " ".join("".join(rng.choices(syllables, k=3)) for _ in range(n))


def test_language(spark):
    rng = random.Random(6)
    a, b = ["ka", "lo", "mi"], ["stra", "eun", "ich"]
    d = docs(spark, [say(rng, a) for _ in range(30)], "aa").union(docs(spark, [say(rng, b) for _ in range(30)], "bb").withColumn("doc_id", textvec.F.col("doc_id") + 100))
    m = lang_id.train(d)
    who = lang_id.Identifier(m)
    assert who.predict(say(rng, a))[0] == "aa" and who.predict(say(rng, b))[0] == "bb"
    _, _, mixed = who.predict(say(rng, a) + " " + say(rng, b))
    assert set(mixed) == {"aa", "bb"} and abs(mixed["aa"] - 0.5) < 0.2
    for odd in ("これは日本語の文章です。 東京 大阪 京都 名古屋 札幌 福岡", "это предложение на другом языке которого модель не знает", "zzz qqq xxxx wwww vvvvv yyyy"):
        lang, score, _ = who.predict(odd)
        assert lang in ("aa", "bb") and score < 0.5
    half = who.predict(say(rng, a, 30) + " " + "это предложение на другом языке которого модель не знает совсем " * 3)
    assert half[0] == "aa" and 0.3 < half[1] < 0.7
    out = {r.doc_id: r for r in lang_id.identify(docs(spark, [None, "", "12 !?", say(rng, b)]), m).collect()}
    assert [out[i].lang_pred for i in range(4)] == ["und", "und", "und", "bb"]
    assert lang_id.train(docs(spark, [])).langs == () and lang_id.identify(docs(spark, []), m).count() == 0
    assert [r.lang_pred for r in lang_id.identify(docs(spark, ["words here"]), lang_id.train(docs(spark, []))).collect()] == ["und"]
    assert lang_id.keep_identified(d.union(d), m).count() == 120


def test_held_out_languages_of_the_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lang_id.identify(d, lang_id.train(d)).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98


def test_long_texts_and_many_words_do_not_change_a_language():
    counts = [("aa", g, 9) for g in lang_id.grams_of("kalomi")] + [("bb", g, 9) for g in lang_id.grams_of("straeun")]
    who = lang_id.Identifier(lang_id.build(counts))
    assert who.predict("kalomi " * 300_000)[:2] == who.predict("kalomi " * 30)[:2]
    assert who.predict("字" * 200_000)[1] < 0.5 and max(map(len, who.at)) <= lang_id.SEEN_LETTERS


def test_packing(spark):
    rng = random.Random(7)
    for _ in range(20):
        n = [rng.randint(1, 100) for _ in range(rng.randint(0, 80))]
        bins = packing.pack(n, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(n))) and all(sum(n[i] for i in b) <= 100 for b in bins)
    rows = packing.pack_documents(docs(spark, ODD), P.path("word_bpe_49k.json")).toPandas()
    assert set(rows.doc_id) == set(range(len(ODD))) and rows[rows.doc_id == 0].length.tolist() == [1]
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096


def test_packing_stops_only_when_no_bin_has_a_move_or_exchange_left():
    rng = random.Random(10)
    n = [rng.randint(700, 1600) for _ in range(2048)]
    bins = packing.pack(n)
    assert sorted(i for b in bins for i in b) == list(range(2048)) and max(sum(n[i] for i in b) for b in bins) <= 4096
    assert len(bins) <= 1.005 * packing.fewest(n, 4096)
    for lo, hi in ((17, 50), (20, 40), (30, 60)) * 4:
        n = [rng.randint(lo, hi) for _ in range(60)]
        bins = packing.pack(n, 100)
        assert len(bins) >= packing.fewest(n, 100)
        if len(bins) == packing.fewest(n, 100):
            continue
        sizes = [[n[i] for i in b] for b in bins]
        for e, x in enumerate(sizes):
            gives = set(x) | {p + q for i, p in enumerate(x) for q in x[:i]}
            for b, z in enumerate(sizes):
                for d in {g - y for g in gives for y in [0, *z] if e != b and 0 < g - y <= 100 - sum(z)}:
                    assert d * (d + sum(z) - sum(x)) <= 0


def test_fewest_bins():
    assert [packing.fewest(n, 10) for n in ([], [10], [6, 6, 6], [5, 5], [5, 5, 5], [7, 7, 4, 4, 4], [1] * 11, [3, 3, 3, 1])] == [0, 1, 3, 1, 2, 4, 2, 1]


def test_hilbert_steps_are_neighbours():
    g = np.stack(np.meshgrid(*[np.arange(4)] * 3), -1).reshape(-1, 3)
    k = ann.hilbert_key(g, 2)
    assert sorted(k) == list(range(64)) and (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1) == 1).all()


def audited(a, b):
    """What an audit reports, and the same by comparing all records."""
    out = warc.audit_pages(a, b).collect()
    got = collections.Counter((r.page_id, r.record_sha256, r.status) for r in out)
    x, y = ({(r.page_id, r.h): r.copies for r in warc.records(t).collect()} for t in (a, b))
    want = collections.Counter()
    ids = collections.defaultdict(lambda: [0, 0])
    for k in {*x, *y}:
        d = x.get(k, 0) - y.get(k, 0)
        ids[k[0]][0] += max(d, 0)
        ids[k[0]][1] += max(-d, 0)
    for k in {*x, *y}:
        d, (lost, new) = x.get(k, 0) - y.get(k, 0), ids[k[0]]
        want[*k, "intact"] += x.get(k, 0) - max(d, 0)
        want[*k, "changed" if lost and new else "missing"] += max(d, 0)
        want[*k, "extra"] += max(-d, 0) if not (lost and new) else 0
    return out, got, +want


def test_warc_audit_finds_exactly_the_damage(spark, monkeypatch):
    F = warc.F
    p = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(700)], "page_id long, url string, html string")
    bad = p.filter("page_id not in (4, 300)").withColumn("html", F.when(F.col("page_id").isin(3, 255, 256, 699), "gone").otherwise(F.col("html")))
    bad = bad.union(spark.createDataFrame([(9000, "new", "x"), (-5, "new", "y")], p.schema))
    out, got, want = audited(p, bad)
    assert got == want and {(r.page_id, r.status) for r in out if r.status != "intact"} == {*((i, "changed") for i in (3, 255, 256, 699)), (4, "missing"), (300, "missing"), (9000, "extra"), (-5, "extra")}
    for i in range(700):
        r = next(r for r in out if r.page_id == i and r.status != "extra")
        assert (r.file_id, r.part, r.place) == (i // 256, 0, i % 256)
    for t, status in ((p, set()), (p.filter("page_id <> 3"), {(3, "missing")}), (p.limit(0), {(i, "missing") for i in range(700)})):
        assert {(r.page_id, r.status) for r in warc.audit_pages(p, t).collect() if r.status != "intact"} == status
    assert warc.audit_pages(p.limit(0), p.limit(0)).count() == 0


def test_warc_repeated_ids_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 16)
    monkeypatch.setattr(warc, "FANOUT", 4)
    rng = random.Random(14)
    rows = [(rng.choice([None, 1, 2, 70]), "u", f"<p>{rng.randint(0, 60)}</p>") for _ in range(300)] + [(5, None, None)] * 40 + [(6, "u", "")] * 3
    other = rows[10:] + [(6, "u", "other"), (None, "u", "<p>0</p>"), (8, "u", "n")] + [(5, None, None)] * 2
    schema = "page_id long, url string, html string"
    out, got, want = audited(spark.createDataFrame(rows, schema).withColumn("status", warc.F.lit("clash")), spark.createDataFrame(other, schema))
    assert got == want
    files = collections.defaultdict(list)
    for r in out:
        if r.status != "extra":
            files[r.file_id, r.part].append((r.place, r.first_byte, r.n_bytes))
    assert len(files) > 5
    for places in files.values():
        places.sort()
        assert [x[0] for x in places] == list(range(len(places))) and [x[1] for x in places] == [sum(x[2] for x in places[:i]) for i in range(len(places))]


def test_main_text():
    crf = html_extract.trained()
    good = total = 0
    for page, y in html_extract.labelled_pages(60, seed=99):
        found = html_extract.blocks(page)
        assert len(found) == len(y)
        good += sum(a == b for a, b in zip(crf.decode(crf.emissions(found)), y))
        total += len(y)
    assert good / total > 0.97
    page = '<nav><ul><li><a href=x>m</a></ul></nav><article><h1>T &amp; U</h1><p>a<script>1<2</script>  b<br>c</p></article><footer>&copy; f</footer>'
    assert html_extract.extract(page, crf) == ["T & U", "a b c"]
    assert html_extract.extract("", crf) == [] and html_extract.extract("<<<>", crf) is not None


def test_attribute_names_are_not_looked_for_in_values():
    crf = html_extract.trained()
    page = "<nav><ul><li><a href=x>m</a></ul></nav><article{}><h1>T</h1><p>a b c</p></article><footer>&copy; f</footer>"
    for at in (' style="overflow: hidden"', " style='overflow: hidden'", ' title="hidden gem"', ' data-x = "a hidden b"', ' data-hidden="1"', ' title="a class=nav"', ' alt="x"id="main"', ' aria-hidden="false"'):
        assert html_extract.extract(page.format(at), crf) == ["T", "a b c"], at
    for at in (" hidden", ' hidden=""', ' class="x"hidden', " style='x: y' HIDDEN", ' aria-hidden="true"'):
        assert html_extract.blocks(page.format(at))[1].hidden, at
    block, = html_extract.blocks('<div title="class=nav hidden" CLASS=story data-id="q" id = \'top\'>t</div>')
    assert block.marks == ("story", "top") and not block.hidden


def test_words_hash_like_words():
    h = textvec.WordHasher()
    (i, j, words, first), = h.passes(pa.array(["Ab c", None, "AB\tC ab"]))
    assert (i, j) == (0, 3) and first.tolist() == [0, 2, 2, 5]
    assert words[0] == words[2] == words[4] and words[1] == words[3] != words[0]
