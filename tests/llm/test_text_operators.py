import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from litgraph.llm import bpe, decontaminate, html_extract, language_id, license_scan, quality_rules, sharding, token_count
from litgraph.llm.queries import QUERIES

from . import brute

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", None, "a", "ÄÖ ß", "x" * 3000, "\n\n\t ", "a<|endoftext|>b", "don't  stop▁me", "日本語 \x00 ok", "² ².", "tie tie", "tie tie", "word " * 4000]


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [(i, t, "x", "y", i) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, "a", "x", "y", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score string, n_words long")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


def test_bpe_matches_library(docs, odd, empty):
    library = Tokenizer.from_file(BYTES)
    for df in (docs, odd):
        texts = {(r["doc_id"], r["text"]) for r in df.collect()}
        for r in bpe.encode_decode(df, BYTES).collect():
            ids = np.frombuffer(r["ids_le"], "<u4").tolist()
            assert any(i == r["doc_id"] and (t or "") == r["decoded"] and library.encode(t or "", add_special_tokens=False).ids == ids for i, t in texts)
    assert bpe.encode_decode(odd, BYTES).count() == odd.count()
    assert bpe.digests(bpe.encode_decode(empty, BYTES)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(text):
    codec, library = bpe.codec(BYTES), Tokenizer.from_file(BYTES)
    want = library.encode(text, add_special_tokens=False).ids
    got = codec.encode_block([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == want
    assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_compatible_is_exact():
    codec, rng = bpe.codec(BYTES), np.random.default_rng(1)
    spelling = {i: t for t, i in codec.tokens.items()}
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
    ok = codec.compatible(a, b)
    assert [codec.merge(spelling[x] + spelling[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)] == ok.tolist()
    assert 0 < ok.sum() < len(ok)


def test_token_count_matches_library(docs, odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, odd):
        want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in df.collect())
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(df, PIECES).collect()) == want
    assert token_count.count_tokens(empty, PIECES).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n_.,²ab1"), st.characters(codec="utf-8")), max_size=40))
def test_token_count_any_text(text):
    counter = token_count.counter(PIECES)
    assert counter.block([text]).tolist() == [len(counter.model.encode(text))]


def test_license_base_places(docs, odd, empty, spark):
    more = spark.createDataFrame([(900, "Under  the MIT--License. under the mit license"), (901, "(c) CC BY-NC 4.0; Apache License, Version 2.0"), (902, "undr the mit licence"), (903, "thunder the mit licenses")], "doc_id long, text string")
    for df in (docs, odd, more):
        want = sorted(str((r["doc_id"], *brute.base_licenses(r["text"], license_scan.BASE))) for r in df.collect())
        got = license_scan.scan_licenses(df)
        assert sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got.collect()) == want
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(more).collect()}
    assert got[902]["labels"] == "mit" and got[902]["base_labels"] == "" and 0.8 < got[902]["score"] < 1
    assert got[900]["score"] == 1 and got[901]["labels"] == "apache-2,cc-by-nc"
    assert license_scan.scan_licenses(empty).collect() == []


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("released under the MPL license", ""),
        ("under the mu license, under the it licence, under the bit license", ""),
        ("Apache License, Version 1 and Apache License, Version 1.1", ""),
        ("Mozilla Public License Version 1.1", ""),
        ("GNU Affero General Public License", ""),
        ("Creative Commons Attribution NoDerivatives", ""),
        ("Creative Commons Attribution 3.0 International", ""),
        ("undr the MIT licence", "mit"),
        ("Apache Licence, Versin 2.0", "apache-2"),
        ("GNU General Publik Lisense", "gpl"),
        ("the GNU Lesser General Public License", "lgpl"),
        ("Mozilla Public Licence, version 2.0", "mpl-2"),
        ("Redistribution and use in source or binary forms", "bsd"),
        ("Creative Commons Attribution-NonCommercial", "cc-by-nc"),
    ],
)
def test_license_rivals(text, labels):
    assert license_scan.scan_text(text, license_scan.BASE, [license_scan.Notice(*n) for n in license_scan.FUZZY])["labels"] == labels


def test_license_matches_edit_distances():
    """Against edit distances of all spans of words, for notices with and without words that take no errors."""
    rng, found = random.Random(4), 0
    for words, edits in (("*apache license version *2", 2), ("under the *mit license", 2), ("use in source and binary forms", 3)):
        notice = license_scan.Notice("x", words, edits)
        for _ in range(200):
            phrase = list(notice.phrase)
            for _ in range(rng.randint(0, edits + 2)):
                at = rng.randrange(len(phrase))
                phrase[at : at + 1] = rng.choice([[], ["q"], [phrase[at], "z"]])
            text = license_scan.words_of(f"so {''.join(phrase)} it")
            want = brute.near_phrase(text.decode().split(), words.split(), edits)
            assert bool(notice.spans(text)) == want, text
            found += want
    assert 100 < found < 550


def test_license_spans_and_time():
    import time

    notices = [license_scan.Notice(*n) for n in license_scan.FUZZY]
    got = license_scan.scan_text("It is, as said, under the mit licence. So under the MIT license.", license_scan.BASE, notices)
    assert [(s["first_word"], s["n_words"], s["edits"]) for s in got["spans"]] == [(4, 4, 1), (9, 4, 0)] and (got["n_base"], got["first_word"], got["n_words"]) == (1, 9, 13)
    began = time.time()
    for text in ("cc by nc " * 110_000, "license " * 120_000, "under the " * 100_000):
        license_scan.scan_text(text, license_scan.BASE, notices)
    assert time.time() - began < 30


def test_decontamination(spark, sf, docs, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    planted = spark.createDataFrame([(-1, f"so {items[0][1]} and {items[0][1]}"), (-2, " ".join(brute.words(items[1][1])[3:13])), (-3, " ".join(brute.words(items[1][1])[3:12]))], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(planted)
    got = {r["doc_id"]: r for r in decontaminate.summary(decontaminate.find_leaks(df, bench)).collect()}
    hits = 0
    for r in df.collect():
        n, hit, ids = brute.leaks(r["text"], items)
        own = got[r["doc_id"]]
        assert (own["n_words"], own["n_hit"], own["n_items"], own["items_sha256"], own["contaminated"]) == (n, hit, len(ids), brute.sha(",".join(ids).encode()), hit > 0)
        hits += hit > 0
    assert hits >= 2 and got[-2]["contaminated"]
    small = spark.createDataFrame([(1, "tie"), (2, "ok no"), (None, "no id"), (4, None), (5, ""), (1, "tie")], "item_id long, text string")
    got = decontaminate.summary(decontaminate.find_leaks(odd, small)).collect()
    want = sorted((str(r["doc_id"]), *brute.leaks(r["text"], [(i, t) for i, t in [(1, "tie"), (2, "ok no"), (None, "no id")]])[:2]) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in got) == want
    assert [r["n_items"] for r in got if r["doc_id"] is None] == [0]
    assert decontaminate.find_leaks(empty, small).collect() == []
    assert {r["n_hit"] for r in decontaminate.summary(decontaminate.find_leaks(odd, small.filter("false"))).collect()} == {0}


def test_decontamination_in_passes(spark, sf, docs, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    once = sorted(decontaminate.summary(decontaminate.find_leaks(docs, bench)).collect())
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", 4000)
    assert sorted(decontaminate.summary(decontaminate.find_leaks(docs, bench)).collect()) == once


def test_fm_index():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(0, 4, 400), rng.integers(0, 4, 30).repeat(3), [0]])
    index = decontaminate.FmIndex(text, 4)
    phrases = np.array([[1, 2, 3], [1, 1, 0], [2, 0, 0], [3, 3, 3]])
    size = np.array([3, 2, 1, 3])
    low, high = index.search(phrases, size)
    for p, n, a, b in zip(phrases, size, low, high, strict=True):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_sharding(docs, odd, empty, spark):
    copies = spark.range(3000).selectExpr("1L AS doc_id", "'same' AS text", "'z' AS shard")
    for df in (docs, odd, copies, empty):
        rows, want = sharding.shard_documents(df).collect(), df.collect()
        assert len(rows) == len(want)
        by = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
        assert all(b == list(range(len(b))) for b in by) and max(map(len, by)) - min(map(len, by)) <= 1
        text = lambda t: (t or "").encode()
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(r["doc_id"]), len(text(r["text"])) + 1, zlib.crc32(text(r["text"]))) for r in want)


def test_sharding_in_pieces(docs, monkeypatch):
    monkeypatch.setattr(sharding, "SOURCE_ROWS", 9)
    for most in (sharding.BROADCAST_ROWS, 0):
        monkeypatch.setattr(sharding, "BROADCAST_ROWS", most)
        rows = sharding.shard_documents(docs).collect()
        by = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
        assert len(rows) == docs.count() and all(b == list(range(len(b))) for b in by) and max(map(len, by)) - min(map(len, by)) <= 1


def test_sharding_is_uniform(spark):
    """Over many seeds every row is as often in each shard and in each half of its slots, wherever it stood."""
    rows = spark.range(32, numPartitions=3).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    seen = np.zeros((32, 4))
    halves = np.zeros(32)
    for seed in range(25):
        for r in sharding.shard_documents(rows, n_shards=4, seed=1000 * seed).collect():
            seen[r["doc_id"], r["shard"]] += 1
            halves[r["doc_id"]] += r["slot"] < 4
    assert (((seen - 6.25) ** 2 / 6.25).sum(1) < 22).all() and ((seen - 6.25) ** 2 / 6.25).sum() < 150 and (np.abs(halves - 12.5) < 11).all()


def test_communication_matrix_is_uniform():
    rng = random.Random(7)
    draws = [sharding.hypergeometric(rng, 40, 60, 25) for _ in range(4000)]
    assert abs(np.mean(draws) - 10) < 0.15 and abs(np.var(draws) - 25 * 0.4 * 0.6 * 75 / 99) < 0.4
    matrix = sharding.communication_matrix([10, 0, 7, 20_000], 8, 1)
    assert [sum(r) for r in matrix] == [10, 0, 7, 20_000] and max(map(sum, zip(*matrix, strict=True))) - min(map(sum, zip(*matrix, strict=True))) <= 1


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows} == {True}
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    profiles = language_id.train(docs, docs["doc_id"] > -1, max_docs=200)
    got = language_id.identify(odd, profiles, keep=("id",)).collect()
    assert len(got) == odd.count() and all(r["lang_pred"] == "und" for r in got if not any(c.isalpha() for c in dict(enumerate(ODD)).get(r["doc_id"]) or "") and r["doc_id"] is not None)
    none = language_id.train(docs.filter("false"), docs["doc_id"] > -1)
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(empty, profiles).collect() == []


def plain_profile(texts, size=300):
    """Ranks of one- to three-letter n-grams of lower-case words, by strings and counters."""
    from collections import Counter

    counts = Counter()
    for text in texts:
        t = "".join(c if c.isalpha() else "_" for c in f"_{text.lower()}_")
        while "__" in t:
            t = t.replace("__", "_")
        counts.update(c for c in t if c != "_")
        counts.update(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))
    key = lambda g: sum((ord(c) if c != "_" else 0x110000) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))][:size]


def test_language_id_of_many_scripts(spark):
    """Predictions and scores equal those of plain out-of-place distances; scripts and a rare language are told apart."""
    words = {"ru": "это быстрая лиса прыгает через ленивую собаку", "el": "αυτή η αλεπού πηδάει πάνω από τον σκύλο", "ja": "これはとても速い狐です犬を飛び越える", "hi": "यह तेज़ लोमड़ी कुत्ते के ऊपर कूदती है", "en": "this quick fox jumps over the lazy dog"}
    rng, rows = random.Random(1), []
    for lang, text in words.items():
        parts = text.split() if lang != "ja" else list(text)
        for _ in range(3 if lang == "hi" else 60):
            rows.append((len(rows), " ".join(rng.choices(parts, k=12)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    profiles = language_id.train(df, df["doc_id"] >= 0)
    assert profiles.languages == sorted(words)
    want = {lang: plain_profile([t for _, t, k in rows if k == lang]) for lang in words}
    got = {r["doc_id"]: r for r in language_id.identify(df, profiles).collect()}
    for i, text, lang in rows:
        own = plain_profile([text])
        distance = {k: sum(abs(p.index(g) - r) if g in p else 300 for r, g in enumerate(own)) for k, p in want.items()}
        best = min(sorted(distance), key=distance.get)
        assert got[i]["lang_pred"] == best == lang and abs(got[i]["score"] - (1 - distance[best] / (300 * len(own)))) < 1e-9


def test_language_id_sample(spark):
    """Repeated rows teach once, a frequent language is cut to the bound, a rare one is whole; ties and nulls do not matter."""
    rows = [(1, "same words again", "xx")] * 50 + [(i, f"word {'ab'[i % 2] * 3}", "yy") for i in range(500)] + [(None, "rare thing", "zz"), (None, None, "zz"), (7, "no language", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS h", "'q' AS rows").repartition(3)
    once = language_id.train(df.dropDuplicates(["doc_id", "text", "lang"]), df["text"].isNull() | df["text"].isNotNull(), max_docs=40)
    again = language_id.train(df, df["text"].isNull() | df["text"].isNotNull(), max_docs=40)
    assert again.languages == once.languages == ["xx", "yy", "zz"] and (again.ranks[[0, 2]] == once.ranks[[0, 2]]).all()


def test_language_id_learns_every_language(spark, monkeypatch):
    """Also where the languages are joined, not broadcast: the same profiles."""
    rows = [(i, " ".join(chr(0x4E00 + 7 * (i % 40) + j) * 2 for j in range(5)), f"l{i % 40}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    first = language_id.train(docs, F.lit(True))
    assert len(first.languages) == 40
    monkeypatch.setattr(language_id, "BROADCAST_LANGUAGES", 10)
    second = language_id.train(docs, F.lit(True))
    assert first.languages == second.languages and (first.codes == second.codes).all() and (first.ranks == second.ranks).all()


def test_out_of_place_distance():
    codes, n = language_id.gram_counts("Abc, abd!")
    order = language_id.ranking(codes, n, 5)
    counts = dict(zip(codes.tolist(), n.tolist(), strict=True))
    assert len(order) == 5 and [counts[c] for c in order.tolist()] == sorted(n.tolist(), reverse=True)[:5]
    profiles = language_id.profiles_of([("x", c, k) for k, c in enumerate(language_id.ranking(codes, n).tolist())] + [("y", 1, 0)])
    assert profiles.predict("abc abd") == ("x", 1.0) and profiles.predict("1, 2") == ("und", 0.0)


def test_quality_rules(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_quality_rules"](spark, sf).collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert np.mean([quality[r["doc_id"]] == r["predicted"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 1000
    rule = quality_rules.RuleEnsemble(0.0, [(quality_rules.Rule((("letters", True, 0.5), ("upper", False, 0.2))), 2.0)])
    got = quality_rules.score_quality(odd, rule, keep=("score",)).collect()
    assert len(got) == odd.count()
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality_rules.train(odd, labels, labels["doc_id"] > 0).rules == []
    assert quality_rules.score_quality(empty, rule).collect() == []


PAGE = '<html><head><title>no</title><style>p{}</style></head><body><nav><a href=/>no</a></nav><div class="cookie notice">no</div><article><h1>Yes &amp; so</h1><p>One\n  two<br>three &eacute;&#33;<p>Four <b>five</b>.<script>no("</p>")</script></p></article><div id="comments"><p>no, I do not think so at all, not even a bit.</p></div><footer>no'


def test_html_extraction(spark):
    model = html_extract.train()
    assert html_extract.main_text(PAGE, model) == "Yes & so\nOne two three é!\nFour five."
    assert html_extract.main_text("<p>" + "Just a sentence of a page, quite long it is. " * 4, model).startswith("Just a sentence")
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<<<>><a <p"), (1, "u", PAGE), (5, "x", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(df.filter("false")).collect() == []


def test_html_messages_are_exact():
    """Marginals equal those of all assignments on a small tree."""
    import itertools

    model = html_extract.train()
    nodes, _ = html_extract.parse("<body><div class=ad><p>x</p><nav>y</nav></div><article><p>text of it</p></article></body>")
    pair = [((0.0, a), (b, c)) for a, b, c in model.potentials(nodes)]
    weight = {}
    for s in itertools.product((0, 1), repeat=len(nodes)):
        weight[s] = 0 if s[0] else np.exp(sum(pair[i][s[n.parent]][s[i]] for i, n in enumerate(nodes) if i))
    want = [sum(w for s, w in weight.items() if s[i]) / sum(weight.values()) for i in range(len(nodes))]
    assert np.allclose(model.marginals(nodes), want)


SAID = "Here we read another phrase that has quite a few words. "


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><ul><li>one</li><li>two</li></ul><table><tr><td>1</td></tr></table></article>", "one\ntwo\n1"),
        ("<article><p>a</p><p hidden>no</p></article>", "a"),
        ("<article><p>a</p><div style='display: none'>no<p>no</p></div>b</article>", "a\nb"),
        ("<p>A page of one paragraph with one sentence of some thirteen words here.</p>", "A page of one paragraph with one sentence of some thirteen words here."),
        (f"<main><p>{SAID * 5}</p><p>{SAID * 4}</p><div class='comment-box'><p>{SAID * 4}</p></div></main>", f"{(SAID * 5).strip()}\n{(SAID * 4).strip()}"),
        ("<article><p>where <math><mi>x</mi></math> is <object>fine</object> too</p><xmp><b>&amp;</b></xmp><p>end</p></article>", "where x is fine too\n<b>&amp;</b>\nend"),
        (f"<article><h1>T</h1><p>{SAID}</p><section class='user-comments'><h2>no</h2><p>{SAID * 3}</p></section></article>", f"T\n{SAID.strip()}"),
        (f"<div class=row><div class='col-8'><h1>T</h1><p>{SAID * 3}</p></div><div class='col-4'><ul><li><a href=1>no</a></li><li><a href=2>no</a></li></ul></div></div>", f"T\n{(SAID * 3).strip()}"),
        ("<body><nav><a href=x>no</a></nav><h1>Yes</h1><p>short</p><footer>no</footer></body>", "Yes\nshort"),
        ("only text", "only text"),
        (f"<article title='the hidden cost of it'><p>{SAID}</p></article>", SAID.strip()),
        (f"<article class='post hidden mobile'><p>{SAID}</p></article>", SAID.strip()),
        (f"<article><p title=it's>{SAID}</p></article>", SAID.strip()),
        (f"<article><p>If a<b and it's so. {SAID}</p><p>x<y</p></article>", f"If a<b and it's so. {SAID.strip()}\nx<y"),
        (f"<article><!--><p>{SAID}</p><!-- no --!><p>b</p></article>", f"{SAID.strip()}\nb"),
        (f"<article><p>{SAID}</p><p class=\"no", SAID.strip()),
        (f"<article><p aria-hidden=true>no</p><p aria-hidden=false title='aria-hidden=true'>{SAID}</p></article>", SAID.strip()),
        (f"<div class=a><div class=b><div class=c>{SAID * 3}</div></div></div>", (SAID * 3).strip()),
        (f"<nav><a href=/>no</a></nav><div><p>{SAID * 4}</p></div><div><ul><li><a href=1>no</a></li><li><a href=2>no</a></li></ul></div>", (SAID * 4).strip()),
        (f"<nav><a href=/>no</a></nav><div><p>{SAID * 4}</p></div><div><ul><li><a href=1>no, {SAID}</a></li><li><a href=2>no, {SAID}</a></li></ul></div>", (SAID * 4).strip()),
        (f"<article><p>{SAID * 2}<button>no</button></p></article>", (SAID * 2).strip()),
        (f"<div class=kopfzeile><a href=/>no</a></div><div class=inhalt><h1>Ein Titel</h1><p>{SAID * 2}</p></div><div class=fusszeile><a href=/i>no</a></div>", f"Ein Titel\n{(SAID * 2).strip()}"),
        ("<nav><ul><li><a href=/>no</a></li></ul></nav>", ""),
    ],
)
def test_html_layouts(html, want):
    assert html_extract.main_text(html, html_extract.train()) == want


def test_html_held_out_layouts():
    """Each fifth of the labelled parts, in all its surroundings, is read with weights that saw no page of it."""
    from collections import Counter

    pages = html_extract.labelled_pages()
    hit = said = real = 0
    for fold in range(5):
        model = html_extract.train(tuple(p for k, p in enumerate(pages) if k // 4 % 5 != fold))
        for page in (p for k, p in enumerate(pages) if k // 4 % 5 == fold):
            nodes, found = html_extract.parse(page)
            state = [0]
            for n in nodes[1:]:
                state.append({"main": 1, "off": 0}.get(n.label, state[n.parent]))
            want, got = Counter(t for k, t in found if state[k]), Counter(filter(None, html_extract.main_text(page, model).split("\n")))
            hit, said, real = hit + sum((want & got).values()), said + sum(got.values()), real + sum(want.values())
    assert 2 * hit / (said + real) > 0.92


def test_html_time_is_linear():
    import time

    model, began = html_extract.train(), time.time()
    for page in ("<div>" * 50_000 + "</span></x>" * 50_000 + "x", "<p><button>" + "<div>" * 50_000 + "</p>" * 50_000, '<a "' * 50_001, "<" * 100_000, "<li>" * 50_000, "<!--" * 50_000):
        html_extract.main_text(page, model)
    assert time.time() - began < 20


def test_html_pages(spark, sf):
    """The article stands in its element there; nothing else of the page comes out."""
    rows = {r["page_id"]: r for r in QUERIES["op6_html_extraction"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for r in pages:
        inner = r["html"].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        assert rows[r["page_id"]]["text"] == "\n".join(t for _, t in html_extract.parse(f"<article>{inner}</article>")[1])


def test_digest_columns(spark, sf):
    row = QUERIES["op4_bpe"](spark, sf).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").first()["text"]
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
