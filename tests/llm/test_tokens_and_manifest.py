"""Operators 11 to 13 against brute force and the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from litgraph.llm import merkle_manifest, sentence_pieces, token_alignment
from litgraph.llm.bpe import byte_letters
from litgraph.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, difference

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (9001, None), (9002, ""), (9003, "a▁b"), (9004, "x<|endoftext|>y \n\n  z\t\tq\x1c\x1d é\x00;\r\n ;\r a　 b  "), (9005, " " * 40 + "the"),
    (9005, "日本語テキスト😀 naïve <s></s> <0x41>"), (None, "\n \n a"), (9006, "same"), (9006, "same"), (9007, "ab" * 30_000),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd).withColumn("row", F.lit(1)).withColumn("ids", F.lit("x"))


@pytest.fixture(scope="module")
def codec():
    return sentence_pieces.PieceCodec(B)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=B)


def compare(codec, library, texts):
    ids, ends = codec.encode_block(texts)
    start = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        got = ids[start:end].tolist()
        assert got == library.encode(text, add_eos=True), text[:100]
        assert codec.decode(got) == library.decode(got), text[:100]
        start = end


def test_pieces_of_random_texts(codec, library):
    rng = random.Random(5)
    signs = "  ▁\n\r\t;)abcethé日\U0001f600\x00Ωмир€"
    compare(codec, library, ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)])
    names = [n.replace("▁", " ") for n in codec.name]
    compare(codec, library, ["".join(rng.choices(names, k=rng.randint(1, 12))) for _ in range(3000)])
    compare(codec, library, [" " * k + end for k in range(60) for end in ("", "the", "\n")])


def test_pieces_need_backtracking(codec, library):
    """Longest matches alone are wrong for these, and no position is tried twice in a long word."""
    words = [w for w in {n.strip("▁") + m.strip("▁") for n, m in zip(codec.name[300:9000], codec.name[9000:17700], strict=True)} if w and all(c in codec.letters for c in w)]
    greedy = []
    for w in words:
        found, at = [], 0
        while at < len(w):
            piece = next(w[at:k] for k in range(min(len(w), at + 20), at, -1) if w[at:k] in codec.id_of)
            found.append(piece)
            at += len(piece)
        if found != codec.merge(w):
            greedy.append(w)
    assert len(greedy) > 50
    for w in greedy:
        assert codec.backtrack(w) == codec.merge(w)
    compare(codec, library, ["".join(random.Random(1).choices("abcdeth", k=30_000)), "a" * 50_000, "=" * 5000 + "-" * 777])


def test_piece_digests(spark, docs, library):
    got = sorted(map(str, sentence_pieces.digests(sentence_pieces.encode_decode(docs, B)).collect()))
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={a}, n_tokens={b}, ids_sha256='{c}', decoded_sha256='{d}')" for a, b, c, d in want)
    assert sentence_pieces.encode_decode(docs.limit(0), B).count() == 0


def align_plainly(rows, b):
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters, inverse = byte_letters(), {i: p for p, i in a.get_vocab().items()}
    documents, held = [], Counter()
    for doc_id, text in rows:
        x, y, groups = [], [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_x = [bytes(letters[c] for c in inverse[i]) for i in x]
            bytes_y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(bytes_x) == (" " + text).encode() == b"".join(bytes_y):
                ends_x, ends_y = np.cumsum([len(t) for t in bytes_x]).tolist(), np.cumsum([len(t) for t in bytes_y]).tolist()
                i = j = 0
                for cut in sorted(set(ends_x) & set(ends_y)):
                    k, m = ends_x.index(cut) + 1, ends_y.index(cut) + 1
                    groups.append((x[i:k], y[j:m]))
                    i, j = k, m
            else:
                x, y = [], []
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        held.update(links.keys())
        documents.append((doc_id, x, y, groups, links))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    for doc_id, x, y, groups, links in documents:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        n_best = sum(m for k, m in links.items() if held[k] == best[k[0]])
        yield doc_id, len(x), len(y), len(groups), sum(links.values()), n_best, sum(m * held[k] for k, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""


@pytest.mark.parametrize("most_common", [1 << 20, 300])
def test_alignment(spark, docs, library, most_common):
    """All counts broadcast, and all but the most common ones joined."""
    rows = [r for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 20_000]
    few = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = token_alignment.align(few, A, B, digest=True, most_common=most_common).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, align_plainly(rows, library)))


def test_stretches_met_again_are_not_learned_again(monkeypatch):
    monkeypatch.setattr(token_alignment, "MEMO", 8)
    kept, learned = token_alignment.Aligner(A, B), []
    learn = kept.learn
    kept.learn = lambda new: (learned.extend(new), learn(new))
    for texts in (["one two", "tḧree 4 \x00", None], ["one two five six seven eight nine"], ["two one zwölf", "<unk> ▁ a"], ["one ten"]):
        fresh = token_alignment.Aligner(A, B)
        got, want = ([x.block(texts), x] for x in (kept, fresh))
        assert [[x.known.text[i] for i in at] for at, x in ((t, got[1]) for t in got[0])] == [[x.known.text[i] for i in at] for at, x in ((t, want[1]) for t in want[0])]
        assert all(np.array_equal(x, y) for x, y in zip(kept.occurrences(got[0]), fresh.occurrences(want[0]), strict=True))
    assert learned.count(" one") == learned.count(" two") == 1


def test_alignment_of_nothing_and_text(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert token_alignment.align(empty, A, B).collect() == []
    row = token_alignment.align(spark.createDataFrame([("x", "ab" * 30_000), ("y", "hi")], "doc_id string, text string"), A, B).orderBy("doc_id").collect()
    assert row[0]["n_a"] and row[1]["groups"].count("|") == row[1]["n_groups"]


def merkle(rows):
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    sources, found = defaultdict(list), []
    for r in rows:
        text = r[4]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        sources[r[1]].append((r[0], h(*map(coded, r)), h(*map(coded, (*r[:4], text)))))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            start = i // 16 * 16
            yield level[start:i], level[i + 1 : start + 16]
            i //= 16

    keys = sorted(sources, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        sources[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {k: tree([x[1] for x in sources[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    for j, k in enumerate(keys):
        for i, (doc_id, leaf, folded) in enumerate(sources[k]):
            steps = [*path(trees[k], i), *path(top, j)]
            for left, right in steps:
                folded = h(*left, folded, *right)
            yield doc_id, leaf, trees[k][-1][0], top[-1][0], h(*[x for left, right in steps for x in left + right]), folded, folded == top[-1][0]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def received():
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered).otherwise(F.col("text"))


def test_manifest(spark):
    """Nulls everywhere, ties, many sources, sources of one leaf, and one of several tiers of blocks."""
    rows = [(None, None, None, None, None)] * 2 + [(5, "", None, 3, "ABC"), (7, "é", None, 3, "ABC"), (7, "é", None, 3, "ABC"), (7, "é", "x", 3, "É" * 100_000), (8, "z", "x", 1, "")]
    rows += [(i, f"s{i}", "en", i, "Xy") for i in range(270)] + [(i, "big", "en", i, "Xy") for i in range(4500)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit(1)).withColumn("tree", F.lit("t"))
    got = merkle_manifest.verify(df, received()).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, merkle(rows)))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle_manifest.verify(spark.createDataFrame([], SCHEMA), received()).collect() == []
    one = [(3, "a", None, 1, "x")]
    assert [tuple(r) for r in merkle_manifest.verify(spark.createDataFrame(one, SCHEMA), received()).collect()] == list(merkle(one))


def test_addresses_are_van_emde_boas():
    """Each place is used once, the root comes first, and each lower subtree of a cut at half height is one stretch."""
    for levels in range(1, 6):
        places = [merkle_manifest.addresses(levels, d, np.arange(16**d)) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle_manifest.nodes_in(levels))) and places[0][0] == 0
    upper = merkle_manifest.nodes_in(2)
    for k in (0, 7, 255):
        inner = [merkle_manifest.addresses(4, 2 + d, np.arange(k * 16**d, (k + 1) * 16**d)) for d in range(2)]
        assert sorted(np.concatenate(inner).tolist()) == list(range(upper + 17 * k, upper + 17 * (k + 1)))
    assert [merkle_manifest.tiers(h) for h in (0, 3, 4, 5, 7, 10)] == [[0], [3], [2, 2], [3, 2], [2, 2, 3], [3, 2, 3, 2]]


def test_stored_blocks_prove_alone(spark):
    """A document is proven from the manifest's rows on its path only."""
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", "en", 1, f"t{i}") for i in range(600)], SCHEMA)
    found = merkle_manifest.manifest(df)
    blocks = found.blocks().collect()
    assert sum(r["leaves"] for r in blocks if r["level"] == "documents" and r["tier"] == 0) == 600
    block = next(r for r in blocks if r["level"] == "documents" and r["tree"] == "1a")
    levels = merkle_manifest.levels_of(bytes(block["nodes"]), block["height"], block["leaves"])
    assert merkle_manifest.fold(levels[0][77], merkle_manifest.siblings(levels, 77)) == bytes(block["root"]).hex()


def test_manifest_sql(spark, sf):
    assert difference(spark, connect(sf), QUERIES["op13_merkle_manifest"], ORACLE_SQL["op13_merkle_manifest"], sf) is None


def test_bpe_blocks_are_small_and_memory_is_given_back(spark, monkeypatch):
    """A worker holds the pre-tokens of one block, and blocks that are used up give memory back."""
    import pyarrow as pa

    from litgraph.llm import bpe, common

    seen = []
    monkeypatch.setattr(common, "release", lambda: seen.append("released"))
    texts = pa.record_batch({"text": ["a b " * 100_000] * 4})
    for batch in common.blocks(iter([texts]), "text", bpe.BLOCK_BYTES):
        seen.append(batch.num_rows)
    assert seen == [2, 2, "released"]
