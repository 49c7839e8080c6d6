import random

import numpy as np
import pytest

from litgraph.llm import common, embedding_dedup, jaccard_join

from . import brute


def check_jaccard(df):
    """Against all pairs that share a shingle."""
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute.jaccard_components(rows)
    got = jaccard_join.link(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_documents(spark):
    check_jaccard(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_jaccard_chains_ties_and_hot_passages(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LARGE", 8)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(60):  # dissimilar documents that share a passage
        rows.append(" ".join([*[word() for _ in range(25)], *passage, *[word() for _ in range(10)]]))
    for i in range(12):  # a chain: neighbours are similar, ends are not
        base = [f"w{k}" for k in range(i * 3, i * 3 + 80)]
        rows.append(" ".join(base))
    base = [word() for _ in range(100)]
    for i in range(30):  # near copies
        rows.append(" ".join([*base, word()]))
    rows += ["", None, " \n ", "a b", "A  b", "a b c d", "a b c d e", "a b c d e f", "a b c d e f", "x " * 500]
    for n in range(1, 14):  # small sets
        rows += [" ".join(f"s{k}" for k in range(n + 4)), " ".join(f"s{k}" for k in range(n + 5))]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS h1", "'q' AS id").repartition(5)
    check_jaccard(df)


def test_jaccard_large_groups_meet_in_several_blocks(spark, monkeypatch):
    """Sets that share most of their signatures with a whole group, but only few of which are similar."""
    monkeypatch.setattr(jaccard_join, "LARGE", 4)
    monkeypatch.setattr(jaccard_join, "MEET", 8)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for size in (24, 40, 70):
        passage = [word() for _ in range(size)]
        for _ in range(40):  # near one another, at the threshold on both sides
            rows.append(" ".join([*passage, *[word() for _ in range(rng.randrange(1, size // 4))]]))
    passage = [word() for _ in range(30)]
    for _ in range(40):  # pairs that are similar beside a passage that all have
        own = [word() for _ in range(20)]
        rows += [" ".join([*passage, *own]), " ".join([*passage, *own[:-1], word()])]
    rng.shuffle(rows)
    met = []
    meet = jaccard_join.meet
    monkeypatch.setattr(jaccard_join, "meet", lambda members, *a: met.append(members.agg({"members": "max"}).first()[0]) or meet(members, *a))
    check_jaccard(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4))
    assert met and met[0] is not None and met[0] > 2 * 8


def test_words_in_pieces(monkeypatch):
    """Texts cut into pieces of any length have the same shingles."""
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choices("ab  \n\tÄ", k=rng.randrange(60))) for _ in range(200)] + ["x" * 50, "", None, "  ", "a " * 40, "ÄÖ " * 9]
    whole = jaccard_join.shingle_sets(pa.array(texts))
    one = [jaccard_join.shingle_sets(pa.array([t], pa.string())) for t in texts]
    assert whole[1].tolist() == [int(n[0]) for _, n in one] == [len(brute.shingles(t)) for t in texts]
    assert whole[0].tolist() == np.concatenate([e for e, _ in one]).tolist()
    for size in (1, 2, 3, 7, 16):
        monkeypatch.setattr(common, "HASH_BYTES", size)
        again = jaccard_join.shingle_sets(pa.array(texts))
        assert again[0].tolist() == whole[0].tolist() and again[1].tolist() == whole[1].tolist()


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(None, "one two three four five six"), (7, "one two three four five six"), (7, "one two three four five six"), (8, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.link(df).collect())
    assert got == [("7", 2, 7), ("7", 2, 7), ("8", 0, 8), ("None", 2, 7)]
    assert jaccard_join.link(df.filter("false")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 4, 5, 9, 13, 30, 77, 300])
def test_partenum_finds_every_near_pair(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        most = size * 20 // 80 if rng.random() < 0.5 else 0
        grown = np.unique(np.concatenate([a, rng.integers(0, 1 << 63, rng.integers(0, most + 1), dtype=np.uint64)]))
        n_off = int(rng.integers(0, max(1, size // 9) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[n_off:], rng.integers(0, 1 << 63, n_off, dtype=np.uint64)]))
        for c in (grown, b):
            i = len(np.intersect1d(a, c))
            if len(c) and 100 * i >= 80 * (len(np.unique(a)) + len(c) - i):
                owner, sig, split, spare = jaccard_join.signatures(np.concatenate([np.unique(a), c]), np.array([size, len(c)]))
                x, y = ({s: (k, m) for o, s, k, m in zip(owner.tolist(), sig.tolist(), split.tolist(), spare.tolist(), strict=True) if o == side} for side in (0, 1))
                # as many are shared as each of the two has to spare, and one more
                assert any(sum(k == x[s][0] for s in {*x} & {*y}) > max(x[t][1], y[t][1]) for t in {*x} & {*y} for k in (x[t][0],))


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r["id"]: r["component"] for r in common.components(df).collect()}
    ids = {i for e in links if e[0] != e[1] for i in e}
    assert got == brute.components(ids, [e for e in links if e[0] != e[1]])
    assert common.components(df.filter("false")).collect() == []


def brute_vectors(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    n = {i: int(near[k].sum()) for k, (i, _) in enumerate(ok)}
    links = [(ok[a][0], ok[b][0]) for a, b in zip(*np.nonzero(near), strict=True)]
    c = brute.components([i for i, _ in rows], links)
    return {i: (n.get(i, 0), c[i]) for i, _ in rows}, near.sum() / 2


def test_embeddings_recall_and_no_false_links(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want, _ = brute_vectors([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link(df).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())


def test_embeddings_at_the_threshold(spark, monkeypatch):
    """Pairs with cosines just over the threshold, large groups in several blocks, odd rows."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for _ in range(300):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9, 0.93)
        rows += [(k, a.tolist()), (k + 1, (2.5 * (c * a + np.sqrt(1 - c * c) * b)).tolist())]
        k += 2
    centre = rng.standard_normal(64)
    rows += [(k + i, (centre + 0.05 * rng.standard_normal(64)).tolist()) for i in range(60)]
    rows += [(k + 100 + i, centre.tolist()) for i in range(40)]
    rows += [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [None] * 64), (9005, []), (9006, [1.0, 2.0]), (9007, [float("inf")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'z' AS id", "1 AS n")
    want, n = brute_vectors([r for r in rows if r[0] != 9006])
    got = {r["vec_id"]: r for r in embedding_dedup.link(df).collect()}
    assert len(got) == len(rows) and all(got[i]["n_links"] <= want[i][0] for i in want)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * 2 * n
    assert all(got[i]["n_links"] == want[i][0] for i in range(k, k + 60)) or sum(got[i]["n_links"] for i in range(k, k + 60)) > 0.99 * sum(want[i][0] for i in range(k, k + 60))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.link(df.filter("false")).collect() == []
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(9001, 9008))


def threshold_pairs(rng, n, size, low, high):
    a, b = rng.standard_normal((2, n, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(low, high, (n, 1))
    return a, c * a + np.sqrt(1 - c * c) * b


@pytest.mark.parametrize(("n", "size"), [(2_000, 64), (16_000, 64), (80_000, 64), (1_000_000, 64), (80_000, 8), (80_000, 384), (5_000, 2), (5_000, 3)])
def test_embeddings_filters_find_isolated_pairs(n, size):
    """Pairs right at the threshold alone, for tables of ``n`` vectors."""
    code = embedding_dedup.CapFilters(n, size, 0.9, 11)
    for low, high in ((0.9, 0.9), (0.9, 0.93)):
        x, y = (code.decode(v).to_pylist() for v in threshold_pairs(np.random.default_rng(n + size), 2000, size, low, high))
        assert np.mean([bool(set(a) & set(b)) for a, b in zip(x, y, strict=True)]) >= 0.975


def test_embeddings_isolated_pairs(spark):
    x, y = threshold_pairs(np.random.default_rng(4), 1000, 64, 0.9, 0.93)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    _, n = brute_vectors(rows)
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert 2 * n >= sum(r["n_links"] for r in got) >= 0.975 * 2 * n


def test_embeddings_of_several_lengths_and_null_ids(spark):
    rng = np.random.default_rng(6)
    rows, k = [], 0
    for size in (5, 8, 64):
        for x in rng.standard_normal((300, size)):
            rows += [(k, x.tolist()), (k + 1, (2 * x).tolist()), (k + 2, x.tolist())]
            k += 3
    # a chain whose middle has no id, and a class without any
    turn = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0]
    rows += [(7001, turn(0.0)), (None, turn(0.4)), (None, turn(0.4)), (7000, turn(0.8)), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0]), (7002, [3.0])]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None}
    for start in range(0, k, 900):
        want, _ = brute_vectors([r for r in rows[start : start + 900]])
        assert all(by[i][0] <= want[i][0] for i in want) and sum(by[i][0] for i in want) >= 0.97 * sum(w[0] for w in want.values())
    assert by[7000] == (2, 7000) and by[7001] == (2, 7000) and by[7002] == (0, 7002)
    assert sorted((r["n_links"], str(r["component_id"])) for r in got if r["vec_id"] is None) == [(1, "None"), (1, "None"), (3, "7000"), (3, "7000")]
    assert not any(r["kept"] for r in got if r["vec_id"] is None)


def test_jaccard_nul_is_part_of_a_word(spark):
    words = [f"w{k}" for k in range(30)]
    rows = [" ".join(words), " ".join(words).replace("w3 ", "w3\0"), " ".join([*words, "\0"]), "a\0b c d e f", "a b c d e f", "\0", "\0a \0b", "a b"]
    check_jaccard(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
