import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import jaccard


def sets(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """Components by comparing all pairs."""
    own, root = {}, {}
    for i, t in rows:
        own.setdefault(i, []).append(sets(t))
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in own[a] for y in own[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(documents):
    rnd = random.Random(1)
    rows = []
    for g in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([6, 20, 60, 150]))]
        rows += [(len(rows) + k, edited(rnd, base, rnd.choice([0, 0, 1, 2, 3, 8]))) for k in range(rnd.randint(1, 8))]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(200 + i, passage + " " + " ".join(f"u{i}-{k}" for k in range(60))) for i in range(30)]  # share a passage, are no copies
    rows += [(300, None), (301, ""), (302, "a b"), (303, "A  B"), (304, "\x0ba\x0cb\r"), (305, "a b c"), (306, "x " * 20000), (307, "X " * 20000)]
    rows += [(308, rows[0][1].upper()), (308, rows[0][1].upper()), (309, "ä ö ü é è"), (310, "Ä ö ü é è")]
    rows = [(i + 7, t) for i, t in rows]
    rnd.shuffle(rows)
    docs = documents(rows).repartition(5).withColumn("n", F.lit(1)).withColumn("h", F.lit(2)).withColumn("key", F.lit(3))
    got = jaccard.link_documents(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    text = dict(rows)
    assert all(r.n_shingles == len(sets(text[r.doc_id])) for r in got)


def test_threshold_itself_is_a_link(documents):
    a = [f"a{i}" for i in range(11)]  # 7 shingles; with one of 9 shared by both: 7 / 9 and 6 / 8
    rows = [(1, " ".join(a)), (2, " ".join([*a, "x"])), (3, " ".join([*a[:-1], "q"])), (4, " ".join(a[:-1]))]
    got = {r.doc_id: r.component_id for r in jaccard.link_documents(documents(rows)).collect()}
    assert got == brute(rows)


def test_ids_with_several_texts_and_null_ids(documents):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (2, two), (3, one), (3, two), (None, one), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_documents(documents(rows)).collect()), key=str)
    assert got == sorted([(1, 26, 1), (2, 26, 1), (3, 26, 1), (3, 26, 1), (None, 26, None), (None, 0, None)], key=str)
    assert jaccard.link_documents(documents([])).count() == 0


def test_large_group_of_edited_copies(documents, monkeypatch):
    """Lists of one group, searched in small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 700)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, edited(rnd, base, rnd.choice([0, 1, 2, 3]))) for i in range(150)]
    got = {r.doc_id: r.component_id for r in jaccard.link_documents(documents(rows)).collect()}
    assert got == brute(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.comp for r in jaccard.components(df).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(40):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_keep_one(documents):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (3, a), (9, b), (9, b), (11, None), (11, None), (None, a)]
    got = jaccard.keep_one(documents(rows).withColumn("_nth", F.lit(0)).withColumn("row", F.lit(1)).withColumn("key", F.lit("k")))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_nth", "row", "key"]
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(["3", "9", "11", "11", "None"])


@pytest.mark.parametrize("text", ["", None, "a", "a b c d e f", "ß " * 9, "A\tB\nC d E f g", "x" * 300_000 + " y z w v u"])
def test_shingle_hashes_tell_sets_apart(text):
    assert len(jaccard.shingles(text)) == len(sets(text))
    low = (text or "").replace("A", "a")
    assert np.array_equal(jaccard.shingles(text), jaccard.shingles(low))


def thue_morse(letters, bits=11):
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << bits))


def test_words_that_polynomial_hashes_confuse(documents):
    rows = [(1, thue_morse("ab")), (2, thue_morse("ba")), (3, "x y z w " + thue_morse("ab")), (4, "x y z w " + thue_morse("ba"))]
    got = {r.doc_id: r.component_id for r in jaccard.link_documents(documents(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_divide_skip_against_all_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(60, rng.integers(1, 50))).astype(np.uint64) for _ in range(80)] + [np.arange(40, dtype=np.uint64)] * 3
    index = jaccard.Lists(sets)
    for q, s in enumerate(sets):
        wanted = np.arange(len(sets)) != q
        got = index.partners(s, wanted).tolist()
        assert got == [i for i, t in enumerate(sets) if i != q and 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))]


def test_group_whose_texts_hardly_link(documents, monkeypatch):
    """A passage fills most of every text, so lists stay open after the leaders' round; result rows don't grow with its square."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2000)
    rnd = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage[: rnd.randint(40, 60)], *(f"u{rnd.randrange(300)}" for _ in range(rnd.randint(8, 20)))])) for i in range(160)]
    got = {r.doc_id: r.component_id for r in jaccard.link_documents(documents(rows)).collect()}
    assert got == brute(rows)


def test_parities_deny_no_partners():
    rng = np.random.default_rng(7)
    denied = 0
    for _ in range(600):
        pool = rng.integers(0, 1 << 64, int(rng.integers(1, 400)), dtype=np.uint64)
        pool = np.unique(np.concatenate([pool, pool[: len(pool) // 3] + np.uint64(1 << 40)]))  # some fall on one place
        a, b = (np.unique(rng.choice(pool, max(1, int(len(pool) * rng.uniform(0.5, 1))), replace=False)) for _ in "ab")
        own = [np.frombuffer(jaccard.parity(x), dtype=np.uint8) for x in (a, b)]
        links = 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        assert jaccard.may_reach(*own, len(a), len(b)) or not links
        denied += not jaccard.may_reach(*own, len(a), len(b))
    assert denied > 200


def test_sets_of_texts_that_share_half_are_not_moved(documents, monkeypatch):
    """Pairs share two of three shingles, which is too little: no text's set has to be gathered to find that out.

    Flat counters order shingles by hash alone, as the sketch's noise does in a large corpus.
    """
    moved, sets_of = [], jaccard.sets_of
    monkeypatch.setattr(jaccard, "levels", lambda profiles: bytes(1 << jaccard.COUNTER_BITS))
    monkeypatch.setattr(jaccard, "sets_of", lambda docs, ids: moved.append(ids.count()) or sets_of(docs, ids))
    rows = [(2 * g + k, " ".join([*(f"g{g}-{i}" for i in range(120)), *(f"u{g}-{k}-{i}" for i in range(60))])) for g in range(30) for k in (0, 1)]
    got = jaccard.link_documents(documents(rows)).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 60
    assert sum(moved) == 0


@pytest.mark.parametrize("paired", [0, 5, 1000])
def test_pairs_of_short_lists_and_blocks_of_long_ones(documents, monkeypatch, paired):
    """Chains of texts, each cut from the one before, that share a passage with all: links run over lists of any length."""
    found, blockwise = [], jaccard.blockwise
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "blockwise", lambda *x: found.append(blockwise(*x)) or found[-1])
    rnd, rows = random.Random(11), []
    passage = [f"p{i}" for i in range(30)]
    for g in range(8):
        own = [f"g{g}-{i}" for i in range(200)]
        rows += [(len(rows) + k, " ".join([*passage, *own[5 * k : 5 * k + 60]])) for k in range(24)]
    rnd.shuffle(rows)
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1001, rows[50][1]), (None, rows[0][1])]
    got = {r.doc_id: r.component_id for r in jaccard.link_documents(documents(rows)).collect() if r.doc_id is not None}
    assert got == brute([r for r in rows if r[0] is not None])
    assert found[0].count() > 0
