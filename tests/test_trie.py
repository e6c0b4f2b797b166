import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.errors import TrieError
from quernstone.functions.keccak import keccak256, keccak256_many
from quernstone.operators import trie


def frame(spark, kv):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in kv.items()], "k binary, v binary")


def test_keccak_vectors():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    sizes = [b"x" * n for n in (0, 1, 135, 136, 137, 272, 500)]
    assert keccak256_many(sizes) == [keccak256(x) for x in sizes]


@pytest.mark.parametrize("kv,root", [
    ({}, "00" * 32),
    ({b"alice": b"100"}, "465c6be4cb5b20a600edec7729bfb2a2bbf26d70f9a2e7b3791b7c42fb46e965"),
    ({b"alice": b"100", b"bob": b"200"}, "9a361cad3fe751a28911ad289d652bdf544b9b3aa6dfea6b0741103ffaa343c5"),
])
def test_smt_root_vectors(spark, kv, root):
    assert trie.smt_root(frame(spark, kv)).hex() == root


@pytest.mark.parametrize("kv,root", [
    ({}, "00" * 32),
    ({b"key1": b"value1"}, "0d3dffcbfbbd511d7cc9ce806c4437f4ca08cc46f0d6e314464d626cad0752da"),
    ({b"key1": b"value1", b"key2": b"value2"}, "8d2aa5c340521fbbb2816515b71b81b5504f66ec7e05f24bad90dfea84b70946"),
])
def test_mpt_root_vectors(spark, kv, root):
    assert trie.mpt_root(frame(spark, kv)).hex() == root


def plain_smt(kv):
    """Straight from the definition."""
    def at(rows, d):
        if not rows:
            return trie.EMPTY
        if len(rows) == 1:
            return keccak256(b"\x01" + rows[0][0] + rows[0][1])
        bit = lambda p: p[d >> 3] >> (7 - (d & 7)) & 1
        return keccak256(b"\x00" + at([r for r in rows if not bit(r[0])], d + 1) + at([r for r in rows if bit(r[0])], d + 1))

    return at([(keccak256(k), v) for k, v in kv.items()], 0)


def plain_mpt(kv):
    def node(rows):
        if len(rows) == 1:
            return trie.mpt_leaf(*rows[0])
        n = 0
        while all(len(p) > n and p[n] == rows[0][0][n] for p, _ in rows):
            n += 1
        if n:
            return trie.mpt_extension(rows[0][0][:n], keccak256(node([(p[n:], v) for p, v in rows])))
        kids = {i: keccak256(node(sub)) for i in range(16) if (sub := [(p[1:], v) for p, v in rows if p and p[0] == i])}
        return trie.mpt_branch(kids, next((v for p, v in rows if not p), None))

    return keccak256(node([(trie.nibbles(k), v) for k, v in kv.items()])) if kv else trie.EMPTY


def some(n, seed=1):
    rnd = random.Random(seed)
    keys = [bytes(rnd.choices(range(256), k=rnd.choice([0, 1, 2, 5]))) for _ in range(n)] + [b"", b"\x01", b"\x01\x02", b"\x01\x02\x03"]
    return {k: bytes(rnd.choices(range(256), k=rnd.randint(0, 4))) for k in keys}


def test_parts_do_not_change_roots(spark):
    kv = some(300)
    df = frame(spark, kv).cache()
    assert trie.smt_root(df) == trie.smt_root(df, part_rows=10) == plain_smt(kv)
    assert trie.mpt_root(df) == trie.mpt_root(df, part_rows=10) == plain_mpt(kv)


def test_keys_with_a_common_beginning(spark):
    kv = {b"\x80\x00\x00" + k: v for k, v in some(120, 5).items() if k}
    df = frame(spark, kv).cache()
    layout = trie.mpt_layout(df, part_rows=10)
    assert layout.common[:6] == bytes([8, 0, 0, 0, 0, 0]) and layout.prefix >= 1
    assert trie.mpt_root(df, part_rows=10) == plain_mpt(kv)
    for key in [*list(kv)[:3], b"", b"\x80\x00\x00", b"\x80\x01", b"\x80\x00\x00zz"]:
        q = trie.mpt_prove(df, key, part_rows=10)
        assert q.value == kv.get(key) and trie.mpt_verify(plain_mpt(kv), q)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(max_size=4), st.binary(max_size=3), max_size=12))
def test_local_folds(kv):
    rows = sorted((keccak256(k), keccak256(b"\x01" + keccak256(k) + v)) for k, v in kv.items())
    assert trie._fold(rows, 0) == plain_smt(kv)
    items = sorted((trie.nibbles(k), v) for k, v in kv.items())
    assert trie._root(trie.mpt_summary(items, 0)) == plain_mpt(kv)


@pytest.mark.parametrize("part_rows", [50_000, 8])
def test_proofs(spark, part_rows):
    kv = some(60, 2)
    df = frame(spark, kv).cache()
    smt, mpt = plain_smt(kv), plain_mpt(kv)
    for key in [*list(kv)[:5], b"", b"absent", b"\x01\x02\x03\x04"]:
        p = trie.smt_prove(df, key, part_rows=part_rows)
        assert p.value == kv.get(key) and trie.smt_verify(smt, key, p)
        assert not trie.smt_verify(bytes(31) + b"\x01", key, p)
        assert not trie.smt_verify(smt, key + b"x", p)
        q = trie.mpt_prove(df, key, part_rows=part_rows)
        assert q.value == kv.get(key) and trie.mpt_verify(mpt, q)
        assert not trie.mpt_verify(mpt, trie.MptProof(key, b"forged", q.nodes))
        assert not trie.mpt_verify(mpt, trie.MptProof(key, q.value, q.nodes[:-1]))
    with pytest.raises(TrieError):
        trie.smt_verify(smt, b"a", trie.SmtProof(keccak256(b"a"), None, (trie.EMPTY,) * 257))


def test_calculator_updates_touched_parts(spark, tmp_path):
    kv = some(80, 3)
    calc = trie.TrieCalculator(frame(spark, kv), part_rows=10)
    assert calc.root_hash() == plain_smt(kv)
    new, gone = b"new key", next(iter(kv))
    calc.batch_update(spark.createDataFrame([(bytearray(new), bytearray(b"1")), (bytearray(gone), None)], "k binary, v binary"))
    kv = {**{k: v for k, v in kv.items() if k != gone}, new: b"1"}
    assert calc.root_hash() == plain_smt(kv)
    assert calc.get(new) == b"1" and calc.get(gone) is None
    calc.save_cache(str(tmp_path / "c"), 7)
    other = trie.TrieCalculator(frame(spark, kv), part_rows=10)
    assert other.load_cache(str(tmp_path / "c")) == 7 and other.root_hash() == plain_smt(kv)
    assert other.load_cache(str(tmp_path / "none")) is None
    with pytest.raises(TrieError):
        trie.TrieCalculator(frame(spark, {}), "mpt").insert(b"x" * 1025, b"")


def test_mpt_cache_and_empty_proof(spark, tmp_path):
    kv = some(40, 4)
    calc = trie.TrieCalculator(frame(spark, kv), "mpt")
    root = calc.root_hash()
    calc.save_cache(str(tmp_path / "m"), 9)
    other = trie.TrieCalculator(frame(spark, kv), "mpt")
    assert other.load_cache(str(tmp_path / "m")) == 9 and other._root == root == plain_mpt(kv)
    other.insert(b"one more", b"1")
    assert other.root_hash() == plain_mpt({**kv, b"one more": b"1"})
    assert other.load_cache(str(tmp_path / "m")) is None
    none = trie.mpt_prove(frame(spark, {}), b"a")
    assert none.nodes == (b"\x00",) and trie.mpt_verify(trie.EMPTY, none)
    assert not trie.mpt_verify(trie.EMPTY, trie.MptProof(b"a", None, ())) and not trie.mpt_verify(plain_mpt(kv), none)


def test_updates_do_not_pile_up_plans(spark):
    calc = trie.TrieCalculator(frame(spark, some(30, 6)), part_rows=10)
    calc.root_hash()
    sizes = []
    for i in range(3):
        calc.insert(b"new%d" % i, b"x")
        calc.root_hash()
        sizes.append(len(calc._parts._jdf.queryExecution().optimizedPlan().toString()))
    assert max(sizes) - min(sizes) < 50
