import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernstone.llm import bpe, packing, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", None, " ", "\n\t", "a" * 5000, "thethe" * 900, "x<|endoftext|>Y <|startoftext|>", "ÉÊ été ΑΣ́ ı İ", "a b\x1cc\xa0d", "it's we'll 12,345 !!?? $$", "日本語 text", "😀😀"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBPE(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "'s", "É", "<|endoftext|>", "<|", " ", "\n", "1", "!!", "aaaa", "ing", "Σ", "́", "\x1d", "ß"]), max_size=60))
def test_same_ids_as_library(parts):
    text = "".join(parts)
    mine = bpe.loaded(PATH).encode(text)
    assert mine == ids(text)
    assert bpe.loaded(PATH).decode(mine) == LIBRARY.decode(mine, skip_special_tokens=False)


def test_cuts_are_where_no_token_spans(coder):
    letters = dict(zip(bpe.byte_alphabet(), range(256), strict=True))
    joined = {(letters[t[0]], letters[t[1]]) for t in coder.tokens.values() if len(t) == 2 and t[0] in letters and t[1] in letters}
    assert all(coder.joined[a, b] for a, b in joined)
    assert not coder.joined[ord("1"), ord("1") + 256] or any("11</w>" in t for t in coder.tokens.values())


def test_digests(documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, ""), (None, "a")]
    got = bpe.digest_documents(documents(rows), PATH).collect()
    want = Counter((i, len(x := ids(t)), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, t in rows)
    assert Counter(map(tuple, got)) == want
    full = {r["doc_id"]: r for r in bpe.encode_documents(documents(rows[: len(ODD)]), PATH).collect()}
    assert all(full[i]["ids"] == ids(t) for i, t in enumerate(ODD))
    assert bpe.digest_documents(documents([]), PATH).count() == 0


def test_memo_forgets(coder):
    memo = bpe.Memo(coder, bpe.as_bytes, limit=3)
    texts = ["a b c d", "e f g a", "a b x"]
    for t, chunks in zip(texts, memo.batches(texts, step=1), strict=True):
        assert b"".join(memo.known[c] for c in chunks) == b"".join(i.to_bytes(4, "little") for i in ids(t))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=12))
def test_plan_places_every_length(counts):
    bins = packing.plan(counts, 60)
    held = Counter()
    for b in bins:
        assert sum(n * k for n, k in b.items) <= 60
        for n, k in b.items:
            held[n] += k * b.number
    assert held == Counter(counts)
    total = sum(n * c for n, c in counts.items())
    assert -(-total // 60) <= sum(b.number for b in bins) <= 11 * max(1, -(-total // 60)) / 9 * 1.5 + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=7))
def test_reduction_keeps_the_optimum(items):
    def best(left):
        if not left:
            return 0
        head, rest, out = left[0], left[1:], len(left)
        for mask in range(1 << len(rest)):
            mine = [x for k, x in enumerate(rest) if mask >> k & 1]
            if head + sum(mine) <= 10:
                out = min(out, 1 + best([x for k, x in enumerate(rest) if not mask >> k & 1]))
        return out

    fixed, rest = packing.reduce(Counter(items), 10)
    assert sum(b.number for b in fixed) + best(sorted(Counter(rest).elements())) == best(sorted(items))


def test_pack_documents(documents):
    rnd = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "word " * rnd.randint(0, 3000)) for i in range(60)] + [(0, "")]
    docs = documents(rows).withColumn("rank", F.lit(1)).withColumn("length", F.lit("x"))
    got = packing.pack_documents(docs, PATH).collect()
    want = Counter()
    for i, t in rows:
        x = [*ids(t), 0]
        for p in range(0, len(x), 2048):
            part = x[p : p + 2048]
            want[(i, p // 2048, p, len(part), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(documents([]), PATH).count() == 0


def test_shards(documents):
    rows = [(i, f"t{i % 7}") for i in range(3000)] + [(5, None), (None, ""), (5, None)]
    got = sharding.shard_documents(documents(rows).withColumn("shard", F.lit(9)).withColumn("_bucket", F.lit(1))).collect()
    assert len(got) == len(rows)
    slots, home = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert home.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) == set(range(16))
    assert max(map(len, slots.values())) < 1.4 * min(map(len, slots.values()))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0)}
    assert sharding.shard_documents(documents([])).count() == 0


def test_weights_move_rows_only_within_changed_subtrees(spark):
    keys = spark.range(8000)
    a, b = sharding.topology(16), sharding.topology(16, weights={3: 2.0})
    both = sharding.assign(sharding.assign(keys, F.col("id"), a, "a_"), F.col("id"), b, "b_").collect()
    moved = [r for r in both if r.a_shard != r.b_shard]
    assert moved and all(r.b_region == 0 for r in moved)
    assert all(r.b_rack == 0 for r in moved if r.a_region == 0)
    assert all(r.b_shard == 3 for r in moved if r.a_rack == 0)
    with pytest.raises(ValueError):
        sharding.assign(keys, F.col("id"), sharding.topology(1, weights={0: 0.0}))
