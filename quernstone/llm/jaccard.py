"""N-gram Jaccard join by T-occurrence search (operator 8).

Two texts of a and b distinct shingles that reach the similarity share at least T of them. All shingles stand
under one order, the rarest first (counted by a sketch over the whole corpus, then by hash); with its T - 1 last
lists set aside, a text's partners have to occur in the rest. Only those lists are built for the whole corpus.

A first round asks for one partner only, each list's leader. Only components are wanted, so lists whose members are
then in one component are done. The members of the others are dealt into blocks of bounded size, those of one list
side by side, and DivideSkip runs for every two blocks where two texts may be partners: they share short lists often
enough, and parities of their sets, which bound the overlap from above, allow it. It keeps one block's inverted lists of
all its shingles, merges each query's short lists, probes the long ones by binary search for the candidates found,
and retains those that reach the overlap of their sizes. No list is cut off and no candidate dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, maybe_broadcast

WORDS, PERCENT = 5, 75
#: Counters of the sketch that orders shingles by how common they are; 16 slices of them are summed apart.
COUNTER_BITS, SLICES = 22, 16
_SLICE = (1 << COUNTER_BITS) // SLICES
#: Parts that a list of the highest counters is dealt into.
SALTS = 256
#: Shingles of a block's texts, on average at most, and what a step from one class of sizes to the next multiplies sizes by.
BLOCK_SHINGLES, CLASS_STEP = 250_000, 1.1
#: Open lists of up to so many postings are taken apart into pairs; longer ones are compared by blocks and classes of sizes.
PAIRED = 16
#: The weight of a probe against a merge that decides how many lists are long (DivideSkip).
PROBE_COST = 0.0085

#: Seed of the words' hash, which has no structure that words could share, and two odd numbers that mix.
SEED = 0x51ED2701A3C4B657
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_word_hash = partial(xxhash.xxh3_64_intdigest, seed=SEED)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of WORDS words; of the whole text, if it has fewer.

    A-Z are lower-cased; words are what stands between ASCII white space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    one = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))
    k = min(WORDS, len(words))
    h = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h *= _MIX[0]
        h += one[i : i + len(h)]
    h ^= h >> np.uint64(31)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def required(n: int) -> int:
    """The least overlap that a text of n shingles has with any partner."""
    return -(-PERCENT * n // 100)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parity(s: np.ndarray) -> bytes:
    """Whether an odd number of members falls on a place, a bit for each of at least twice as many places as members."""
    places = 1 << max(3, (2 * len(s) - 1).bit_length())
    count = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits(count.astype(np.uint8) & 1, bitorder="little").tobytes()


def may_reach(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
    """Whether sets of n and m members with the parities x and y may reach the similarity.

    What both sets have cancels out, and each odd place of the rest takes a member of one set only: so the odd places are
    at most as many as the members that aren't shared. The longer parity is folded to the places of the other.
    """
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    odd = int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum(dtype=np.int64))
    return odd <= n + m - 2 * -(-PERCENT * (n + m) // (100 + PERCENT))


def _pack(counts: np.ndarray) -> bytes:
    """Counters as bytes: places and values if few are set, else all, compressed."""
    at = np.flatnonzero(counts)
    if len(at) < len(counts) // 8:
        return b"s" + at.astype("<u4").tobytes() + counts[at].astype("<u4").tobytes()
    return b"d" + zlib.compress(counts.astype("<u4").tobytes(), 1)


def _unpack(data: bytes, total: np.ndarray) -> None:
    """Add counters in bytes to a total."""
    if data[:1] == b"s":
        at, value = np.frombuffer(data[1:], dtype="<u4").reshape(2, -1)
        total[at] += value
    else:
        total += np.frombuffer(zlib.decompress(data[1:]), dtype="<u4")


def profile(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, n, key: digest of its set, bits: its parity), and rows of counters (slice, counts) of its part."""

    def run(batches):
        counts, seen = np.zeros(1 << COUNTER_BITS, dtype=np.uint32), False
        for b in batches:
            n, key, bits = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                n.append(len(s)), key.append(_digest(s) if len(s) else None), bits.append(parity(s) if len(s) else None)
                np.add.at(counts, (s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), np.uint32(1))
            seen = seen or any(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if seen:
            packed = [_pack(counts[i * _SLICE : (i + 1) * _SLICE]) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names)

    names = ["doc_id", "n", "key", "bits", "slice", "counts"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, bits binary, slice int, counts binary")


def levels(profiles: DataFrame) -> bytes:
    """How far each counter stands above the mean, in eighths of its deviation, a byte for each.

    A shingle of several texts stands behind most of those that share its counter with single ones only. The
    counters are of a fixed number, so what reaches the driver and the tasks does not grow with the corpus.
    """

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                _unpack(data, total.setdefault(i, np.zeros(_SLICE, dtype=np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["slice", "counts"])

    got = profiles.filter("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(run, "slice int, counts binary").collect()
    counts = np.zeros(1 << COUNTER_BITS, dtype=np.float64)
    for r in got:
        counts[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint64)
    mean = counts.mean()
    steps = 8 * (counts - mean) / np.sqrt(mean + 1)
    return np.clip(np.rint(steps) + 100, 0, 255).astype(np.uint8).tobytes()


def short_lists(docs: DataFrame, level: bytes) -> DataFrame:
    """Postings (h, doc, n, salt) of each text's first lists: its rarest n - T + 1 shingles. Equal sets are posted once a task.

    Salt deals the lists with the highest counters, which may hold any share of the rows, into SALTS parts; else it is 0.
    """

    def run(batches):
        table, seen = np.frombuffer(level, dtype=np.uint8), set()
        names = ["h", "doc", "n", "salt"]

        def rows(parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in parts], names)

        for b in batches:
            parts, held = ([], [], [], []), 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(t)
                if i is None or not len(s) or (k := _digest(s)) in seen:
                    continue
                seen.add(k)
                p = len(s) - required(len(s)) + 1
                height = table[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                at = np.lexsort((s, height))[:p]
                salt = np.where(height[at] == 255, 1 + zlib.crc32(k) % SALTS, 0)
                for x, y in zip(parts, (s[at].view(np.int64), np.full(p, i), np.full(p, len(s)), salt), strict=True):
                    x.append(y)
                held += p
                if held > 200_000:
                    yield rows(parts)
                    parts, held = ([], [], [], []), 0
            if held:
                yield rows(parts)

    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc long, n long, salt long")


def shared_lists(postings: DataFrame) -> DataFrame:
    """The postings of lists with several documents: h, doc, n, times and the list's leader (lead, lead_n).

    Salted lists are common ones, which are kept without a look at their members.
    Equal lists are kept once, with their number. The leader is the member that shares the most postings with
    others: in a group of edited copies that is the text they were made from, or one close to it.
    """
    w = Window.partitionBy("h", "salt")
    own = postings.withColumn("first", F.min("doc").over(w)).withColumn("last", F.max("doc").over(w)).filter("first < last or salt > 0")
    own = checkpointed(own.select("h", "doc", "n"), 500)
    sign = own.groupBy("h").agg(F.count("*").alias("c"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("y"))
    once = sign.groupBy("c", "x", "y").agg(F.min("h").alias("h"), F.count("*").alias("times"))
    lists = checkpointed(own.join(once.select("h", "times", "c"), "h"))
    share = lists.groupBy("doc").agg(F.sum(F.col("times") * F.col("c")).alias("share"))
    lead = lists.join(share, "doc").groupBy("h").agg(F.max(F.struct("share", -F.col("doc"), "n")).alias("best"))
    lead = lead.select("h", (-F.col("best.col2")).alias("lead"), F.col("best.n").alias("lead_n"))
    return checkpointed(lists.drop("c").join(lead, "h"))


def close_sizes(a: str, b: str):
    return 100 * F.least(F.col(a), F.col(b)) >= PERCENT * F.greatest(F.col(a), F.col(b))


def often_enough(a: str, b: str, times: str):
    """T-occurrence in the short lists: what both texts share elsewhere is less than the larger T of the two.

    Up to the smaller end of the two texts' short lists, a shared shingle stands in short lists of both; beyond it,
    one of the texts has fewer than its T shingles left.
    """
    whole = (PERCENT * (F.col(a) + F.col(b)) + 99 + PERCENT).cast("long")
    overlap = F.floor(whole / (100 + PERCENT))
    longer = F.floor((PERCENT * F.greatest(F.col(a), F.col(b)) + 99) / 100)
    return F.col(times) >= overlap - longer + 1


def allowed(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (a, na, b, nb and other columns) whose parities let them reach the similarity; pairs must be checkpointed.

    An id's texts of one size are tried one by one, so a pair may come several times.
    """
    ends = checkpointed(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    own = profiles.filter("slice is null").select("doc_id", "n", "key", "bits").join(maybe_broadcast(ends, ends.count()), "doc_id", "left_semi")
    own = own.groupBy("doc_id", "n", "key").agg(F.first("bits").alias("bits"))
    one, two = (own.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab")
    names = pairs.columns

    def run(batches):
        for b in batches:
            bits = ([np.frombuffer(x, dtype=np.uint8) for x in b.column(k).to_pylist()] for k in ("bitsa", "bitsb"))
            mask = pa.array(map(may_reach, *bits, b.column("na").to_pylist(), b.column("nb").to_pylist()), pa.bool_())
            yield b.select(names).filter(mask)

    return pairs.join(one, ["a", "na"]).join(two, ["b", "nb"]).select(*names, "bitsa", "bitsb").mapInArrow(run, pairs.schema)


def open_postings(lists: DataFrame) -> DataFrame:
    """The postings (h, doc, n, times, comp) of lists that span components, each with its list's length c and its document's block.

    A document goes to the group of its largest list, where those that share passages meet; a group is dealt into as many
    blocks as its shingles fill.
    """
    ends = lists.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c")).filter("low < high").select("h", "c")
    own = checkpointed(lists.join(ends, "h"))
    home = own.groupBy("doc", "n").agg(F.max(F.struct("c", "h")).alias("best")).select("doc", "n", F.col("best.h").alias("home"))
    parts = home.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    block = F.xxhash64("home", F.pmod(F.xxhash64(F.lit("part"), "doc"), F.col("parts")))
    return checkpointed(own.join(home.join(parts, "home").select("doc", block.alias("block")), "doc"))


def paired_meetings(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """meetings() of the pairs that share an open list of up to PAIRED postings.

    The lists that a pair shares there are counted; of longer ones it shares at most as many as either text has.
    """
    short, more = postings.filter(F.col("c") <= PAIRED), postings.filter(F.col("c") > PAIRED).groupBy("doc", "n").agg(F.sum("times").alias("more"))
    one, two = (short.select("h", *(["times"] if k == "a" else []), F.col("doc").alias(k), *[F.col(c).alias(f"{c}{k}") for c in ("n", "comp", "block")]) for k in "ab")
    pairs = one.join(two, "h").filter("a < b and compa != compb").filter(close_sizes("na", "nb"))
    pairs = pairs.groupBy("a", "na", "compa", "blocka", "b", "nb", "compb", "blockb").agg(F.sum("times").alias("c"))
    for k in "ab":
        pairs = pairs.join(more.select(F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("more").alias(f"more{k}")), [k, f"n{k}"], "left")
    most = F.col("c") + F.least(F.coalesce("morea", F.lit(0)), F.coalesce("moreb", F.lit(0)))
    pairs = checkpointed(pairs.withColumn("most", most).filter(often_enough("na", "nb", "most")).select("a", "na", "compa", "blocka", "b", "nb", "compb", "blockb"))
    pairs = checkpointed(allowed(pairs, profiles), 500)
    one, two = (pairs.select(F.col(k).alias("doc"), F.col(f"comp{k}").alias("comp"), F.col(f"block{k}").alias("x"), F.col(f"block{o}").alias("y")) for k, o in ("ab", "ba"))
    return one.union(two).distinct()


def meetings(postings: DataFrame) -> DataFrame:
    """Which documents (doc, comp, x: own block) are to be compared with which blocks (y).

    A document meets a block if, for some class of sizes, its lists with members of that block, that class and other
    components are as many as the texts of that class must share with it in their first lists.
    """
    step = float(np.log(CLASS_STEP))
    wide = int(np.ceil(np.log(100 / PERCENT) / step)) + 1
    own = postings.withColumn("k", F.floor(F.log("n") / step).cast("int"))
    present = own.groupBy("h", F.col("block").alias("y"), F.col("k").alias("j")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    asks = own.withColumn("j", F.explode(F.sequence(F.col("k") - wide, F.col("k") + wide))).join(present, ["h", "j"]).filter("low != comp or high != comp")
    n, share = F.col("n"), PERCENT / 100
    small, large = F.greatest(F.exp(F.col("j") * step) - 1, n * share), F.least(F.exp((F.col("j") + 1) * step) + 1, n / share)
    both = lambda m: share * (n + m) / (1 + share) - share * F.greatest(n, m)
    met = asks.groupBy("doc", "n", "comp", "block", "y", "j").agg(F.sum("times").alias("c")).filter((small <= large) & (F.col("c") >= F.least(both(small), both(large)) - 1))
    return met.select("doc", "comp", F.col("block").alias("x"), "y").distinct()


class Lists:
    """Inverted lists of a block's texts."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        key, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(key, kind="stable")
        self.doc = doc[order]
        self.key, self.start = np.unique(key[order], return_index=True)
        self.length = np.diff(np.append(self.start, len(key)))

    def partners(self, s: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted texts that reach the similarity with the set s.

        The longest lists, fewer than T, are set aside. A partner occurs in so many of the short ones that the long ones can
        make up for the rest; it is then looked up in those.
        """
        n, least = len(s), required(len(s))
        at = np.minimum(np.searchsorted(self.key, s), len(self.key) - 1)
        at = at[self.key[at] == s]
        if len(at) < least or not wanted.any():
            return np.zeros(0, dtype=np.int64)
        at = at[np.argsort(self.length[at], kind="stable")]
        long = min(least - 1, int(least / (PROBE_COST * np.log2(self.length[at[-1]] + 1) + 1)))
        short, rest = at[: len(at) - long], at[len(at) - long :]
        length = self.length[short]
        ends = np.cumsum(length)
        merged = self.doc[np.repeat(self.start[short] - (ends - length), length) + np.arange(ends[-1])]
        times = np.bincount(merged, minlength=len(self.n))
        overlap = -(-PERCENT * (self.n + n) // (100 + PERCENT))
        found = np.flatnonzero(wanted & (times >= np.maximum(overlap - long, 1)) & (overlap <= np.minimum(self.n, n)))
        times = times[found]
        for k in rest if len(found) else ():
            one = self.doc[self.start[k] : self.start[k] + self.length[k]]
            times += one[np.minimum(np.searchsorted(one, found), len(one) - 1)] == found
        return found[times >= overlap[found]]


def links_of_blocks(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], side: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links (a, b) that join the components of two blocks (sides 0 and 1), or of one with itself; a link for each joint."""
    first = np.flatnonzero(side == 0)
    second = first if same else np.flatnonzero(side == 1)
    if not len(first) or not len(second):
        return []
    root = comp.copy()  # the component that each text belongs to by now
    index, out = Lists([sets[i] for i in second]), []
    for q in first.tolist():
        for r in second[index.partners(sets[q], root[second] != root[q])].tolist():
            if root[r] != root[q]:
                out.append((int(ids[q]), int(ids[r])))
                root[root == root[r]] = root[q]
    return out


def blockwise(docs: DataFrame, postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Links (a > b) between texts of different components that share a list, enough of them to join their components.

    Texts that share no short list meet by the long ones alone, those that share one by paired_meetings().
    """
    met = checkpointed(paired_meetings(postings, profiles).union(meetings(postings.filter(F.col("c") > PAIRED))).distinct())
    found = sets_of(docs, checkpointed(met.select(F.col("doc").alias("doc_id")).distinct()))
    sides = met.select("doc", "comp", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("x") > F.col("y")).cast("int").alias("side"))
    cells = sides.join(found, sides["doc"] == found["id"]).select("x", "y", "side", "doc", "comp", "s")

    def run(cell: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, dtype=np.uint64) for s in cell.column("s").to_pylist()]
        same = cell.column("x")[0] == cell.column("y")[0]
        links = links_of_blocks(cell.column("doc").to_numpy(), cell.column("comp").to_numpy(), sets, cell.column("side").to_numpy(), same)
        return pa.table({"a": pa.array([max(x) for x in links], pa.int64()), "b": pa.array([min(x) for x in links], pa.int64())})

    return checkpointed(cells.groupBy("x", "y").applyInArrow(run, "a long, b long"), 200)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and s, the bytes of the set, for every row of docs whose doc_id is among ids (checkpointed)."""

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["id", "s"])

    few = maybe_broadcast(ids, ids.count())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id", "left_semi")
    return checkpointed(texts.mapInArrow(sets, "id long, s binary"), 500).filter("length(s) > 0")


def probe(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose overlap reaches the similarity; pairs must be checkpointed."""
    found = sets_of(docs, checkpointed(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()))

    def count(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                least = -(-PERCENT * (len(x) + len(y)) // (100 + PERCENT))  # T of this pair
                if len(x) < least or not len(x):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(int((y[at] == x).sum()) >= least)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    sa, sb = (found.select(F.col("id").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    return checkpointed(pairs.select("a", "b").join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long"), 200)


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node that it reaches, for every node with a link.

    Alternates large and small stars; the number of rounds grows with the logarithm of a component's size, and no
    round gathers a node's neighbours.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e, state = checkpointed(e), None
    mark = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum((F.xxhash64("v", "u") % 1_000_003)).alias("y")).first()
    while state != (now := mark(e)):
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpointed(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for every row of docs.

    Texts without words, null ones too, have no shingles and link with nothing. A null doc_id links with nothing
    and its component_id is null. Rows that repeat a doc_id are one document, linked where any of its texts is, each
    row with its own n_shingles. An empty table gives no rows; other columns are ignored. Similarities at the
    threshold itself are links.
    """
    profiles = checkpointed(profile(docs), 500)
    own = profiles.filter("slice is null").select("doc_id", F.col("n").alias("n_shingles"), "key")
    texts = own.filter("doc_id is not null and n_shingles > 0")
    least = texts.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("_top")).filter("b < _top")
    copies = checkpointed(texts.join(least, "key").filter("doc_id > b").select(F.col("doc_id").alias("a"), "b").distinct())
    single = texts.groupBy("doc_id").count().filter("count = 1").select("doc_id")  # copies of a set need not be posted again
    again = checkpointed(copies.select(F.col("a").alias("doc_id")).join(single, "doc_id", "left_semi"))
    posted = docs.select("doc_id", "text").join(maybe_broadcast(again, again.count()), "doc_id", "left_anti")
    lists = shared_lists(short_lists(posted, levels(profiles)))
    stars = lists.filter("doc != lead").filter(close_sizes("n", "lead_n")).groupBy(F.col("doc").alias("a"), F.col("lead").alias("b"), "n", "lead_n").agg(F.sum("times").alias("c"))
    stars = checkpointed(stars.filter(often_enough("n", "lead_n", "c")).select("a", F.col("n").alias("na"), "b", F.col("lead_n").alias("nb")))
    stars = checkpointed(allowed(stars, profiles).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 500)
    links = copies.union(probe(docs, stars))
    comp = checkpointed(components(links))
    marked = lists.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("h", "doc", "n", "times", F.coalesce("comp", "doc").alias("comp"))
    comp = components(links.union(blockwise(docs, open_postings(marked), profiles)))
    return own.join(comp, own["doc_id"] == comp["node"], "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id: one document of each group stays.

    Rows without words or id stay all; of rows that repeat an id one stays, that with the smallest text. An empty table
    gives none; other columns stay as they are, whatever their names.
    """
    linked = checkpointed(link_documents(docs))
    gone = checkpointed(linked.filter("component_id < doc_id").select("doc_id").distinct())
    kept = docs.join(maybe_broadcast(gone, gone.count()), "doc_id", "left_anti")
    twice = checkpointed(linked.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if twice.isEmpty():
        return kept.select(*columns)
    many = maybe_broadcast(twice, twice.count())
    one = kept.join(many, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("key")).agg(F.min_by(F.struct(*columns), F.struct(F.col("text").isNull(), "text")).alias("row")).select("row.*")
    return kept.join(many, "doc_id", "left_anti").select(*columns).union(one)


#: The same by brute force over pairs that share a shingle; closure by recursion.
ORACLE_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, b AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""
