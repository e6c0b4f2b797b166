"""Merkle commitments over snapshots: sparse Merkle tree (SMT) and Merkle Patricia trie (MPT).

A root depends on the set of entries only. Entries are dealt by a prefix of their path; each part folds to one
small summary, and summaries fold further until one is left, so no task holds more than a part. Hashes of one
height are taken together. Fixed by the formats: SMT leaf 01|key hash|value, SMT inner 00|left|right, a lone
leaf standing at any depth, empty 32 zero bytes; MPT nodes 01 leaf, 02 extension, 03 branch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.errors import TrieError
from quernstone.functions.keccak import keccak256, keccak256_column, keccak256_many
from quernstone.sources.files import cut

EMPTY = bytes(32)
#: The one node of the proof in an empty Merkle Patricia trie.
EMPTY_NODE = b"\x00"
#: Entries that one part holds on average.
PART_ROWS = 50_000
MAX_KEY = 1024


# -- sparse Merkle tree ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class SmtProof:
    """key_hash, the leaf where the path ends (key hash and value) or None, and the siblings from the root down."""

    key_hash: bytes
    leaf: tuple[bytes, bytes] | None
    siblings: tuple[bytes, ...]

    @property
    def value(self) -> bytes | None:
        return self.leaf[1] if self.leaf and self.leaf[0] == self.key_hash else None


def _bit(path: bytes, i: int) -> int:
    return path[i >> 3] >> (7 - (i & 7)) & 1


def _fold(hashes: list[tuple[bytes, bytes]], depth: int) -> bytes:
    """Hash at `depth` of the subtree of sorted (path, leaf hash) pairs that share their first `depth` bits.

    All subtrees are laid out first, then hashed from the deepest level up, a whole level at a time.
    """
    if not hashes:
        return EMPTY
    if len(hashes) == 1:
        return hashes[0][1]
    paths = [p for p, _ in hashes]
    done: dict[tuple[int, int, int], bytes] = {}
    levels: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    todo = [(0, len(hashes), depth)]
    while todo:
        low, high, d = todo.pop()
        levels[d].append((low, high, _cut(paths, low, high, d)))
        mid = levels[d][-1][2]
        for a, b in ((low, mid), (mid, high)):
            if b - a > 1:
                todo.append((a, b, d + 1))
    of = lambda a, b, d: EMPTY if a == b else hashes[a][1] if b - a == 1 else done[a, b, d]
    for d in sorted(levels, reverse=True):
        nodes = levels[d]
        made = keccak256_many([b"\x00" + of(low, mid, d + 1) + of(mid, high, d + 1) for low, high, mid in nodes])
        done.update({(low, high, d): h for (low, high, _), h in zip(nodes, made, strict=True)})
    return done[0, len(hashes), depth]


def _cut(paths: list[bytes], low: int, high: int, d: int) -> int:
    """The first place whose path has bit d set."""
    while low < high:
        mid = (low + high) // 2
        if _bit(paths[mid], d):
            high = mid
        else:
            low = mid + 1
    return low


def smt_leaves(df: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """path (hash of the key), leaf (its hash) and value of unique entries."""
    path = df.select(keccak256_column(F.col(key)).alias("path"), F.col(value).alias("value"))
    return path.withColumn("leaf", keccak256_column(F.concat(F.lit(b"\x01"), "path", "value")))


def part_bytes(rows: int, part_rows: int = PART_ROWS) -> int:
    """Bytes of prefix that deal the rows into parts of about part_rows."""
    out = 0
    while rows > part_rows * 256**out:
        out += 1
    return out


def smt_parts(leaves: DataFrame, prefix: int) -> DataFrame:
    """prefix, n, path and hash of each part: a part of one leaf keeps its path, as it may stand higher up."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(map(bytes, pdf["path"]), map(bytes, pdf["leaf"]), strict=True))
        return pd.DataFrame([(rows[0][0][:prefix], len(rows), rows[0][0], _fold(rows, 8 * prefix))], columns=["prefix", "n", "path", "hash"])

    return leaves.select(F.substring("path", 1, prefix).alias("prefix"), "path", "leaf").groupBy("prefix").applyInPandas(run, "prefix binary, n long, path binary, hash binary")


def _fold_parts(rows: list[tuple[bytes, int, bytes, bytes]], depth: int, bottom: int) -> tuple[int, bytes, bytes]:
    """n, a path and the hash at `depth` of sorted parts that stand at `bottom` bits; a level is hashed at once."""
    if not rows:
        return 0, b"", EMPTY
    here = [(int.from_bytes(path, "big") >> (256 - bottom), n, path, h) for _, n, path, h in rows]
    for _ in range(bottom - depth):
        pairs: dict[int, list] = defaultdict(lambda: [None, None])
        for place, n, path, h in here:
            pairs[place >> 1][place & 1] = (n, path, h)
        alone = {p: kids[0] or kids[1] for p, kids in pairs.items() if sum(k[0] for k in kids if k) == 1}
        inner = [p for p in pairs if p not in alone]
        made = keccak256_many([b"\x00" + b"".join(k[2] if k else EMPTY for k in pairs[p]) for p in inner])
        done = {p: (sum(k[0] for k in pairs[p] if k), (pairs[p][0] or pairs[p][1])[1], h) for p, h in zip(inner, made, strict=True)}
        here = [(p, *x) for p, x in sorted({**alone, **done}.items())]
    return here[0][1:]


def smt_fold_up(parts: DataFrame, prefix: int) -> DataFrame:
    """Parts of one byte of prefix less."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((bytes(r.prefix), r.n, bytes(r.path), bytes(r.hash)) for r in pdf.itertuples())
        n, path, h = _fold_parts(rows, 8 * prefix - 8, 8 * prefix)
        return pd.DataFrame([(rows[0][0][: prefix - 1], n, path, h)], columns=["prefix", "n", "path", "hash"])

    return parts.withColumn("_up", F.substring("prefix", 1, prefix - 1)).groupBy("_up").applyInPandas(lambda pdf: run(pdf), "prefix binary, n long, path binary, hash binary")


def smt_root_of_parts(parts: DataFrame, prefix: int) -> bytes:
    while prefix > 0:
        parts, prefix = smt_fold_up(parts, prefix), prefix - 1
    row = parts.first()
    return bytes(row["hash"]) if row else EMPTY


def smt_root(df: DataFrame, key: str = "k", value: str = "v", part_rows: int = PART_ROWS) -> bytes:
    """Root of unique binary entries; 32 zero bytes for none."""
    prefix = part_bytes(df.count(), part_rows)
    return smt_root_of_parts(smt_parts(smt_leaves(df, key, value), prefix), prefix)


def smt_prove(df: DataFrame, wanted: bytes, key: str = "k", value: str = "v", part_rows: int = PART_ROWS) -> SmtProof:
    """Proof that a key is in the entries with its value, or is not in them."""
    prefix = part_bytes(df.count(), part_rows)
    leaves, path = smt_leaves(df, key, value), keccak256(wanted)
    own = sorted((bytes(r["path"]), bytes(r["leaf"]), bytes(r["value"])) for r in leaves.filter(F.substring("path", 1, prefix) == F.lit(path[:prefix])).collect())
    siblings: list[bytes] = []
    parts, rows, stop = smt_parts(leaves, prefix), None, False
    levels = []
    for p in range(prefix, 0, -1):  # the part beside the path on each byte of prefix
        near = parts.filter(F.substring("prefix", 1, p - 1) == F.lit(path[: p - 1])).collect()
        levels.append((p, sorted((bytes(r["prefix"]), r["n"], bytes(r["path"]), bytes(r["hash"])) for r in near)))
        parts = smt_fold_up(parts, p)
    for p, rows in reversed(levels):
        for d in range(8 * p - 8, 8 * p):
            if sum(r[1] for r in rows) <= 1:
                stop = True
                break
            mid = _cut([r[2] for r in rows], 0, len(rows), d)
            left, right = rows[:mid], rows[mid:]
            rows, other = (right, left) if _bit(path, d) else (left, right)
            siblings.append(_fold_parts(other, d + 1, 8 * p)[2])
        if stop:
            leaf = None
            if rows:
                hit = leaves.filter(F.col("path") == F.lit(rows[0][2])).first()
                leaf = (bytes(hit["path"]), bytes(hit["value"]))
            return SmtProof(path, leaf, tuple(siblings))
    d, here = 8 * prefix, own
    while len(here) > 1:
        mid = _cut([r[0] for r in here], 0, len(here), d)
        left, right = here[:mid], here[mid:]
        here, other = (right, left) if _bit(path, d) else (left, right)
        siblings.append(_fold([(r[0], r[1]) for r in other], d + 1))
        d += 1
    return SmtProof(path, (here[0][0], here[0][2]) if here else None, tuple(siblings))


def smt_verify(root: bytes, key: bytes, proof: SmtProof) -> bool:
    """Whether the proof holds for a key under a root; too many siblings are an error."""
    if keccak256(key) != proof.key_hash:
        return False
    if len(proof.siblings) > 256:
        raise TrieError("a proof has at most 256 siblings")
    if proof.leaf is None:
        h = EMPTY
    else:
        path, value = proof.leaf
        if any(_bit(path, i) != _bit(proof.key_hash, i) for i in range(len(proof.siblings))):
            return False
        h = keccak256(b"\x01" + path + value)
    for d in range(len(proof.siblings) - 1, -1, -1):
        s = proof.siblings[d]
        left, right = (s, h) if _bit(proof.key_hash, d) else (h, s)
        h = EMPTY if left == right == EMPTY else keccak256(b"\x00" + left + right)
    return h == root


# -- Merkle Patricia trie ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class MptProof:
    key: bytes
    value: bytes | None
    nodes: tuple[bytes, ...]


def _varint(n: int) -> bytes:
    out = b""
    while n >= 0x80:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def nibbles(key: bytes) -> bytes:
    return bytes(x for b in key for x in (b >> 4, b & 15))


def _packed(path: bytes) -> bytes:
    even = path + b"\x00" if len(path) % 2 else path
    return _varint(len(path)) + bytes(even[i] << 4 | even[i + 1] for i in range(0, len(even), 2))


def mpt_leaf(path: bytes, value: bytes) -> bytes:
    return b"\x01" + _packed(path) + _varint(len(value)) + value


def mpt_extension(path: bytes, child: bytes) -> bytes:
    return b"\x02" + _packed(path) + child


def mpt_branch(children: dict[int, bytes], value: bytes | None) -> bytes:
    bitmap = sum(1 << n for n in children).to_bytes(2, "little")
    return b"\x03" + bitmap + (b"\x00" if value is None else b"\x01" + _varint(len(value)) + value) + b"".join(children[n] for n in sorted(children))


#: What a subtree comes to, before the path above it is known: (path, value of a leaf or None, hash of a branch or None).
Summary = tuple[bytes, bytes | None, bytes | None]


def _encoded(s: Summary) -> bytes | None:
    """The node that stands for a summary; None if it is a bare branch, whose hash is known."""
    path, value, branch = s
    return mpt_leaf(path, value) if value is not None else mpt_extension(path, branch) if path else None


def _hashes(summaries: list[Summary]) -> list[bytes]:
    made = [_encoded(s) for s in summaries]
    digests = iter(keccak256_many([m for m in made if m is not None]))
    return [s[2] if m is None else next(digests) for s, m in zip(summaries, made, strict=True)]


def mpt_join(children: dict[int, Summary], value: bytes | None) -> Summary | None:
    """The summary of a place with a value and children by nibble: paths are compressed."""
    if not children:
        return None if value is None else (b"", value, None)
    if len(children) == 1 and value is None:
        n, (path, v, branch) = next(iter(children.items()))
        return bytes([n]) + path, v, branch
    order = sorted(children)
    return b"", None, keccak256(mpt_branch(dict(zip(order, _hashes([children[n] for n in order]), strict=True)), value))


def mpt_summary(items: list[tuple[bytes, bytes]], depth: int) -> Summary | None:
    """Summary at `depth` nibbles of sorted (nibble path, value) pairs with that much in common.

    Branches are laid out first and hashed from the deepest up, a level at a time.
    """
    if not items:
        return None
    paths = [p for p, _ in items]
    levels: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def stop(low: int, high: int, d: int) -> int:
        """Where the common path of a stretch of several items ends."""
        a, b = paths[low], paths[high - 1]
        while d < len(a) and a[d] == b[d]:
            d += 1
        return d

    def split(low: int, high: int, d: int) -> tuple[bytes | None, dict[int, tuple[int, int]]]:
        value = items[low][1] if len(paths[low]) == d else None
        at, out = low + (value is not None), {}
        while at < high:
            n = paths[at][d]
            end = bisect_left(paths, paths[at][:d] + bytes([n + 1]), at, high)
            out[n], at = (at, end), end
        return value, out

    todo = [(0, len(items), depth)]
    while todo:
        low, high, d = todo.pop()
        if high - low > 1:
            e = stop(low, high, d)
            levels[e].append((low, high))
            todo += [(a, b, e + 1) for a, b in split(low, high, e)[1].values()]
    done: dict[tuple[int, int], tuple[int, bytes]] = {}

    def summary(low: int, high: int, d: int) -> Summary:
        if high - low == 1:
            return paths[low][d:], items[low][1], None
        e, h = done[low, high]
        return paths[low][d:e], None, h

    for e in sorted(levels, reverse=True):
        parts = [(low, high, *split(low, high, e)) for low, high in levels[e]]
        flat = iter(_hashes([summary(a, b, e + 1) for *_, kids in parts for a, b in kids.values()]))
        made = keccak256_many([mpt_branch({n: next(flat) for n in kids}, value) for _, _, value, kids in parts])
        done.update({(low, high): (e, h) for (low, high, *_), h in zip(parts, made, strict=True)})
    return summary(0, len(items), depth)


def _root(s: Summary | None) -> bytes:
    return EMPTY if s is None else _hashes([s])[0]


#: Most nibbles of prefix that parts are dealt by, and how far a part may exceed the average before more are taken.
MAX_PREFIX, UNEVEN = 24, 4


@dataclass(frozen=True)
class MptLayout:
    """What all keys begin with (nibbles), and how many nibbles after it deal the entries into parts."""

    common: bytes
    prefix: int


def mpt_layout(df: DataFrame, key: str = "k", part_rows: int = PART_ROWS) -> MptLayout:
    """As many nibbles as keep every part within bounds; keys over MAX_KEY bytes are refused."""
    row = df.agg(F.count("*").alias("n"), F.max(F.octet_length(key)).alias("most"), F.min(F.hex(key)).alias("low"), F.max(F.hex(key)).alias("high")).first()
    if (row["most"] or 0) > MAX_KEY:
        raise TrieError(f"a key has more than {MAX_KEY} bytes")
    if not row["n"]:
        return MptLayout(b"", 0)
    n = next((i for i, (a, b) in enumerate(zip(row["low"], row["high"], strict=False)) if a != b), min(len(row["low"]), len(row["high"])))
    prefix = 0
    while row["n"] > part_rows * 16**prefix:
        prefix += 1
    while 0 < prefix < MAX_PREFIX:
        largest = df.groupBy(F.substring(F.hex(key), n + 1, prefix)).count().agg(F.max("count")).first()[0]
        if largest <= UNEVEN * part_rows:
            break
        prefix += 1
    return MptLayout(bytes(int(c, 16) for c in row["low"][:n]), prefix)


_PART = "prefix binary, path binary, value binary, branch binary"


def mpt_parts(df: DataFrame, layout: MptLayout, key: str = "k", value: str = "v") -> DataFrame:
    """Summaries by the first nibbles after the common ones; shorter keys are kept as they are."""
    skip, prefix = len(layout.common), layout.prefix

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = sorted((nibbles(bytes(k))[skip:], bytes(v)) for k, v in zip(pdf["k"], pdf["v"], strict=True))
        head = items[0][0][:prefix]
        if len(items[0][0]) < prefix:
            return pd.DataFrame([(head, b"", items[0][1], None)], columns=["prefix", "path", "value", "branch"])
        return pd.DataFrame([(head, *mpt_summary(items, prefix))], columns=["prefix", "path", "value", "branch"])

    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"))
    return rows.groupBy(F.substring(F.hex("k"), skip + 1, prefix).alias("_p")).applyInPandas(run, _PART)


def _part(row) -> tuple[bytes, Summary]:
    some = lambda x: None if x is None else bytes(x)
    return bytes(row.prefix), (bytes(row.path), some(row.value), some(row.branch))


def _fold_summaries(rows: dict[bytes, Summary], top: int, down: int) -> dict[bytes, Summary]:
    """Summaries that stand at `top` nibbles, or at the end of a shorter key, folded to `down` nibbles."""
    for d in range(top - 1, down - 1, -1):
        children: dict[bytes, dict[int, Summary]] = defaultdict(dict)
        for p in [p for p in rows if len(p) == d + 1]:
            children[p[:d]][p[d]] = rows.pop(p)
        for p, kids in children.items():
            own = rows.pop(p, None)
            rows[p] = mpt_join(kids, own[1] if own else None)
    return rows


def mpt_fold(parts: DataFrame, top: int, down: int) -> DataFrame:
    """Parts of `down` nibbles of prefix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _fold_summaries(dict(_part(r) for r in pdf.itertuples()), top, down)
        return pd.DataFrame([(p, *s) for p, s in rows.items()], columns=["prefix", "path", "value", "branch"])

    return parts.groupBy(F.substring("prefix", 1, down).alias("_p")).applyInPandas(lambda pdf: run(pdf), _PART)


#: Nibbles that are folded in one step: at most 16^4 summaries meet in a task.
STEP = 4


def _folded(parts: DataFrame, top: int, down: int) -> DataFrame:
    while top > down:
        parts, top = mpt_fold(parts, top, max(down, top - STEP)), max(down, top - STEP)
    return parts


def mpt_root(df: DataFrame, key: str = "k", value: str = "v", part_rows: int = PART_ROWS) -> bytes:
    """Root of unique binary entries; 32 zero bytes for none."""
    layout = mpt_layout(df, key, part_rows)
    row = _folded(mpt_parts(df, layout, key, value), layout.prefix, 0).first()
    if row is None:
        return EMPTY
    path, leaf, branch = _part(row)[1]
    return _root((layout.common + path, leaf, branch))


def mpt_prove(df: DataFrame, wanted: bytes, key: str = "k", value: str = "v", part_rows: int = PART_ROWS) -> MptProof:
    """The nodes on the path of a key from the root down, and its value or None.

    On each nibble of prefix the parts beside the path are summaries; below it the key's own part is read.
    """
    layout = mpt_layout(df, key, part_rows)
    skip, prefix, path = len(layout.common), layout.prefix, nibbles(wanted)
    inside = path[:skip] == layout.common
    levels: dict[int, tuple[dict[int, Summary], bytes | None]] = {}
    parts = mpt_parts(df, layout, key, value)
    for p in range(prefix, 0, -1):
        near = [_part(r) for r in parts.filter(F.substring("prefix", 1, p - 1) == F.lit(path[skip : skip + p - 1])).collect()] if inside or p == 1 else []
        levels[p - 1] = {h[-1]: s for h, s in near if len(h) == p}, next((s[1] for h, s in near if len(h) == p - 1), None)
        parts = mpt_fold(parts, p, p - 1)
    mine = df.filter(F.substring(F.hex(key), skip + 1, prefix) == F.lit(path.hex()[1::2].upper()[skip : skip + prefix])) if prefix else df
    items = sorted((nibbles(bytes(r[key])), bytes(r[value])) for r in mine.select(key, value).collect()) if inside or not prefix else []

    def at(d: int) -> tuple[dict[int, Summary], bytes | None]:
        """Children and value at the key's own place of depth d."""
        if d - skip < prefix:
            return levels.get(d - skip, ({}, None))
        here = [x for x in items if x[0][:d] == path[:d]] if d > skip else items
        children = {n: mpt_summary([x for x in here if len(x[0]) > d and x[0][d] == n], d + 1) for n in sorted({x[0][d] for x in here if len(x[0]) > d})}
        return children, next((v for p, v in here if len(p) == d), None)

    nodes: list[bytes] = []
    d = 0
    whole = mpt_join(*at(skip))
    if whole is None:
        return MptProof(wanted, None, (EMPTY_NODE,))
    if whole is not None:
        whole = (layout.common + whole[0], *whole[1:])
    while whole is not None:
        over, leaf, branch = whole
        if leaf is not None:
            nodes.append(mpt_leaf(over, leaf))
            return MptProof(wanted, leaf if path[d:] == over else None, tuple(nodes))
        if over:
            nodes.append(mpt_extension(over, branch))
            if path[d : d + len(over)] != over:
                return MptProof(wanted, None, tuple(nodes))
            d += len(over)
        children, own = at(d)
        order = sorted(children)
        nodes.append(mpt_branch(dict(zip(order, _hashes([children[n] for n in order]), strict=True)), own))
        if d == len(path):
            return MptProof(wanted, own, tuple(nodes))
        whole, d = children.get(path[d]), d + 1
    return MptProof(wanted, None, tuple(nodes))


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = out = 0
    while True:
        if at >= len(data) or shift > 63:
            raise TrieError("a node is cut short")
        out |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 0x80:
            return out, at


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise TrieError("a node is cut short")
    return data[at : at + n], at + n


def mpt_decode(node: bytes) -> tuple:
    """('leaf', path, value), ('extension', path, child) or ('branch', children, value)."""
    kind = node[:1]
    if kind in (b"\x01", b"\x02"):
        n, at = _read_varint(node, 1)
        packed, at = _take(node, at, (n + 1) // 2)
        path = nibbles(packed)
        if n % 2 and path[-1]:
            raise TrieError("a path has a padding that is not zero")
        if kind == b"\x01":
            size, at = _read_varint(node, at)
            out, at = _take(node, at, size)
        else:
            out, at = _take(node, at, 32)
        found: tuple = ("leaf" if kind == b"\x01" else "extension", path[:n], out)
    elif kind == b"\x03":
        bits, at = _take(node, 1, 2)
        flag, at = _take(node, at, 1)
        value = None
        if flag == b"\x01":
            size, at = _read_varint(node, at)
            value, at = _take(node, at, size)
        elif flag != b"\x00":
            raise TrieError("a branch has an unknown flag")
        children = {}
        for n in range(16):
            if int.from_bytes(bits, "little") >> n & 1:
                children[n], at = _take(node, at, 32)
        found = ("branch", children, value)
    elif kind == EMPTY_NODE:
        found, at = ("empty",), 1
    else:
        raise TrieError("a node is of no known kind")
    if at != len(node):
        raise TrieError("a node has bytes left over")
    return found


def mpt_verify(root: bytes, proof: MptProof) -> bool:
    """Whether the proof holds under a root, for a value or for its absence."""
    path, expect = nibbles(proof.key), root
    if proof.nodes == (EMPTY_NODE,):
        return root == EMPTY and proof.value is None
    if not proof.nodes:
        return False
    for i, node in enumerate(proof.nodes):
        last = i == len(proof.nodes) - 1
        if keccak256(node) != expect:
            return False
        try:
            kind, a, b = (*mpt_decode(node), None, None)[:3]
        except TrieError:
            return False
        if kind == "empty":
            return False
        if kind == "leaf":
            return last and (b if a == path else None) == proof.value
        if kind == "extension":
            if path[: len(a)] != a:
                return last and proof.value is None
            path, expect = path[len(a) :], b
        else:
            if not path:
                return last and b == proof.value
            if path[0] not in a:
                return last and proof.value is None
            path, expect = path[1:], a[path[0]]
    return False


# -- calculators and incremental roots ---------------------------------------------------------------------

class TrieCalculator:
    """A set of entries with its root: kind `smt` or `mpt`. Writes of a batch are checked before any takes effect."""

    def __init__(self, df: DataFrame, kind: str = "smt", part_rows: int = PART_ROWS):
        if kind not in ("smt", "mpt"):
            raise TrieError("a trie is smt or mpt")
        self.df, self.kind, self.part_rows = df.select("k", "v"), kind, part_rows
        self._parts: DataFrame | None = None
        self._prefix, self._root = 0, None

    def get(self, key: bytes) -> bytes | None:
        row = self.df.filter(F.col("k") == F.lit(key)).first()
        return bytes(row["v"]) if row else None

    def batch_update(self, ops: DataFrame) -> None:
        """Apply (k, v) in which a null v removes; keys are unique. Of an SMT only touched parts are hashed again."""
        if self.kind == "mpt":
            mpt_layout(ops)
        self.df = cut(self.df.join(ops.select("k"), "k", "left_anti").unionByName(ops.filter("v is not null").select("k", "v")))
        self._root = None
        if self._parts is not None:
            touched = ops.select(F.substring(keccak256_column("k"), 1, self._prefix).alias("prefix")).distinct()
            leaves = smt_leaves(self.df).withColumn("prefix", F.substring("path", 1, self._prefix))
            again = smt_parts(leaves.join(touched, "prefix", "left_semi").drop("prefix"), self._prefix)
            self._parts = cut(self._parts.join(touched, "prefix", "left_anti").unionByName(again))

    def insert(self, key: bytes, value: bytes) -> None:
        self.batch_update(self.df.sparkSession.createDataFrame([(key, value)], "k binary, v binary"))

    def remove(self, key: bytes) -> None:
        self.batch_update(self.df.sparkSession.createDataFrame([(key, None)], "k binary, v binary"))

    def root_hash(self) -> bytes:
        if self._root is None and self.kind == "mpt":
            self._root = mpt_root(self.df, part_rows=self.part_rows)
        elif self._root is None:
            if self._parts is None:
                self._prefix = part_bytes(self.df.count(), self.part_rows)
                self._parts = cut(smt_parts(smt_leaves(self.df), self._prefix))
            self._root = smt_root_of_parts(self._parts, self._prefix)
        return self._root

    def _mark(self) -> tuple[int, int, int]:
        """Tells sets of entries apart: their number and two sums of hashes."""
        one, two = F.xxhash64("k", "v"), F.xxhash64("v", "k")
        return tuple(self.df.agg(F.count("*"), F.coalesce(F.bit_xor(one), F.lit(0)), F.coalesce(F.bit_xor(two), F.lit(0))).first())

    def prove(self, key: bytes):
        return (mpt_prove if self.kind == "mpt" else smt_prove)(self.df, key, part_rows=self.part_rows)

    def verify(self, root: bytes, key: bytes, proof) -> bool:
        if self.kind == "mpt":
            return proof.key == key and mpt_verify(root, proof)
        return smt_verify(root, key, proof)

    def save_cache(self, path: str, sync_tag: int) -> None:
        """Write the parts' hashes (of an MPT the root and a mark of the entries); a cache may be lost at any time."""
        root = self.root_hash()
        if self.kind == "mpt":
            row = (sync_tag, bytearray(root), *self._mark())
            self.df.sparkSession.createDataFrame([row], "tag long, root binary, n long, x long, y long").write.mode("overwrite").parquet(path)
        else:
            self._parts.withColumns({"tag": F.lit(sync_tag), "root": F.lit(root), "width": F.lit(self._prefix)}).write.mode("overwrite").parquet(path)

    def load_cache(self, path: str) -> int | None:
        """Take the parts of a cache whose hashes fold to its root (of an MPT: the root, if the entries are the same); its tag, or None."""
        try:
            saved = self.df.sparkSession.read.parquet(path)
            head = saved.first()
        except Exception:  # noqa: BLE001  a missing or broken cache only means that hashes are taken again
            return None
        if self.kind == "mpt":
            if head is None or "x" not in saved.columns or (head["n"], head["x"], head["y"]) != self._mark():
                return None
            self._root = bytes(head["root"])
            return head["tag"]
        if "prefix" not in saved.columns:
            return None
        parts = saved.select("prefix", "n", "path", "hash")
        if head is None or smt_root_of_parts(parts, head["width"]) != bytes(head["root"]):
            return None
        self._parts, self._prefix = parts, head["width"]
        return head["tag"]
