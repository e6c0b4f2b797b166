"""Best-fit packing with Martello-Toth dominance reduction (operator 3).

Lengths are at most the sequence size, so all that packing needs from a corpus is one count for each length:
a bounded table, whatever the corpus holds. The reduction fixes sets of one to three documents that dominate
every other set with the same longest document; best fit places the rest, whole groups of equal bins at a
time. The plan says which ranks of each length go to which bins; documents then find their places alone.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bpe import table
from quernstone.llm.common import RANK_BUCKET_ROWS, checkpointed, gapless_rank

SEQUENCE = 2048
END_ID = 0


@dataclass
class Bins:
    """Equal bins: how many there are and which lengths each of them holds."""

    number: int
    items: list[tuple[int, int]] = field(default_factory=list)  # (length, how many)


def _best_pair(lengths: list[int], have: dict[int, int], room: int) -> tuple[int, int] | None:
    """Two lengths at hand, the larger first, with the largest sum up to room."""
    best, i, j = None, 0, len(lengths) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if a + b > room or not have[b]:
            j -= 1
        else:
            if have[a] > (a == b) and (best is None or a + b > sum(best)):
                best = (b, a)
            i += 1
    return best


def dominating(left: dict[int, int], n: int, size: int) -> dict[int, int] | None:
    """The set with the length n that dominates all others with it, or None if none is known.

    At most k further lengths fit beside n. For k of 0 or 1, or a perfect fit, the largest that fits dominates.
    For k of 2 it does so if no pair sums to more; else the best pair does, if it has that largest length and no
    two lengths above its smaller one fit together.
    """
    have = {x: c - (x == n) for x, c in left.items()}
    lengths = sorted(x for x, c in have.items() if c)
    room, k, used = size - n, 0, 0
    for x in lengths:
        fits = min(have[x], (room - used) // x)
        k, used = k + fits, used + fits * x
        if fits < have[x] or k > 2:
            break
    if k == 0:
        return {n: 1}
    mate = lengths[bisect_right(lengths, room) - 1]
    if k > 2 and mate != room:
        return None
    others: tuple[int, ...] = (mate,)
    if k == 2 and mate != room and (pair := _best_pair(lengths, have, room)) and sum(pair) > mate:
        above = [x for x in lengths if x > pair[1]]
        two = [x for x in above[:2] for _ in range(min(have[x], 2))][:2]
        if pair[0] != mate or len(two) == 2 and sum(two) <= room:
            return None
        others = pair
    take = {n: 1}
    for x in others:
        take[x] = take.get(x, 0) + 1
    return take


def reduce(counts: dict[int, int], size: int) -> tuple[list[Bins], dict[int, int]]:
    """Fix every set that dominates: the bins so fixed, and the counts that remain.

    A set that dominates goes on doing so while it can be taken, as the alternatives only become fewer.
    """
    left, fixed, changed = {n: c for n, c in counts.items() if c > 0}, [], True
    while changed:
        changed = False
        for n in sorted(left, reverse=True):
            while n in left and (take := dominating(left, n, size)):
                times = min(left[x] // k for x, k in take.items())
                for x, k in take.items():
                    left[x] -= k * times
                    if not left[x]:
                        del left[x]
                fixed.append(Bins(times, sorted(take.items(), reverse=True)))
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], size: int) -> list[Bins]:
    """Best-fit decreasing over counts: equal bins are filled together."""
    closed: list[Bins] = []
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(b: Bins, room: int) -> None:
        if room == 0:
            closed.append(b)
        elif room in by_room:
            by_room[room].append(b)
        else:
            by_room[room] = [b]
            insort(rooms, room)

    for n in sorted(counts, reverse=True):
        rest = counts[n]
        while rest:
            k = bisect_left(rooms, n)
            if k == len(rooms):  # open new bins: as many as take all the rest
                each = size // n
                number, over = divmod(rest, each)
                if number:
                    put(Bins(number, [(n, each)]), size - n * each)
                if over:
                    put(Bins(1, [(n, over)]), size - n * over)
                break
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
            each = min(room // n, rest)
            number = min(b.number, rest // each)
            if number < b.number:
                put(Bins(b.number - number, list(b.items)), room)
            put(Bins(number, [*b.items, (n, each)]), room - n * each)
            rest -= number * each
    return closed + [b for bins in by_room.values() for b in bins]


def plan(counts: dict[int, int], size: int) -> list[Bins]:
    fixed, rest = reduce(counts, size)
    return fixed + best_fit(rest, size)


def segments(bins: list[Bins]) -> dict[int, np.ndarray]:
    """For each length, in the order of ranks: first rank, first bin, how many in each bin, offset in the bin."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for b in bins:
        offset = 0
        for n, k in b.items:
            out.setdefault(n, []).append((used.get(n, 0), first, k, offset))
            used[n] = used.get(n, 0) + k * b.number
            offset += n * k
        first += b.number
    return {n: np.array(x, dtype=np.int64) for n, x in out.items()}


def tokenised_pieces(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """Pieces of each document's ids and a last END_ID: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        ids_of, end = table(path), np.array([END_ID], dtype=np.uint32)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, own in enumerate(ids_of.batches(b.column("text"))):
                ids = np.concatenate([own, end]).astype("<u4")
                for p, s in enumerate(range(0, len(ids), size)):
                    part = ids[s : s + size]
                    at.append(k), piece.append(p), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces with a length from 1 to size; pieces must be checkpointed.

    Only counts of lengths reach the driver: at most `size` rows.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = segments(plan(counts, size))
    buckets = max(1, ceil(sum(counts.values()) / RANK_BUCKET_ROWS))
    bucket = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], bucket, buckets, "rank")

    def run(batches):
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for x in np.unique(n):
                mine, table = np.flatnonzero(n == x), places[int(x)]
                s = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                q = rank[mine] - s[:, 0]
                seq[mine], offset[mine] = s[:, 1] + q // s[:, 2], s[:, 3] + (q % s[:, 2]) * x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """Pack all documents into as few sequences of at most `size` tokens as best fit finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, a row for each piece. Null and empty
    texts are one token, the end id. Repeated rows are packed each; ties in length are dealt by doc_id. An empty
    table gives no rows. Other columns of docs are ignored.
    """
    return pack_pieces(checkpointed(tokenised_pieces(docs, path, size), 1000), size)
