"""Quality classifier (operator 5): a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles over the features, one feature a tree, so that what they add up to is one
lookup table for each feature; then over chosen pairs of features on coarser bins. A text's score is the
logistic of the sum of its bins' entries, taken for whole batches at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import id_crc, labelled_sample

FEATURES = [
    "log_words", "word_length", "long_words", "symbols", "marks", "exclamations", "bars", "upper", "digits", "beyond_ascii",
    "distinct_words", "top_word", "copied_lines", "compressed", "line_length", "repeats_next",
]
#: Bound on the sample of labelled texts that the model is fitted on.
FIT_ROWS = 15_000
BINS, PAIR_BINS, PAIRS = 48, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 80, 0.1
THRESHOLD = 0.3

_CLASS = np.zeros((256, 8), dtype=np.float64)
for _k, _of in enumerate((b"#*$%&<>", b".,;:?-'\"()", b"!", b"|", bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256)), b" \t\n\x0b\x0c\r")):
    _CLASS[list(_of), _k] = 1
WORDS = re.compile(r"\S+")


def features(text: str | None) -> list[float]:
    """Numbers of a whole text; all 0 for a null text or one without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "replace")
    n, chars = len(words), max(1, len(text))
    symbols, marks, bangs, bars, upper, digits, beyond, space = (np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _CLASS).tolist()
    solid = max(1.0, len(data) - space)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    count = Counter(words)
    most = max(count.values())
    next_same = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), (chars - space) / n, sum(1 for w in count if len(w) > 15) / len(count), symbols / solid, marks / solid, bangs / solid, bars / solid,
        upper / solid, digits / solid, beyond / solid, len(count) / n**0.8, most / n, 1 - len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(data, 1)) / (len(data) + 50), float(np.log1p(chars / max(1, len(lines)))), next_same / n,
    ]


class Gam:
    """Cut points and tables: edges[f], tables[f][bin], and for each pair coarse cut points and a square table."""

    def __init__(self, intercept: float, edges: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int]], squares: list[np.ndarray]):
        self.intercept, self.edges, self.tables, self.coarse, self.pairs, self.squares = intercept, edges, tables, coarse, pairs, squares

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, f], side="right")]
        for (f, g), square in zip(self.pairs, self.squares, strict=True):
            total += square[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, floor: float = 20.0) -> np.ndarray:
    """Newton steps of a tree over ordered bins with sums of gradients g and curvatures h."""
    total = lambda a, b: (a.sum() ** 2) / (b.sum() + 1.0)
    best, at = 0.0, 0
    if depth:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = cg**2 / (ch + 1.0) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1.0) - total(g, h)
        gain[(ch < floor * 0.05) | (h.sum() - ch < floor * 0.05)] = 0
        if len(gain):
            at = int(np.argmax(gain))
            best = gain[at]
    if best <= 1e-6:
        return np.full(len(g), -g.sum() / (h.sum() + 1.0))
    return np.concatenate([_leaves(g[: at + 1], h[: at + 1], depth - 1), _leaves(g[at + 1 :], h[at + 1 :], depth - 1)])


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree that cuts both features of a pair once: its steps, and the gain over no cut."""
    cg, ch = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    best, out = 0.0, np.zeros_like(g)
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0)
    for i in range(1, len(g)):
        for j in range(1, g.shape[1]):
            parts = [(slice(None, i), slice(None, j), cg[i, j], ch[i, j]), (slice(None, i), slice(j, None), cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j])]
            parts += [(slice(i, None), slice(None, j), cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j]), (slice(i, None), slice(j, None), cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j])]
            gain = sum(a * a / (b + 1.0) for *_, a, b in parts) - whole
            if gain > best + 1e-9:
                best, out = gain, np.zeros_like(g)
                for rows, cols, a, b in parts:
                    out[rows, cols] = -a / (b + 1.0)
    return out, best


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    """Boost the main effects in cycles, choose the pairs with the largest gain, boost those in cycles."""
    many = x.shape[1]
    if not len(x) or y.min() == y.max():
        p = (y.sum() + 1.0) / (len(y) + 2.0)
        return Gam(float(np.log(p / (1 - p))), [np.zeros(0)] * many, [np.zeros(1)] * many, [np.zeros(0)] * many, [], [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(many)]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for f in range(many)]
    for f in range(many):  # quantiles miss a rare tail: cut it evenly too
        top = np.linspace(edges[f][-1], x[:, f].max(), 9)[1:-1] if len(edges[f]) and x[:, f].max() > edges[f][-1] else []
        edges[f], coarse[f] = np.unique(np.r_[edges[f], top]), np.unique(np.r_[coarse[f], top[::3]])
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(many)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    p0 = y.mean()
    intercept = float(np.log(p0 / (1 - p0)))
    score = np.full(len(y), intercept)

    def slopes():
        p = 1 / (1 + np.exp(-score))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(many):
            g, h = slopes()
            step = RATE * _leaves(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])), depth=2)
            tables[f] += step
            score += step[bins[f]]
    cells = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(many)]
    sums = lambda f, k, v: np.bincount(cells[f] * (len(coarse[k]) + 1) + cells[k], v, (len(coarse[f]) + 1) * (len(coarse[k]) + 1)).reshape(len(coarse[f]) + 1, -1)
    g, h = slopes()
    gains = {(f, k): _quarters(sums(f, k, g), sums(f, k, h))[1] for f in range(many) for k in range(f + 1, many)}
    pairs = sorted(gains, key=lambda q: (-gains[q], q))[:PAIRS]
    squares = [np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1)) for f, k in pairs]
    for _ in range(PAIR_ROUNDS):
        for q, (f, k) in enumerate(pairs):
            g, h = slopes()
            step = RATE * _quarters(sums(f, k, g), sums(f, k, h))[0]
            squares[q] += step
            score += step[cells[f], cells[k]]
    return Gam(intercept, edges, tables, coarse, pairs, squares)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Gam:
    """Fit on about `rows` labelled texts (crc32 of the id mod 5 not 0); without labels the score is 0.5."""

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column("label")], ["x", "label"])

    got = labelled_sample(docs, labels, "quality", 5, rows).select("text", "label").mapInArrow(run, "x array<double>, label int").collect()
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(-1, len(FEATURES))
    y = np.array([r["label"] for r in got], dtype=np.float64)
    order = np.lexsort([*x.T, y])  # the model must not depend on the order of rows
    return train(x[order], y[order])


def score_documents(docs: DataFrame, model: Gam) -> DataFrame:
    """All columns of docs, gam_score (0 to 1) and gam_predicted (1 if the score reaches THRESHOLD) for every whole text.

    Null and empty texts are scored as texts whose features are all 0. Repeated rows each keep their row; an empty
    table gives none; columns of docs that have these two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("gam_score", "gam_predicted")]

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*names, "gam_score", "gam_predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in names]).schema)
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{schema}, gam_score double, gam_predicted int")


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels outside the held-out rows and score every row: doc_id, held_out, score, predicted."""
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), F.col("gam_score").alias("score"), F.col("gam_predicted").alias("predicted"))
