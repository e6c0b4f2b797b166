"""Toxicity by a weighted lexicon (operator 10).

Texts are folded letter by letter (case, accents, homoglyphs, digit and symbol substitutions), matched with an
Aho-Corasick automaton, cleared of hits inside exception phrases, and the weights' sum is normalised by length.
Weights and the score's calibration are learned from labels.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, id_crc, labelled_sample

#: Common English insults; their weights are learned.
LEXICON = [
    "stupid", "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "loser", "losers", "pathetic", "scum", "worthless",
    "trash", "clown", "disgusting", "dumb", "dumbass", "fool", "foolish", "jerk", "imbecile", "cretin", "bastard", "bitch",
    "asshole", "retard", "freak", "garbage", "vermin", "filth", "pig", "shit", "fuck", "fucking", "crap", "hate", "ugly",
]
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "clown fish", "class clown", "guinea pig", "pig iron", "garbage collector", "garbage collection", "garbage can", "food for fool", "sore loser bracket", "hate crime", "control freak"]
#: Letters of other scripts, digits and signs that stand for Latin letters. i, l, 1, ! and | count as one letter.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "i", "ø": "o", "đ": "d",
    "ꭺ": "a", "ᏼ": "b", "ꮟ": "b", "ꮯ": "c", "ꭰ": "d", "ꮷ": "d", "ꭼ": "e", "ꮐ": "g", "ꮋ": "h", "ꮒ": "h", "ꭵ": "i", "ꭻ": "j", "ꮶ": "k", "ꮮ": "i",
    "ꮇ": "m", "ꮎ": "o", "ꮲ": "p", "ꭱ": "r", "ꮢ": "r", "ꮪ": "s", "ꭲ": "t", "ꮜ": "u", "ꮩ": "v", "ꮃ": "w", "ꮤ": "w", "ꭹ": "y", "ꮍ": "y", "ꮓ": "z",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e",
}
#: Bound on the sample of labelled texts that weights and calibration are fitted on.
FIT_ROWS = 12_000
#: A word or stem of the sample joins the lexicon with so large a part of the toxic texts and so large log odds.
MIN_SHARE, MIN_ODDS = 0.02, 3.0
#: Letters of the stems looked at. A stem is written with a star and matches words that begin with it.
STEMS = (4, 5, 6)

WORD = re.compile(r"[^\W_]+")


#: Most code points that stand for Latin letters or modify them lie below this; beyond are ideographs, tags and selectors.
_END = 0x20000
#: Names of letters that Unicode does not decompose: negative circled and squared ones, small capitals, strokes and hooks.
_NAMED = re.compile(r"(?:NEGATIVE |CROSSED )?(?:CIRCLED |SQUARED )?LATIN (?:CAPITAL |SMALL |LETTER )*([A-Z])(?: WITH .*)?|REGIONAL INDICATOR SYMBOL LETTER ([A-Z])")


def _latin(cp: int) -> str:
    """The Latin letter or digit that a code point stands for, lower case, by its compatibility form or its name; or none."""
    form = unicodedata.normalize("NFKD", chr(cp)).lstrip("(").lower()
    if form[:1].isascii() and (form[:1].isalpha() or (form.isdigit() and len(form) == 1)):
        return form[:1]
    m = _NAMED.fullmatch(unicodedata.name(chr(cp), ""))
    return (m[1] or m[2]).lower() if m else ""


def fold_table() -> dict[int, str]:
    """One letter for one letter: lower case without marks, then lookalikes, then l as i."""
    out: dict[int, str] = {}
    near = {*range(0x21, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)}
    for cp in range(0x21, _END):
        low = chr(cp).lower()
        base = unicodedata.normalize("NFKD", chr(cp))[:1].lower() if cp in near else _latin(cp) or (low if low in LOOKALIKES else "")
        base = LOOKALIKES.get(low, LOOKALIKES.get(base, base))
        if cp in near and not base.isascii():
            base = _latin(cp) or base
        base = "i" if base == "l" else base
        if len(base) == 1 and base != chr(cp):
            out[cp] = base
    return out


def bare_table() -> dict[int, str | None]:
    """Combining and format characters are dropped, ligatures become their letters."""
    out: dict[int, str | None] = {}
    for cp in [*range(0x80, _END), *range(0xE0000, 0xE0200)]:
        c = chr(cp)
        kind, name = unicodedata.category(c), unicodedata.name(c, "")
        if kind == "Cf" or (kind in ("Mn", "Me") and name.startswith(("COMBINING", "VARIATION SELECTOR"))):
            out[cp] = None
        elif c.isalpha():
            form = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(form) > 1 and form.isascii() and form.isalpha():
                out[cp] = form
    return out


_FOLD, _BARE = fold_table(), bare_table()


def bare(text: str) -> str:
    """The text without what can stand unseen inside a word."""
    return text if text.isascii() else text.translate(_BARE)


def fold(text: str) -> str:
    return text.translate(_FOLD)


class Matcher:
    """Folded words of a lexicon, whole or by their stem, except inside exception phrases."""

    def __init__(self, entries, exceptions=EXCEPTIONS):
        known: dict[str, tuple[str, str]] = {}
        for e in sorted(entries):
            known.setdefault(fold(e.rstrip("*")), (e, "stem" if e.endswith("*") else "word"))
        for e in exceptions:
            known[fold(e)] = (fold(e), "spare")
        self.automaton = ahocorasick.Automaton()
        for text, (entry, kind) in known.items():
            self.automaton.add_word(text, (len(text), entry, kind))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[str]:
        text = bare(text)
        found, spared = [], []
        for end, (length, entry, kind) in self.automaton.iter(fold(text)):
            start = end - length + 1
            if (start and text[start - 1].isalnum()) or (kind != "stem" and end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            (spared if kind == "spare" else found).append((start, end, entry))
        spared.sort()
        starts, reach = [a for a, _, _ in spared], list(accumulate((b for _, b, _ in spared), max))
        inside = lambda s, e: (k := bisect_right(starts, s)) and reach[k - 1] >= e
        return [w for s, e, w in found if not inside(s, e)]


def patterns(text: str) -> set[str]:
    """The words and stems of a text that may join a lexicon."""
    words = {w for w in WORD.findall(fold(bare(text))) if len(w) > 2}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def sketch(text: str) -> int:
    """The least hash of the text's runs of three words: near copies agree in it, texts that share a template hardly."""
    words = WORD.findall(fold(bare(text)))
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return min(zlib.crc32(r.encode("utf-8", "replace")) for r in runs) >> 1


def choose(seen: list[tuple[str, float]], base: set[str]) -> dict[str, float]:
    """Weights of a lexicon without repetition: no stems of base words, nothing that begins with a stem as telling."""
    out: dict[str, float] = {}
    for entry, odds in sorted(seen, key=lambda x: (x[0] not in base, len(x[0].rstrip("*")), x[0])):
        bare = entry.rstrip("*")
        if entry in base:
            out[entry] = max(0.0, odds)
        elif not (entry.endswith("*") and any(w.startswith(bare) for w in base)):
            if not any(out.get(bare[:k] + "*", -9.0) >= odds - 0.7 for k in STEMS if k < len(bare) or not entry.endswith("*")):
                out[entry] = odds
    return out


class Model:
    def __init__(self, weights: dict[str, float], slope: float, intercept: float):
        self.weights, self.slope, self.intercept = weights, slope, intercept
        self._matcher: Matcher | None = None

    def __getstate__(self):
        return {**self.__dict__, "_matcher": None}

    def raw(self, text: str | None) -> float:
        """The hits' weights, divided by a dampened length; of more and more hits each adds less."""
        if not text:
            return 0.0
        if self._matcher is None:
            self._matcher = Matcher(self.weights)
        total = sum(self.weights[w] for w in self._matcher.hits(text))
        return float(np.log1p(total / (1 + np.log1p((text.count(" ") + text.count("\n") + 1) / 1000)))) if total else 0.0

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.raw(text) + self.intercept))))


def calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps, with a light ridge."""
    slope, intercept = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + intercept, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([np.sum((p - label) * raw) + 1e-2 * slope, np.sum(p - label) + 1e-2 * intercept])
        h = np.array([[np.sum(w * raw * raw) + 1e-2, np.sum(w * raw)], [np.sum(w * raw), np.sum(w) + 1e-2]])
        step = np.linalg.solve(h, g)
        slope, intercept = slope - float(np.clip(step[0], -1, 1)), intercept - float(np.clip(step[1], -1, 1))
    return max(slope, 0.0), intercept


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn weights and calibration from about `rows` labelled texts (crc32 of the id mod 5 not 0).

    A word joins the lexicon only with a fixed share of the sample's toxic texts, so its size is bounded by the sample.
    A new word needs support from texts of different sketches, so that copies of one text don't add words.
    Without labels all words weigh the same and the score stays below 0.5 without hits.
    """
    sample = checkpointed(labelled_sample(docs, labels, "toxic", 5, rows).filter(F.col("text").isNotNull()))

    def words(batches):
        for b in batches:
            token, key, clean = [], [], Counter()
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                if y:
                    own = patterns(t)
                    token += own
                    key += [sketch(t)] * len(own)
                else:
                    clean.update(patterns(t))
            names = [*token, *clean]
            toxic = [1] * len(token) + [0] * len(clean)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int64()), pa.array([0] * len(token) + list(clean.values()), pa.int64()), pa.array(key + [-1] * len(clean), pa.int32())], ["entry", "t", "c", "key"])

    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    base = {fold(w) for w in LEXICON}
    weights = {w: 3.0 for w in base}
    if toxic and clean:
        odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
        seen = (
            sample.select("text", "label").mapInArrow(words, "entry string, t long, c long, key int")
            .groupBy("entry", "key").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
            .groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("key") >= 0).cast("long")).alias("d"))
            .withColumn("odds", odds)
            .filter((F.col("entry").isin(sorted(base)) & (F.col("t") + F.col("c") >= 3)) | ((F.col("d") >= max(5, MIN_SHARE * toxic)) & (F.col("odds") >= MIN_ODDS)))
            .orderBy(F.desc("odds"), "entry").collect()
        )
        weights |= choose([(r["entry"], r["odds"]) for r in seen], base)
    model = Model({w: x for w, x in weights.items() if x > 0}, 1.0, -1.0)

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.raw(t) for t in b.column("text").to_pylist()], pa.float64()), b.column("label")], ["raw", "label"])

    got = sample.select("text", "label").mapInArrow(raw, "raw double, label int").collect() if toxic and clean else []
    if got:
        model.slope, model.intercept = calibrate(np.array([r["raw"] for r in got]), np.array([r["label"] for r in got], dtype=float))
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, raw, score (0 to 1) and predicted (score >= 0.5) for every whole text.

    Null and empty texts have raw 0 and the score of a text without hits. Repeated rows each give a row, an empty
    table none; other columns are ignored. Equal texts have equal scores, and a score of 0.5 itself counts as toxic.
    """

    def run(batches):
        for b in batches:
            raw = np.array([model.raw(t) for t in b.column("text").to_pylist()], dtype=np.float64)
            score = 1 / (1 + np.exp(-np.clip(model.slope * raw + model.intercept, -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "raw", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, raw double, score double, predicted int")


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels outside the held-out rows and score every row: doc_id, held_out, score, predicted, raw."""
    return score_documents(docs, fit(docs, labels)).select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", "predicted", "raw")
