"""Language identification by nearest centroids (operator 2).

A text is a unit vector of hashed TF-IDF byte n-grams of its lower-cased letters. Each language has several
centroids from spherical k-means; the nearest by cosine names the language. A text further from its centroid
than the language's own fit texts are, by a margin, is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import SAMPLE_PARTS, id_crc

DIM = 4096
CENTROIDS = 4
#: Bound on the sample that the model is fitted on: about so many texts of each language.
FIT_PER_LANGUAGE = 300
#: A text is rejected beyond so many times its centroid's radius.
MARGIN = 1.25

LETTER = regex.compile(r"\p{L}")
_ONLY_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(text: str, dim: int = DIM) -> np.ndarray:
    """Dampened counts of the hashed 2- and 3-grams of the letters; all 0 without letters."""
    data = b" ".join(text.lower().encode("utf-8", "replace").translate(_ONLY_LETTERS).split())
    a = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint32)
    two = (a[:-1] << np.uint32(8)) | a[1:]
    three = (two[:-1] << np.uint32(8)) | a[2:]
    at = np.concatenate([two * np.uint32(2654435761), (three + np.uint32(1)) * np.uint32(2246822519)]) >> np.uint32(32 - dim.bit_length() + 1)
    return np.sqrt(np.bincount(at, minlength=dim)[:dim])


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows from far-apart rows; centroids and each one's largest distance."""
    centre = unit(x.mean(axis=0))[None, :]
    start = [int(np.argmax(x @ centre[0]))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(axis=1))))
    centre = x[start]
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        centre = unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else centre[j] for j in range(len(centre))]))
    near = x @ centre.T
    own = np.argmax(near, axis=1)
    radius = np.array([1 - near[own == j, j].min() if (own == j).any() else 0.0 for j in range(len(centre))])
    return centre, radius


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, radius: np.ndarray):
        self.languages, self.idf, self.centroids, self.radius = languages, idf, centroids, radius

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The nearest centroid's language, the cosine to it, and whether it is near enough."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, False
        v = unit(counts(text, len(self.idf)) * self.idf).astype(np.float32)
        near = self.centroids @ v
        j = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[j])))
        return self.languages[j], score, 1 - score <= MARGIN * self.radius[j]


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF of the hashed n-grams over all texts with a letter; the driver gets one count for each place of DIM."""

    def run(batches):
        n, held = 0, np.zeros(DIM, dtype=np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                if t and LETTER.search(t):
                    n += 1
                    held += counts(t) > 0
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *held[at].tolist()], pa.int64())], ["place", "n"])

    found = docs.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total, held = 0, np.zeros(DIM)
    for r in found:
        if r["place"] < 0:
            total = r["n"]
        else:
            held[r["place"]] = r["n"]
    return np.log((1 + total) / (1 + held)) + 1


def fit(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> Model:
    """Fit on a bounded sample: about per_language rows of each value of lang, chosen by a hash of doc_id.

    IDF is counted over all rows. Rows with a null lang or without a letter are not learned from, and of rows that
    repeat an id the sample takes one, that with the smallest lang and text.
    """
    rows = docs.filter(F.col("lang").isNotNull())
    numbers = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not numbers:
        return Model([], np.ones(DIM), np.zeros((0, DIM)), np.zeros(0))
    idf = inverse_frequencies(rows)
    share = F.create_map(*[F.lit(x) for lang, n in numbers.items() for x in (lang, SAMPLE_PARTS * per_language // n + 1)])
    rows = rows.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PARTS)) < share[F.col("lang")]))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.lang", "r.text")

    def run(batches):
        for b in batches:
            lang, text = b.column("lang").to_pylist(), b.column("text").to_pylist()
            keep = [(x, counts(t).astype(np.float32).tobytes()) for x, t in zip(lang, text, strict=True) if t and LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.string()), pa.array([v for _, v in keep], pa.binary())], ["lang", "v"])

    got = rows.select("lang", "text").mapInArrow(run, "lang string, v binary").collect()
    if not got:
        return Model([], np.ones(DIM), np.zeros((0, DIM)), np.zeros(0))
    x = np.stack([np.frombuffer(r["v"], dtype=np.float32) for r in got]).astype(np.float64)
    langs = np.array([r["lang"] for r in got])
    order = np.lexsort([x.sum(axis=1), langs])
    x, langs = x[order], langs[order]
    x = unit(x * idf)
    names, centres, radii = [], [], []
    for lang in sorted(set(langs.tolist())):
        c, r = cluster(x[langs == lang], CENTROIDS)
        names += [lang] * len(c)
        centres.append(c), radii.append(r)
    return Model(names, idf, np.concatenate(centres).astype(np.float32), np.concatenate(radii))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang (`und` if rejected), nearest, score (cosine, 0 to 1) and accepted for every text.

    Null texts and those without a letter are `und` with score 0 and not accepted; whole texts count however
    long. Equal cosines go to the first language by name. Repeated rows each give a row, an empty table none;
    other columns are ignored.
    """

    def run(batches):
        for b in batches:
            out = [model.predict(t) for t in b.column("text").to_pylist()]
            near, score, ok = zip(*out, strict=True) if out else ((), (), ())
            lang = [x if a else "und" for x, a in zip(near, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(near, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], ["doc_id", "lang", "nearest", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang string, nearest string, score double, accepted boolean")


def predict_documents(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32 of the id mod 4 is not 2 and predict every row: doc_id, held_out, lang_pred, score, accepted."""
    model = fit(docs.filter(id_crc() % 4 != 2))
    return identify(docs, model).select("doc_id", (id_crc() % 4 == 2).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "accepted")
