import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quernstone.llm import line_dedup, quality_rules

ODD = [None, "", " \n\t ", "a", "x " * 30000, "\n" * 50, "é" * 5000, "one two three four five six seven eight nine ten eleven", "a b c d e " * 5, "l1 w\nl1 w\n l1 w\nl2", "#*$%&|<> x\n", "\x0bA\x0cB\rC"]


def measures(text):
    """Straight from the definitions."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if again[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(places), len(lines), sum("A" <= c <= "Z" for c in text))


def test_measures(documents):
    rnd = random.Random(1)
    texts = ODD + [" ".join(rnd.choices(["a", "b", "c,", "D\n", "$"], k=rnd.randint(1, 60))) for _ in range(40)]
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)] + [(0, None, None, None)])
    got = quality_rules.rate_documents(docs.withColumn("kept", F.lit(1)).withColumn("_m", F.lit(2)).withColumn("n_words", F.lit(3))).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = measures(texts[r.doc_id])
        assert tuple(r[k] for k in quality_rules.MEASURES) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.rate_documents(documents([])).count() == 0


def text_of(rnd, junk=False):
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(60)]
    return " ".join(w + "***" for w in words) if junk else " ".join(words)


def test_fences_adapt_to_sources(documents):
    """What is common in one source is an outlier in another; small sources lean on their language's fence."""
    rnd = random.Random(2)
    rows = [(i, text_of(rnd), "en", "prose") for i in range(200)] + [(200 + i, text_of(rnd, True), "en", "prose") for i in range(10)]
    rows += [(1000 + i, text_of(rnd, True), "en", "tables") for i in range(100)] + [(2000, text_of(rnd, True), "en", "tiny"), (2001, text_of(rnd), "en", "tiny"), (2002, text_of(rnd), None, None)]
    kept = {r.doc_id: r.kept for r in quality_rules.rate_documents(documents(rows)).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[i] for i in range(200, 210))
    assert all(kept[i] for i in range(1000, 1100)) and kept[2001] and kept[2002]
    clash = documents(rows).withColumn("kept", F.lit("mine")).withColumn("_m", F.lit(1)).withColumn("_lang", F.lit(2)).withColumn("row", F.lit(3)).withColumn("max_upper_ratio", F.lit(4))
    docs = quality_rules.keep_documents(clash)
    assert docs.columns == clash.columns and {r.doc_id for r in docs.collect()} == {k for k, v in kept.items() if v}
    assert [tuple(r) for r in docs.select("kept", "_m", "_lang", "row", "max_upper_ratio").distinct().collect()] == [("mine", 1, 2, 3, 4)]


@pytest.mark.parametrize("junk", [20, 80])
def test_fences_hold_where_a_part_is_junk(documents, junk):
    rnd = random.Random(junk)
    rows = [(i, text_of(rnd, i < junk), "en", "s") for i in range(200)]
    kept = {r.doc_id: r.kept for r in quality_rules.rate_documents(documents(rows)).collect()}
    assert not any(kept[i] for i in range(junk)) and all(kept[i] for i in range(junk, 200))


def passage_rows(sizes, copies=6):
    """Passages of over 50 words in so many lines, in texts of their own words."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=6))
    rows = []
    for n in sizes:
        passage = [" ".join(word() for _ in range(60 // n + 1)) for _ in range(n)]
        for _ in range(copies):
            own = lambda: [" ".join(word() for _ in range(20)) for _ in range(3)]
            rows.append((len(rows), "\n".join([*own(), *passage, *own()]), passage))
    return rows


def test_repeated_passages_of_few_lines_are_found(documents):
    rows = passage_rows([1] * 10 + [2] * 40 + [3] * 40 + [5] * 20)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents([r[:2] for r in rows])).collect()}
    touched = defaultdict(list)
    for i, _, passage in rows:
        if i % 6:
            touched[len(passage)].append(not all(x in got[i] for x in passage))
    share = {n: sum(x) / len(x) for n, x in touched.items()}
    assert share[1] == 1 and share[2] > 0.85 and share[3] > 0.93 and share[5] > 0.97


def test_plans_have_no_python(documents):
    docs = documents([(1, "a\nb", "en", "s")])
    for df in (quality_rules.rate_documents(docs), line_dedup.dedup_lines(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def chunks(text):
    """start, stop and text of the chunks of every bit, each span once."""
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:13], 16) for x in lines]
    rolled = [((h[i - 1] if i else 0) & ((1 << 51) - 1)) << 1 ^ (h[i - 1] if i else 0) >> 51 ^ h[i] for i in range(len(lines))]
    spans = {(i, i) for i, x in enumerate(lines) if len(x) > 100}
    for bit in line_dedup.BITS:
        for i in range(len(lines) - 1):
            j = i + 1
            while j < i + 6 and j < len(lines) - 1 and not (rolled[j] >> bit & 3 and lines[j].strip(" ")):
                j += 1
            spans.add((i, j))
    out = []
    for a, z in spans:
        c = "\n".join(lines[a : z + 1])
        several = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in lines[a : z + 1]) > 1
        if several or (len(c) > 100 and len(re.split(r"[\x20\x09-\x0D]+", c)) > 50):
            out.append((a, z, c))
    return out


def dedup(rows):
    """First places by order of id and place, then all later ones cut."""
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for a, _, c in sorted(chunks(t)):
            first.setdefault(c, (i, a))
    for i, t in rows:
        gone = {k for a, z, c in chunks(t) if first[c] != (i, a) for k in range(a, z + 1)}
        out[i] = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
    return out


def test_lines_against_one_pass(documents):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choices("abcdefghij", k=rnd.choice([2, 5, 60]))) for _ in range(25)] + ["", " "]
    passage = [f"shared line {i}" for i in range(6)]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 12)) + (passage if i % 3 == 0 else []) + rnd.choices(pool, k=3))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n".join(passage)), (103, rows[0][1]), (104, "x" * 200_000 + "\n" + "y" * 200_000)]
    docs = documents(rows).withColumn("removed_lines", F.lit("mine")).withColumn("place", F.lit(1)).withColumn("_gone", F.lit(0)).withColumn("_h", F.lit(1)).withColumn("row", F.lit(2)).withColumn("own", F.lit(3)).withColumn("id", F.lit(4))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    want = dedup(rows)
    assert len(got) == len(rows) and got[100].text is None
    assert {i: r.text or "" for i, r in got.items()} == want
    assert all(r._gone == 0 and r._h == 1 and r.row == 2 and r.own == 3 and r.id == 4 for r in got.values())
    left = sum((r.text or "").count("shared line") for i, r in got.items() if i < 60)
    assert left < 0.15 * 20 * len(passage)  # boundaries don't depend on what stands around the passage
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_repeated_rows_are_cut_alike(documents):
    t = "\n".join(f"line {i} of a text" for i in range(30))
    got = line_dedup.dedup_documents(documents([(1, t), (1, t), (2, t), (None, t)])).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    assert by[1][0] == by[1][1] and len(by[1][0]) < len(t) and by[None] == [t]
    assert all(r.n_chars in (None, len(r.text)) for r in got)


@pytest.mark.parametrize("text", ["", "a", "a\nb\nc", "\n\n", "x\n" * 40, "w " * 60])
def test_chunks_are_spans_of_the_text(documents, text):
    got = [tuple(c) for c in line_dedup.chunked(documents([(1, text)])).first()["_chunks"]]
    assert sorted(got) == sorted(chunks(text))
    assert all("\n".join(text.split("\n")[a : z + 1]) == c for a, z, c in got)


def test_the_first_place_of_every_line_stays(documents):
    rnd = random.Random(6)
    rows = [(i, "\n".join(rnd.choices([f"line {k} here" for k in range(6)], k=20))) for i in range(10)]
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert {x for t in got.values() for x in t if x} == {x for _, t in rows for x in t.split("\n")}
