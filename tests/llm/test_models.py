import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import ann, common, langid, quality, toxicity

SYLLABLES = {"aa": ["tha", "ing", "ent", "er"], "bb": ["sch", "ung", "ich", "ver"], "cc": ["éau", "que", "oir", "ment"]}


def prose(rnd, lang, n=60):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(n))


def mod(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_languages(documents):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, lang := rnd.choice(list(SYLLABLES))), lang) for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None), (1003, prose(rnd, "bb", 30000), None), (0, rows[0][1], "aa")]
    got = langid.predict_documents(documents(rows).withColumn("nearest", F.lit("x"))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(400) if mod(i, 4) == 2]
    assert all(by[i].held_out == (mod(i, 4) == 2) for i in by)
    assert np.mean([by[i].lang_pred == rows[i][2] for i in held]) > 0.98 and np.mean([by[i].accepted for i in held]) > 0.9
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and by[1003].lang_pred == "bb"
    model = langid.fit(documents(rows))
    strange = langid.identify(documents([(1, "zzxq wwkj jjyy " * 20)]), model).first()
    assert not strange.accepted and strange["lang"] == "und" and strange.nearest in SYLLABLES
    assert langid.predict_documents(documents([])).count() == 0
    assert langid.predict_documents(documents([(1, "text", None)])).first().lang_pred == "und"


def test_idf_counts_all_rows_that_may_be_learned_from(documents):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, lang := "aa" if i % 10 else "bb"), lang) for i in range(300)] + [(300, None, "aa"), (301, "12", "aa"), (302, prose(rnd, "cc"), None)]
    held = sum((langid.counts(t) > 0).astype(int) for _, t, _ in rows[:300])
    assert np.allclose(langid.fit(documents(rows), per_language=20).idf, np.log(301 / (1 + held)) + 1)


def test_held_out_rows_are_not_learned_from(documents):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, "aa"), "aa" if mod(i, 4) != 2 else "wrong") for i in range(80)]
    assert {r.lang_pred for r in langid.predict_documents(documents(rows)).collect()} == {"aa"}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark, documents):
    rnd = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        bad = i % 5 == 0
        t = prose(rnd, "aa", rnd.randint(30, 90))
        t = [t.upper().replace(" ", "!! "), t.replace(" ", "### "), "Und " * 80][i // 5 % 3] if bad else t
        rows.append((i, t))
        marks.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (1002, "w " * 60000), (0, rows[0][1])]
    got = quality.rate_documents(documents(rows), labels(spark, marks + [(None, 1, 0), (5, None, 0)])).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (mod(r.doc_id, 5) == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 5 != 0) for r in held]) > 0.95
    assert quality.rate_documents(documents([]), labels(spark, [])).count() == 0
    assert quality.rate_documents(documents([(1, "a")]), labels(spark, [])).first().score == pytest.approx(0.5)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs
    fresh = rng.random((1000, 3))
    assert np.mean((model.score(fresh) > 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))) > 0.9
    by_hand = model.intercept + sum(t[np.searchsorted(e, fresh[0, f], side="right")] for f, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    by_hand += sum(s[np.searchsorted(model.coarse[f], fresh[0, f], side="right"), np.searchsorted(model.coarse[k], fresh[0, k], side="right")] for (f, k), s in zip(model.pairs, model.squares, strict=True))
    assert model.score(fresh[:1])[0] == pytest.approx(1 / (1 + np.exp(-by_hand)))


def test_matcher():
    m = toxicity.Matcher(["idiot", "clown", "trash", "vequ*"])
    hits = m.hits
    assert hits("You IDIOT!!") == ["idiot"] and hits("1d10t") == ["idiot"] and hits("c1own, cl0wn") == ["clown"] * 2
    assert hits("іdіоt") == ["idiot"] and hits("ïdiót") == ["idiot"] and hits("ｉｄｉｏｔ") == ["idiot"]  # Cyrillic, accents, full width
    assert hits("idioticity trashy") == [] and hits("put it in the trash can") == [] and hits("trash, can") == ["trash"]
    assert hits("vequer xvequ") == ["vequ*"] and hits("") == []
    assert len(toxicity.fold("ßİA1é́")) == 6


def test_matcher_sees_through_disguises():
    hits = toxicity.Matcher(["idiot", "filth"]).hits
    for word in ("𝐢𝐝𝐢𝐨𝐭", "𝕀𝔻𝕀𝕆𝕋", "ⓘⓓⓘⓞⓣ", "🅸🅳🅸🅾🆃", "🇮🇩🇮🇴🇹", "⒤⒟⒤⒪⒯", "ɪᴅɪᴏᴛ", "ᎥᎠᎥᎾᎢ", "i\u0301di\u0308o\u0336t", "i\u200bd\u00adi\u2060ot\ufeff", "id\ufe0fiot", "ŀdiot"):
        assert hits(f"an {word}, he said") == ["idiot"], word
    assert hits("ﬁlth") == ["filth"] and hits("idiot™") == ["idiot"] and hits("x\u200bidiot idiot\u0301s") == []
    assert toxicity.patterns("z\u0301o\u200br") == toxicity.patterns("zor")


def test_toxicity(spark, documents):
    rnd = random.Random(5)
    rows, marks = [], []
    for i in range(800):
        words = prose(rnd, "aa", rnd.randint(20, 80)).split()
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "m0ron", "clown", "zorgle" + rnd.choice(["x", "yy", ""])]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "fine words " * 50000), (1003, "such an idiot"), (0, "other")]
    got = toxicity.rate_documents(documents(rows), labels(spark, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and 0 < r.doc_id < 800]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[1003].predicted == 1 and by[1002].predicted == 0 and by[1000].score == by[1001].score < 0.5
    model = toxicity.fit(documents(rows), labels(spark, marks))
    assert any(w.startswith("zor") for w in model.weights) and model.raw("idiot " + "x " * 50) > model.raw("idiot " + "x " * 5000)
    assert toxicity.rate_documents(documents([]), labels(spark, [])).count() == 0
    assert toxicity.rate_documents(documents([(1, "idiot"), (2, "calm")]), labels(spark, [])).orderBy("doc_id").collect()[1].predicted == 0


def test_texts_of_one_template_each_support_a_word(spark, documents):
    rnd = random.Random(7)
    head = "Reply by a user of the forum on the topic of the day, number: "
    texts = [(head + prose(rnd, "aa", 40) + " zorgle", 1) for _ in range(30)] + [(prose(rnd, "aa", 40), 0) for _ in range(60)]
    copy = prose(rnd, "bb", 40) + " murfle "
    texts += [(copy + prose(rnd, "cc", 1), 1) for _ in range(10)]
    marks = labels(spark, [(i, 1, y) for i, (_, y) in enumerate(texts)])
    words = toxicity.fit(documents([(i, t) for i, (t, _) in enumerate(texts)]), marks).weights
    assert any("zorgie".startswith(w.rstrip("*")) for w in words) and not any("murfie".startswith(w.rstrip("*")) for w in words)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(rows, k=5):
    ok = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v)) and len(v) == 8]
    out = {}
    for q, x in ok:
        if q % 50 == 0:
            near = sorted(((-(x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())), i) for i, y in ok if i != q))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(3000)]
    rows += [(3000 + i, rows[7][1], 0) for i in range(40)] + [(5000, None, 0), (5001, [0.0] * 8, 0), (5050, [float("nan")] * 8, 0), (5002, [1.0] * 7 + [None], 0), (5003, [1.0], 0), (None, [1.0] * 8, 0)]
    df = vectors(spark, rows).withColumn("rank", F.lit(1)).withColumn("score", F.lit(2))
    got = ann.search(df, df.filter("vec_id % 50 = 0"), block_rows=700).collect()
    want = exact(rows)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want) and all([r["rank"] for r in got if r.query_id == q] for q in found)
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.9
    assert [i for i, _ in found[3000]] == [7, 3001, 3002, 3003, 3004]  # ties to the smaller id, itself left out
    for q in found:
        assert [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
        exactly = dict(want[q])
        assert all(s == pytest.approx(exactly[i], abs=1e-12) for i, s in found[q] if i in exactly)


def test_few_vectors(spark):
    df = vectors(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [-1.0, 0.0], 0), (50, [0.0, 1.0], 0)])
    got = ann.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 50), (0, 3, 2), (50, 1, 1), (50, 2, 0), (50, 3, 2)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0 and ann.search(df.limit(1), df.limit(1)).count() == 0


def test_forest_ascends_to_all():
    x = np.random.default_rng(2).standard_normal((50, 4))
    f = ann.Forest(x, trees=3, bits=8)
    assert all(len(c) == 50 for c in f.candidates(x, reach=3.0, least=1))
    assert all(q in c for q, c in enumerate(f.candidates(x, reach=0.0, least=1)))


def test_forest_ascends_bit_by_bit():
    """The ascent ends where a walk up one bit at a time ends, and its candidates are those that share that prefix."""
    x = np.random.default_rng(3).standard_normal((400, 6))
    x[50:90] = x[7]
    f = ann.Forest(x, trees=7, bits=12)
    codes = f.codes(x)
    for reach in (0.05, 0.5, 2.0):
        for q, got in enumerate(f.candidates(x[:40], reach, 2)):
            depth = f.bits
            alike = lambda d: codes >> (f.bits - d) == (codes[:, q] >> (f.bits - d))[:, None]
            while depth and alike(depth).sum() < max(reach * 400, 14):
                depth -= 1
            assert got.tolist() == np.flatnonzero(alike(depth).any(axis=0)).tolist()


def test_forest_is_selective_where_vectors_have_no_structure():
    x = np.random.default_rng(4).standard_normal((6000, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    shares, found = [], []
    for q, rows in enumerate(ann.Forest(x).candidates(x[:30], ann.REACH, 6)):
        near = np.argsort(-(x @ x[q]))[1:6]
        shares.append(len(rows) / len(x)), found.append(np.isin(near, rows).mean())
    assert np.mean(shares) < 0.4 and np.mean(found) >= 0.9


def test_numerals_are_no_letters(documents):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, "aa"), "aa") for i in range(40)] + [(100, "\u00bd \u00b2 \u2168", "aa"), (101, "\u01c5", None)]
    by = {r.doc_id: r.lang_pred for r in langid.predict_documents(documents(rows)).collect()}
    assert by[100] == "und" and by[101] == "aa"


def test_language_score_by_plain_loops(documents):
    """Cosine of TF-IDF vectors to every centroid, n-gram by n-gram."""
    rnd = random.Random(6)
    rows = [(i, prose(rnd, lang := list(SYLLABLES)[i % 3]), lang) for i in range(90)]
    model = langid.fit(documents(rows))
    for _, t, _ in rows[:20]:
        data = b" " + b" ".join(bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in t.lower().encode()).split()) + b" "
        tf = {}
        for n in (2, 3):
            for k in range(len(data) - n + 1):
                x = int.from_bytes(data[k : k + n], "big")
                h = (x * 2654435761 if n == 2 else (x + 1) * 2246822519) % 2**32 >> 20
                tf[h] = tf.get(h, 0) + 1
        v = {h: c**0.5 * model.idf[h] for h, c in tf.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        cosines = [sum(x * float(c[h]) for h, x in v.items()) / size for c in model.centroids]
        best = max(range(len(cosines)), key=lambda j: cosines[j])
        lang, score, _ = model.predict(t)
        assert lang == model.languages[best] and score == pytest.approx(cosines[best], abs=1e-5)


def test_hits_by_plain_search():
    """Every place of every entry, with the exceptions looked at one by one."""
    rnd = random.Random(4)
    entries, pieces = ["trash", "clown", "idiot*"], ["trash", "can", "trash can", "class clown", "clown", "idiots", "tr4sh", " ", ",", "x"]
    m = toxicity.Matcher(entries)
    for _ in range(200):
        text = " ".join(rnd.choices(pieces, k=12))
        low = toxicity.fold(text)
        spots = lambda e, stem: [(k, k + len(e)) for k in range(len(low)) if low.startswith(e, k) and not (k and text[k - 1].isalnum()) and (stem or not text[k + len(e) : k + len(e) + 1].isalnum())]
        spared = [s for e in toxicity.EXCEPTIONS for s in spots(toxicity.fold(e), False)]
        want = [e for e in entries for a, b in spots(toxicity.fold(e.rstrip("*")), e.endswith("*")) if not any(x <= a and b <= y for x, y in spared)]
        assert sorted(m.hits(text)) == sorted(want)


def test_samples_are_bounded_for_any_number_of_rows(spark, documents):
    """Repeated ids are one row of the sample, and clashing columns are left alone."""
    rnd = random.Random(9)
    rows = [(1, prose(rnd, "aa"))] * 500 + [(i, prose(rnd, "aa")) for i in range(2, 40)]
    marks = labels(spark, [(i, i % 2, 0) for i in range(1, 40)])
    sample = common.labelled_sample(documents(rows), marks, "quality", 5, 1000).collect()
    assert len(sample) == len({r.doc_id for r in sample}) == sum(mod(i, 5) != 0 for i in range(1, 40))
    clash = documents(rows[499:]).withColumn("score", F.lit("x")).withColumn("gam_score", F.lit("y")).withColumn("label", F.lit("z")).withColumn("raw", F.lit("w"))
    assert quality.rate_documents(clash, marks).count() == toxicity.rate_documents(clash, marks).count() == 39
