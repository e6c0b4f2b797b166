import random
from collections import defaultdict

from pyspark.sql import types as T

import corpus_pipeline
from quernstone.llm import bpe, jaccard
from quernstone.llm.queries import ORACLE_SQL, QUERIES, vocabulary


def corpus(spark, path, documents):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices(["tha", "ing", "er", "on", "ed"], k=rnd.randint(1, 3)))
    good = [(i, "\n".join(" ".join(word() for _ in range(20)) for _ in range(rnd.randint(1, 6)))) for i in range(150)]
    junk = [(1000 + i, "### ".join(word() for _ in range(60))) for i in range(20)]
    copies = [(2000 + i, good[i][1]) for i in range(10)] + [(2100 + i, good[i][1].replace("\n", " ")) for i in range(10)]
    rows = [(i, t, "en", "s", len(t)) for i, t in good + junk + copies] + [(3000, None, None, None, None), (3001, "", "en", "s", 0)]
    documents(rows).write.parquet(f"{path}/documents.parquet")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + junk], schema).write.parquet(f"{path}/labels.parquet")
    return {i: t for i, t in good}


def test_pipeline(spark, tmp_path, documents):
    good = corpus(spark, str(tmp_path), documents)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if k == 3:  # a stage is judged on its own input: line dedup has cut repeated passages out of copies
            linked = jaccard.link_documents(docs).collect()
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == columns, name
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            left = {r.doc_id: r.text for r in docs.collect()}
            if k < 2:
                assert not set(left) & set(range(1000, 1020)) and len(set(left) & set(good)) >= 145
            if k == 3:
                assert set(left) == {r.component_id for r in linked} and len(left) < len(linked)
    want = defaultdict(int)
    for i, t in left.items():
        want[i] = len(bpe.loaded(vocabulary()).encode(t)) + 1
    got = defaultdict(int)
    for r in docs.collect():
        got[r.doc_id] += r.length
    assert got == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_every_operator_has_its_query():
    assert [f"op{n}_" for n in range(1, 11)] == [f"{q.split('_')[0]}_" for q in QUERIES]
    assert set(ORACLE_SQL) <= set(QUERIES) and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
