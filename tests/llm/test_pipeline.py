"""The pipeline's stages, each against a plain version on what the stage before it kept."""

import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from skein.llm import secret_scan, toxicity
from skein.llm.queries import fold

from .test_operators import BYTE_BPE, check_packing, groups, plain_ids

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    outs = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        outs.append(docs)
    before = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet").filter(fold("doc_id", 3) != 1))
    scores = {r.doc_id: r.predicted for r in toxicity.score(before, model).collect()}
    kept = [r.doc_id for r in outs[0].collect()]
    assert sorted(kept) == sorted(d for d, p in scores.items() if p == 0)

    rows = outs[0].orderBy("doc_id").collect()
    want = [r.doc_id for r, g in zip(rows, groups([r.text for r in rows], 5, 80), strict=True) if g[2]]
    assert [r.doc_id for r in outs[1].orderBy("doc_id").collect()] == want

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sure, possible = set().union(*(runs(w, 13) for w in items)), set().union(*(runs(w, 4) for w in items))
    left = {r.doc_id for r in outs[2].collect()}
    for r in outs[1].collect():
        if runs(words(r.text), 13) & sure:
            assert r.doc_id not in left
        if not runs(words(r.text), 4) & possible:
            assert r.doc_id in left

    clean = {r.doc_id: r for r in outs[3].collect()}
    for r in outs[2].collect():
        spans = secret_scan.scan(r.text)[1]
        assert (clean[r.doc_id].text == r.text) == (not spans) and not secret_scan.find(clean[r.doc_id].text)
        assert clean[r.doc_id].n_chars == len(clean[r.doc_id].text)
    assert set(clean) == left

    order = sorted(clean)
    ids = [np.append(x, 0) for x in plain_ids(BYTE_BPE, [clean[d].text for d in order])]
    place = F.create_map(*[F.lit(x) for pair in zip(order, range(len(order)), strict=True) for x in pair])
    assert check_packing(outs[4].withColumn("doc_id", place[F.col("doc_id")]).collect(), ids, 1024) == 0
    assert corpus_pipeline.run(spark, SF).count() == outs[4].count()


def test_stages_on_empty_and_odd_documents(spark, tmp_path):
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("packed", F.lit("x"))
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{len(rows)}-{i}"
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if i < 4:
                assert docs.count() == len(rows)


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, None, None)]
    names = ["found", "of", "__of", "_key", "Found", "h", "d", "seed", "key", "stays", "component"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1L AS n_chars", *(f"lang AS {n}" for n in names if n != "Found"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert sorted(map(str, out.select("found", "_key").collect())) == sorted(map(str, out.select("lang", "lang").toDF("found", "_key").collect()))
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert sorted((r.doc_id is None, r.found) for r in docs.collect()) == [(False, "x"), (True, None)]


def test_registered_queries():
    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
