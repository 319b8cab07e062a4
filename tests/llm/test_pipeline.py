import sys

from pyspark.sql import functions as F

import corpus_pipeline
from cellarium.llm.common import materialize


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns, counts = now.columns, [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, d), f"test-{name}")
        counts.append(now.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] >= counts[4] > 0
    assert {"sequence_id", "offset", "length"} <= set(now.columns)


def odd_documents(spark, d):
    """Documents of sf0.001 and rows that are hard to handle, with columns named as operators name theirs."""
    base = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "n_chars")
    passage = " ".join(f"passage{i}" for i in range(60))
    item = next(r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").collect() if len((r.text or "").split()) >= 12)
    near = "near " + " ".join(f"word{i}" for i in range(80))
    rows = [(90_001, None), (90_002, ""), (90_003, " \n"), (None, "no id at all"), (None, None), (90_004, "said twice"), (90_004, "said twice"), (90_005, f"one {passage} two"), (90_006, f"three {passage} four"), (90_007, f"it holds {item} whole"), (90_008, near), (90_009, near + " more"), (90_010, "long " * 600_000)]
    odd = base.unionByName(spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], base.schema))
    names = ["score", "predicted", "_key", "th", "n_hit", "contaminated", "sig", "a.b", "_rest", "sequence_id"]
    return odd.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in names))


def test_odd_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = materialize(odd_documents(spark, d), "odd")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, d), f"odd-{name}")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        wrong = out.where("coalesce(doc_id, -1) >= 0").where("score <> concat('score of ', doc_id) or `a.b` <> concat('a.b of ', doc_id) or _rest <> concat('_rest of ', doc_id)")
        assert wrong.count() == 0
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "jaccard_join":
            assert ids.count(90_004) == 1 and (90_008 in ids, 90_009 in ids) == (True, False) and {90_001, 90_002, 90_003, None} <= set(ids)
        if name == "suffix_array_dedup":
            left = {r.doc_id: r.text for r in out.where("doc_id > 90000").collect()}
            assert len(ids) == docs.count() and (left[90_005], left[90_006]) == ("ontwo", "threfour")  # "e " and " " belong to what both have
            assert len(left[90_010]) < 400 and left[90_001] is None
            assert out.where("n_chars <> length(text)").count() == 0
        if name == "decontamination":
            assert 90_007 not in ids and ids.count(90_004) == 2 and {90_001, 90_002, 90_003, 90_010, None} <= set(ids)
    packed = stages["best_fit_packing"](spark, docs, d).collect()
    assert sum(r.doc_id == 90_004 for r in packed) == 2 and sum(r.length for r in packed if r.doc_id == 90_010) >= 600_000 and [r.length for r in packed if r.doc_id in (90_001, 90_002, 90_003)] == [1, 1, 1]


def test_no_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0, name


def test_nothing_outside_imports_llm():
    import subprocess

    code = "import sys; sys.modules['cellarium.llm'] = None; import cellarium.plans.queries, cellarium.sources.store, cellarium.streaming.observe"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(corpus_pipeline.__file__).parent)).returncode == 0
