import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from cohortlab.llm import quality_crf, queries

from . import brute
from .conftest import rows_of, same


@pytest.fixture(scope="module")
def folder(spark, edge, small, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    extra = edge.select(*small.columns).filter("doc_id is null or doc_id >= 0").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars")
    small.union(extra).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "jaccard_join", "suffix_dedup", "packing"]
    stage = dict(pipeline.STAGES)

    good = pipeline.stored(stage["quality_classifier"](spark, docs, folder), "t1")
    assert good.columns == docs.columns
    predicted = quality_crf.classify(docs, labels)
    same(sorted(str(r.doc_id) for r in good.collect()), sorted(str(r.doc_id) for r in predicted.collect() if r.predicted))
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()} & {r.doc_id for r in good.collect()}
    assert len(bad) <= 1

    ruled = pipeline.stored(stage["quality_rules"](spark, good, folder), "t2")
    assert ruled.columns == docs.columns
    passed = [(i, t) for i, t in rows_of(good) if not brute.rules(t)[5]]
    assert set(rows_of(ruled)) <= set(passed)

    alone = pipeline.stored(stage["jaccard_join"](spark, ruled, folder), "t3")
    assert alone.columns == docs.columns
    of = brute.components(rows_of(ruled))
    want = {i for i, _, c in of if i is not None and i == c}
    got = rows_of(alone)
    same([i for i, _ in got if i is not None], want)
    unnamed = [t for (i, t), (_, _, c) in zip(rows_of(ruled), of) if i is None and c is None]
    same([t for i, t in got if i is None], unnamed)

    cut = pipeline.stored(stage["suffix_dedup"](spark, alone, folder), "t4")
    assert cut.columns == docs.columns
    kept = brute.repeats(got)
    same(rows_of(cut), [(i, kept[i, t][3].decode("utf-8", "ignore") if kept[i, t][1] else t) for i, t in got])

    packed = stage["packing"](spark, cut, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows_of(cut)}


def test_run_equals_the_stages(spark, folder):
    out = pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, folder), f"again-{name}")
    want = pipeline.STAGES[-1][1](spark, docs, folder)
    count = lambda df: sorted((str(r.doc_id), r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert count(out) == count(want)


def test_registered():
    found = entry.queries()
    assert "pipeline" in found
    for n in range(1, 11):
        assert len([q for q in found if q.startswith(f"op{n}_")]) == 1
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
