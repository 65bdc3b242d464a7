import itertools
import zlib

import numpy as np

from cohortlab.llm import quality_crf as q

from .conftest import same

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in q.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
               for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) >= 0.97


def test_edges(edge, nothing, spark):
    labels = spark.createDataFrame([(0, 1, 0), (15, 0, 0), (0, 1, None), (5, None, 1), (None, 1, 0), (777, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = q.classify(edge, labels).collect()
    same([r.doc_id for r in got], [r.doc_id for r in edge.select("doc_id").collect()])
    assert all(0 <= r.score <= 1 for r in got)
    assert q.classify(nothing, labels).collect() == []
    blank = q.classify(edge, labels.limit(0)).collect()
    assert {r.score for r in blank} == {0.5}
    model = q.fit(q.labelled_features(edge, labels))
    out = q.accepted(edge, model)
    assert out.schema == edge.schema
    same([r.doc_id for r in out.collect()], [r.doc_id for r in q.score(edge, model).collect() if r.predicted])


def test_marginals_against_enumeration():
    """Forward-backward on short chains equals the sum over all labellings."""
    rng = np.random.default_rng(3)
    first = np.array([0, 1, 5, 8])
    d, trans = rng.normal(size=8), rng.normal(size=4)
    r, b = q.messages(d, first, trans)
    p = q.sigmoid(r + b)
    for a, e in zip(first[:-1], first[1:]):
        good, total = np.zeros(e - a), 0.0
        for y in itertools.product((0, 1), repeat=e - a):
            w = np.exp(sum(d[a + i] for i, v in enumerate(y) if v) + sum(trans[2 * u + v] for u, v in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        assert np.allclose(p[a:e], good / total)
