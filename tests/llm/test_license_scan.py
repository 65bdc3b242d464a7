from cohortlab.llm import license_scan as s

from . import brute
from .conftest import rows_of, same


def test_phrases_against_brute_force(edge, small, nothing):
    for df in (edge, small):
        got = s.license_scan(df).collect()
        same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got],
             [(i, *brute.licenses(t)) for i, t in rows_of(df)])
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert s.license_scan(nothing).collect() == []


def test_templates_with_edits(spark):
    isc = s.TEMPLATES["isc"]
    words = isc.split()
    edited = words[:10] + ["hereinafter"] + words[10:20] + words[21:]      # one word more, one less: three diagonals
    rows = [(1, "Intro text. " + isc + " the end"), (2, "x " * 30 + " ".join(edited)), (3, " ".join(words[:12])), (4, " ".join(sorted(words))),
            (5, "Licensed under CC BY-NC 4.0."), (6, (isc + " unrelated words between the copies ") * 3)]
    got = {r.doc_id: r for r in s.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "isc" and got[1].score == 1.0
    assert got[2].labels == "isc" and 0.85 <= got[2].score < 1
    assert got[3].labels == "" and got[4].labels == ""
    assert got[5].labels == "cc-by-nc" and got[6].labels == "isc"
    assert all(0 <= r.score <= 1 for r in got.values())
