"""Registered queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

import public_tokenizers

from . import (alignment, bpe, jaccard_join, language_id, license_scan, lm_score, packing, quality_crf, quality_rules, suffix_dedup,
               token_files, topk_search, whitening)
from .tables import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op10_compression_bands")
def op10(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op4_bpe_round_trip")
def op4(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)


@query("op2_license_scan")
def op2(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op9_token_files")
def op9(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op1_topk_search", """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_contains([x IS NULL OR NOT isfinite(x) for x in embedding], true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(coalesce(list_sum([z[1] * z[2] for z in list_zip(q.e, c.e)]), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op1(spark, sf_dir):
    return topk_search.search_table(table(spark, sf_dir, "embeddings"))


@query("op3_jaccard_join", """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)]
             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m
ON n.doc_id = m.a""")
def op3(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op7_quality_crf")
def op7(spark, sf_dir):
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_lm_score")
def op5(spark, sf_dir):
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_alignment")
def op12(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


@query("op13_language_id")
def op13(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"), PIECES)
