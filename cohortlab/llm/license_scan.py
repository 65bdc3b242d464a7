"""License scan by diagonal voting.

Every rolling window of two words of every text is hashed and joined with the
template positions. A match (document, word position, template, template position)
votes for the diagonal ``position - template position``; votes are aggregated per
diagonal, neighbouring diagonals of one template are merged (an inserted or missing
word moves a copy to the next diagonal), and the words of each span left are
compared with the template's words. Two- and three-word phrases are templates whose
only acceptable span is the whole phrase on one diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import LOWER, Hashes, Words, docs_of

# fixed values: phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# fixed values: opening words of well-known license texts and notices, lower case
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
           " documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
              " with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
           " public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that"
           " the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was"
           " not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
           " granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
K = 2
MIN_COVER = 0.9         # share of a template's words that a span must hold for its label
MIN_VOTES = 0.5          # share of a template's windows that a merged span must have got before words are compared
DRIFT = 3                # diagonals this near to each other belong to one copy
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)]] = True   # after lower-casing

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long,"
          " base_labels string, labels string, score double")


def templates() -> list[tuple[str, list[str], bool]]:
    """(label, words, is a phrase); the position in the list is the template's number."""
    return ([(label, phrase.split(), True) for phrase, label in PHRASES.items()]
            + [(label, text.split(), False) for label, text in TEMPLATES.items()])


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    low = LOWER[data]
    w = Words(low, off, BREAKS)
    return w, Hashes(low).of(w.start, w.end)


def template_words() -> list[np.ndarray]:
    out = []
    for _, words, _ in templates():
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        out.append(word_hashes(data, np.array([0, len(data)]))[1])
    return out


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, tpos): a few hundred rows, fixed by the lists above."""
    rows = []
    for t, (_, words, _) in enumerate(templates()):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        w, h = word_hashes(data, np.array([0, len(data)]))
        at, gram = w.grams(h, K)
        rows += [(int(g), t, int(p)) for p, g in zip(at, gram.view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, tpos int")


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every rolling window of K words: (document row, position, hash)."""
    for batch in batches:
        ids = batch.column("_row")
        for i, j, data, off in docs_of(batch):
            w, h = word_hashes(data, off)
            at, gram = w.grams(h, K)
            doc = w.doc[at]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i).take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32)),
                 pa.array(gram.view(np.int64))], ["_row", "pos", "gram"])


def spans(matches: DataFrame) -> DataFrame:
    """Votes per diagonal, neighbouring diagonals merged: (row, template, lo, hi, votes).

    A run of diagonals goes on while the next one is at most DRIFT words away; ``lo`` and
    ``hi`` bound the word positions its votes cover. Phrases stay on one diagonal.
    """
    kinds = templates()
    need = F.create_map(*[F.lit(x) for t, (_, words, phrase) in enumerate(kinds)
                          for x in (t, float(len(words) - 1 if phrase else max(1, MIN_VOTES * (len(words) - 1))))])
    slack = F.when(F.col("template") < len(PHRASES), 0).otherwise(DRIFT)
    votes = (matches.groupBy("_row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
             .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    order = Window.partitionBy("_row", "template").orderBy("diagonal")
    near = votes.withColumn("_new", (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int"))
    run = near.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(order))
    return (run.groupBy("_row", "template", "_run")
            .agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .filter(F.col("votes") >= need[F.col("template")])
            .select("_row", "template", "lo", (F.col("hi") + K).alias("hi"), "votes"))


def cover(text: np.ndarray, template: np.ndarray) -> int:
    """Length of the longest common subsequence of two short word sequences."""
    row = np.zeros(len(template) + 1, np.int64)
    for word in text:
        best = np.maximum(row[1:], row[:-1] + (template == word))
        row[1:] = np.maximum.accumulate(best)
    return int(row[-1])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the words of each span with its template's; one row per document."""
    kinds, words = templates(), template_words()
    for batch in batches:
        ids, found = batch.column("doc_id").cast(pa.int64()), batch.column("spans")
        for i, j, data, off in docs_of(batch):
            w, h = word_hashes(data, off)
            rows = []
            for d in range(j - i):
                own = h[w.first[d]:w.first[d + 1]]
                base, labels, score = [], set(), 0.0
                for s in found[i + d].as_py() or ():
                    label, _, phrase = kinds[s["template"]]
                    t = words[s["template"]]
                    if phrase:
                        if np.array_equal(own[s["lo"]:s["lo"] + len(t)], t):
                            base.append((s["lo"], label))
                            score = 1.0
                    else:
                        # a merged span may hold several copies: look at it in steps of a template's length
                        step = len(t) + DRIFT
                        share = max(cover(own[a:a + 2 * step], t) for a in range(s["lo"], s["hi"], step)) / len(t)
                        score = max(score, share)
                        if share >= MIN_COVER:
                            labels.add(label)
                places, names = [p for p, _ in base], {x for _, x in base}
                rows.append((len(own), len(base), min(places, default=None), max(places, default=None),
                             ",".join(sorted(names)), ",".join(sorted(names | labels)), score))
            cols = list(zip(*rows))
            kind = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), *(pa.array(c, k) for c, k in zip(cols, kind))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def row_key() -> Column:
    """Rows with equal id and text are alike in every respect, so they may share a key."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: words, phrase places, labels and score.

    Null or empty text: no words, no places, empty labels, score 0. Null ids stay null;
    repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    The template table is a few hundred fixed rows, the only side that is broadcast by hint.
    """
    keyed = docs.select("doc_id", "text", row_key().alias("_row"))
    matches = (keyed.select("_row", "text").mapInArrow(grams, "_row long, pos int, gram long")
               .join(F.broadcast(template_grams(docs.sparkSession)), "gram"))
    found = (spans(matches.dropDuplicates(["_row", "template", "tpos", "pos"]))
             .groupBy("_row").agg(F.collect_list(F.struct("template", "lo", "hi")).alias("spans")))
    return keyed.join(found, "_row", "left").select("doc_id", "text", "spans").mapInArrow(verify, SCHEMA)
