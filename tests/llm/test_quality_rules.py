import random

from cohortlab.llm import quality_rules as q

from . import brute
from .conftest import rows_of, same


def base(df):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            for r in q.quality_rules(df).collect()]


def test_counts_against_brute_force(edge, small):
    for df in (edge, small):
        same(base(df), [(i, *brute.rules(t)) for i, t in rows_of(df)])


def test_verdict(spark, edge, nothing):
    got = q.quality_rules(edge).collect()
    assert all(not r.kept for r in got if r.base_failed)
    assert q.quality_rules(nothing).collect() == []
    rnd = random.Random(1)
    prose = " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(400))
    cycle = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz") + " "
    noise = "".join(chr(33 + (i * i * 31 + i * 17) % 90) + (" " if i % 5 == 4 else "") for i in range(400))
    rows = {r.doc_id: r for r in q.quality_rules(spark.createDataFrame([(1, prose), (2, cycle * 40), (3, noise)], "doc_id long, text string")).collect()}
    assert rows[1].kept and not rows[2].kept
    assert rows[2].ratio > rows[1].ratio > 1


def test_bands():
    assert q.verdict(1000, 2.0, 0.0) and not q.verdict(1000, 9.0, 0.0) and not q.verdict(1000, 1.0, 0.0)
    assert q.verdict(100_000, 9.0, 0.0) and not q.verdict(100_000, 2.5, 0.9)


def test_clean_labelled_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select("doc_id")
    rows = q.quality_rules(docs).join(good, "doc_id").filter("not base_failed").collect()
    assert rows and all(r.kept for r in rows)


def test_accepted_keeps_columns(edge):
    out = q.accepted(edge)
    assert out.schema == edge.schema
    kept = [r.doc_id for r in q.quality_rules(edge).filter("kept").collect()]
    same([r.doc_id for r in out.collect()], kept)


def prose_of(n_bytes, seed=0):
    common = [w for w in brute_words() if w.isalpha()]
    rnd = random.Random(seed)
    text = ""
    while len(text) < n_bytes:
        text += rnd.choice(common) + " "
    return text[:n_bytes]


def brute_words():
    return ("the of and a to in is you that it he was for on are as with his they at be this have from or one had by word but not what all"
            " were we when your can said there use an each which she do how their if will up other about out many then them these so some"
            " her would make like him into time has look two more write go see number no way could people my than first water been call"
            " who oil its now find long down day did get come made may part over new sound take only little work know place year live me"
            " back give most very after thing our just name good sentence man think say great where help through much before line right").split()


def noise_of(n_bytes, seed=0):
    rnd = random.Random(seed)
    return "".join(" " if i % 6 == 5 else chr(rnd.randint(33, 126)) for i in range(n_bytes))


def test_noise_and_repetition_in_tails_and_short_texts(spark):
    line = "click here to subscribe now "
    texts = {
        "long": prose_of(20_000), "page": prose_of(8190, 1), "short": prose_of(700, 2), "tiny": prose_of(280, 3), "odd": prose_of(4097, 4),
        "noise tail": prose_of(4096, 5) + noise_of(4094), "noise head": noise_of(3000, 1) + prose_of(6000, 6),
        "short noise tail": prose_of(350, 7) + " " + noise_of(350, 2), "all noise": noise_of(900, 3),
        "tail of one page": prose_of(3000, 8) + noise_of(1000, 4),
        "repeated tail": prose_of(6000, 9) + line * 120, "short repeated tail": prose_of(500, 10) + line * 30,
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = dict(zip(texts, (r for r in sorted(q.quality_rules(df).collect(), key=lambda r: r.doc_id))))
    kept = {name for name, r in got.items() if r.kept}
    assert kept == {"long", "page", "short", "tiny", "odd"}, {n: (r.ratio, r.bad_chunks, r.base_failed) for n, r in got.items()}
    assert not any(got[n].base_failed for n in ("noise tail", "noise head", "short noise tail", "all noise", "tail of one page"))


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 511, 512, 4095, 4096, 5000):
        for size in (256, 1024):
            starts = q.chunk_starts(n, size)
            assert {i for s in starts for i in range(s, s + size)} == (set(range(n)) if n >= size else set())


def test_nearly_all_clean_documents_stay_on_the_larger_tables(spark):
    d = "/root/testdata/sf0.1"
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select("doc_id")
    rows = q.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(good, "doc_id").filter("not base_failed")
    n, kept = rows.selectExpr("count(*)", "count_if(kept)").first()
    assert n > 1000 and kept >= 0.99 * n
