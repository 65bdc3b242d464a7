"""Near-duplicate components by a grouped prefix join on word shingles.

Every set of shingles is put into one global order: shingles that many sets hold in
their prefixes last, the others by hash. Sets of Jaccard similarity t share a shingle
among the first ``n - ceil(t n) + 1`` of each. Equal sets are one class. Classes with
the same prefix and size are one group; only groups meet in the join on prefix
shingles, group pairs are filtered by size, and then expanded to members that are
verified on their whole sets.

The order only decides which groups meet, never the result, so the table of frequent
shingles may be bounded. Two rounds keep the work near linear: first each group's
members against one of them, and each shingle's groups against one of them; the links
found make components, and only pairs still in different components are looked at in
the second round. A pair left out is already connected, so no link that matters to the
components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .arrays import LOWER, _STEP, Hashes, U, Words, docs_of, mix, release
from .components import components
from .tables import forget_stored, free_name, stored

SHINGLE, PERCENT = 4, 85
FREQUENT_FROM = 16            # a shingle in more prefixes than this counts as frequent
FREQUENT_MOST = 250_000       # bound of the table of frequent shingles (2 MB)
FILTER_BITS = 1 << 23         # bits of the filter for documents that have to be read again
PARITY_WORDS = 8              # 64-bit words of a set's parity sketch
PIVOT_ROUNDS = 3              # linear rounds against pivots before pairs are joined; they decide only the work
WORDS = [f"w{i}" for i in range(PARITY_WORDS)]
BITMAP = 1 << 15              # bits of one bitmap of Spark's bitmap functions


def sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    low = LOWER[data]
    w = Words(low, off)
    word = Hashes(low).of(w.start, w.end)
    at, gram = w.grams(word, k)
    bound = np.searchsorted(at, w.first)
    for d, n in enumerate(w.count.tolist()):
        if n >= k:
            yield np.unique(gram[bound[d]:bound[d + 1]])
        elif n:
            own = word[w.first[d]:w.first[d + 1]]
            yield mix(np.array([(own * _STEP[32:32 + n]).sum() + U(n)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def parity(s: np.ndarray) -> np.ndarray:
    """Bit b is the parity of the number of shingles that fall on b: two sets differ in at least as many
    shingles as their sketches do in bits."""
    bits = np.bincount((s >> U(20)).astype(np.int64) & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix_counts(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(shingle, n): in how many texts a shingle is among the smallest hashes, as many as the prefix has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in docs_of(batch):
                heads = [s[:prefix_length(len(s), percent)] for s in sets(data, off, k) if len(s)]
                if heads:
                    shingle, n = np.unique(np.concatenate(heads), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], ["shingle", "n"])
        release()

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def frequent_shingles(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """Sorted hashes of the most frequent shingles, FREQUENT_MOST at most."""
    top = (prefix_counts(docs, k, percent).filter(F.col("n") > FREQUENT_FROM)
           .orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST).select("shingle").toPandas())
    return np.sort(top["shingle"].to_numpy(np.int64).view(np.uint64))


def holds(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def ordered_prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    p = prefix_length(len(s), percent)
    if holds(frequent, s[:p]).any():
        late = holds(frequent, s)
        return np.concatenate([s[~late], s[late]])[:p]
    return s[:p]


def signatures(docs: DataFrame, frequent: np.ndarray, k: int, percent: int) -> DataFrame:
    """(doc_id, n, class, grp, prefix, parity) of each row; ``prefix`` only the first time a task meets the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, data, off in docs_of(batch):
                sizes, classes, groups, heads, sketches = [], [], [], [], []
                for s in sets(data, off, k):
                    n = len(s)
                    head = ordered_prefix(s, frequent, percent) if n else s
                    group = hashlib.md5(head.tobytes() + n.to_bytes(8, "little")).digest()
                    sizes.append(n)
                    classes.append(hashlib.md5(s.tobytes()).digest())
                    groups.append(group)
                    sketches.append(parity(s))
                    heads.append(head.view(np.int64) if n and group not in told else None)
                    told.add(group)
                    if len(told) > 200_000:
                        told.clear()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()),
                     pa.array(groups, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    ["doc_id", "n", "class", "grp", "prefix", "parity"])
        release()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, class binary, grp binary, prefix array<long>, parity array<long>")


def filter_bits(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap of hashed ids, of fixed size however many ids there are."""
    at = ids.select((F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))).alias("p"))
    rows = (at.groupBy(F.expr(f"p div {BITMAP}").alias("k"))
            .agg(F.expr(f"bitmap_construct_agg(p % {BITMAP})").alias("bits")).collect())
    out = np.zeros(FILTER_BITS, bool)
    for r in rows:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        out[r["k"] * BITMAP:(r["k"] + 1) * BITMAP] = bits
    return out


def whole_sets(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(doc_id, items, is_member, is_pivot) of the documents that pairs name, and of few others."""
    members, pivots = filter_bits(pairs, "a"), filter_bits(pairs, "b")
    wanted = members | pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names).filter(pa.array(wanted[at]))
            if not batch.num_rows:
                continue
            ids, at = batch.column("doc_id").cast(pa.int64()), batch.column("at").to_numpy()
            member, pivot = members[at], pivots[at]
            for i, j, data, off in docs_of(batch):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array([s.tobytes() for s in sets(data, off, k)], pa.binary()),
                     pa.array(member[i:j]), pa.array(pivot[i:j])], ["doc_id", "items", "is_member", "is_pivot"])
        release()

    at = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)).alias("at"))
    return at.mapInArrow(run, "doc_id long, items binary, is_member boolean, is_pivot boolean")


def links(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the stored ``pairs(a, b)`` whose whole sets reach the similarity."""
    found = stored(whole_sets(docs, pairs, k), "jaccard-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int(holds(t, s).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    left = found.filter("is_member").select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = found.filter("is_pivot").select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    out = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
                 .mapInArrow(run, "a long, b long"), "jaccard-links")
    forget_stored(found)
    return out


def near(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def reaches(percent: int):
    """Bound by the shared prefix shingles ``c`` and what is left behind the last of them, at ``i`` and ``j``."""
    return ((F.col("c") + F.least(F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1)) * (100 + percent)
            >= (F.col("n") + F.col("m")) * percent)


def against_pivots(buckets: DataFrame, rank, percent: int) -> DataFrame:
    """(a, b), a > b: each group and that pivot which it shares most prefix shingles with.

    A shingle's pivot is its group of highest rank; found by a partial aggregate and joined back,
    so a shingle of very many groups is no single task. ``buckets`` has c0 and c1, the least and the
    largest component of the group.
    """
    best = buckets.groupBy("shingle").agg(F.max(F.struct(rank.alias("r"), (-F.col("gid")).alias("g"), "n", "pos", "c0", "c1")).alias("_p"))
    pairs = (buckets.join(best, "shingle")
             .select("gid", "n", "pos", "c0", "c1", (-F.col("_p.g")).alias("b"), F.col("_p.n").alias("m"), F.col("_p.pos").alias("q"),
                     F.col("_p.c0").alias("d0"), F.col("_p.c1").alias("d1"))
             .filter((F.col("gid") != F.col("b")) & near("n", "m", percent)
                     & ~((F.col("c0") == F.col("c1")) & (F.col("d0") == F.col("d1")) & (F.col("c0") == F.col("d0"))))
             .groupBy("gid", "b").agg(F.count(F.lit(1)).alias("c"), F.max("pos").alias("i"), F.max("q").alias("j"),
                                      F.first("n").alias("n"), F.first("m").alias("m"))
             .filter(reaches(percent)).groupBy("gid").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b")))
    return pairs.select(F.greatest("gid", "b").alias("a"), F.least("gid", "b").alias("b")).distinct()


def labels(members: DataFrame, label: DataFrame) -> DataFrame:
    """(gid, rep, n, component, parity words) of every class."""
    return members.join(label, members["rep"] == label["node"], "left").select(
        "gid", "rep", "n", F.coalesce("component", "rep").alias("component"), *WORDS)


def alike(x: str, y: str, percent: int):
    """Whether the parity sketches allow the similarity; passes where either side has none."""
    apart = sum(F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in WORDS)
    return F.coalesce(apart * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent), F.lit(True))


def still_open(buckets: DataFrame, labelled: DataFrame) -> DataFrame:
    """Bucket rows of shingles whose groups lie in more than one component, with the groups' components."""
    spread = labelled.groupBy("gid").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    rows = buckets.join(spread, "gid")
    mixed = rows.groupBy("shingle").agg(F.min("c0").alias("lo"), F.max("c1").alias("hi")).filter("lo != hi").select("shingle")
    return rows.join(mixed, "shingle")


def joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """Components again after more links."""
    return stored(components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b"))),
                  "jaccard-components")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs(doc_id, text)``.

    Null or empty texts have no shingles and stand alone. Rows that repeat an id are one
    document: their links count for it. A row without an id takes no part in links; its
    component is that of documents with the same set, else null. Equal sets are linked
    by definition. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(docs, frequent_shingles(docs, k, percent), k, percent), "jaccard-signatures")
    rows = signed.select("doc_id", "n", "class", "grp")
    words = [F.col("parity")[i].alias(f"w{i}") for i in range(PARITY_WORDS)]
    classes = stored(signed.filter(F.col("n") > 0).select("doc_id", "n", "class", "grp", *words).groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.first("grp").alias("grp"), F.first("n").alias("n"), *[F.max(w).alias(w) for w in WORDS])
        .filter(F.col("rep").isNotNull()), "jaccard-classes")
    groups = classes.groupBy("grp").agg(F.min("rep").alias("gid"), F.first("n").alias("n"))
    members = stored(classes.join(groups.select("grp", "gid"), "grp").select("gid", "rep", "n", *WORDS), "jaccard-members")

    # prefix shingles that more than one group holds
    tokens = (signed.filter(F.col("prefix").isNotNull())
              .select(F.expr("xxhash64(grp)").alias("g"), F.posexplode("prefix").alias("pos", "shingle")))
    many = tokens.groupBy("shingle").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo != hi").select("shingle")
    shared = tokens.join(many, "shingle").select("shingle", "g", "pos")
    named = groups.select(F.expr("xxhash64(grp)").alias("g"), "gid", "n")
    buckets = stored(shared.distinct().join(named, "g").select("shingle", "gid", "n", "pos"), "jaccard-buckets")

    # round 1: members against their group's first, groups against the first of the shingles they share most with
    # (shared ones of other firsts are not counted here; a pair put off by that is looked at in a later round)
    first = against_pivots(buckets.withColumn("c0", F.col("gid")).withColumn("c1", F.col("gid")), -F.col("gid"), percent)
    within = members.filter(F.col("rep") != F.col("gid")).select(F.col("rep").alias("a"), F.col("gid").alias("b"))
    looked_at = stored(first.union(within).distinct(), "jaccard-pairs")          # a > b
    found = links(docs, looked_at, k, percent)
    # an id with several sets ties them together
    ids = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).join(classes.select("class", "rep"), "class")
    least = F.min("rep").over(Window.partitionBy("doc_id"))
    repeated = ids.select("rep", least.alias("b")).filter(F.col("rep") != F.col("b")).select(F.col("rep").alias("a"), "b")
    edges = found.union(repeated)
    label = stored(components(edges), "jaccard-components")

    # further linear rounds on what still lies in different components: against the group that has the largest
    # share of its prefix in common with others (of a family of near copies the one with the fewest own words), then
    # against others by hash
    held = buckets.groupBy("gid").agg((F.count(F.lit(1)) / (F.first("n") * (100 - percent) / 100 + 1)).alias("share"))
    buckets_ = buckets
    buckets = stored(buckets.join(held, "gid"), "jaccard-buckets")
    forget_stored(buckets_)
    order = [F.col("share")] + [F.xxhash64("gid", F.lit(r)) for r in range(PIVOT_ROUNDS - 1)]
    for rank in order:
        labelled = labels(members, label)
        open_ = stored(still_open(buckets, labelled), "jaccard-open")
        pairs = stored(against_pivots(open_, rank, percent).join(looked_at, ["a", "b"], "left_anti"), "jaccard-pairs")
        forget_stored(open_)
        if pairs.isEmpty():
            forget_stored(pairs)
            continue
        more = links(docs, pairs, k, percent)
        label_, looked_ = label, looked_at
        label, looked_at = joined(label, more), stored(looked_at.union(pairs), "jaccard-pairs")
        forget_stored(label_, looked_, pairs, more)

    # last round: what the buckets and groups still hold in different components
    labelled = stored(labels(members, label), "jaccard-labels")
    # a group's sketch is that of its only member; groups of several pass to their members
    only = labelled.groupBy("gid").agg(*[F.when(F.count(F.lit(1)) == 1, F.max(w)).alias(w) for w in WORDS])
    open_ = stored(still_open(buckets, labelled).join(only, "gid"), "jaccard-open")
    x, y = open_.alias("x"), open_.alias("y")
    # up to a pair's first common shingle nothing is shared, so what lies behind it bounds the intersection
    ahead = 1 + F.least(F.col("x.n") - F.col("x.pos") - 1, F.col("y.n") - F.col("y.pos") - 1)
    meets = ((F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.gid") < F.col("y.gid")) & near("x.n", "y.n", percent)
             & (ahead * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent) & alike("x", "y", percent)
             & ~((F.col("x.c0") == F.col("x.c1")) & (F.col("y.c0") == F.col("y.c1")) & (F.col("x.c0") == F.col("y.c0"))))
    group_pairs = (x.join(y, meets).groupBy(F.col("x.gid").alias("g"), F.col("y.gid").alias("h"))
                   .agg(F.count(F.lit(1)).alias("c")).select("g", "h"))
    p, q = labelled.alias("p"), labelled.alias("q")
    across = (group_pairs.join(p, F.col("g") == F.col("p.gid")).join(q, F.col("h") == F.col("q.gid"))
              .filter((F.col("p.component") != F.col("q.component")) & alike("p", "q", percent))
              .select(F.col("p.rep").alias("u"), F.col("q.rep").alias("v")))
    mixed = labelled.groupBy("gid").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1").select("gid")
    p, q = labelled.join(mixed, "gid").alias("p"), labelled.join(mixed, "gid").alias("q")
    inside = (p.join(q, (F.col("p.gid") == F.col("q.gid")) & (F.col("p.rep") < F.col("q.rep"))
                     & (F.col("p.component") != F.col("q.component")) & alike("p", "q", percent))
              .select(F.col("p.rep").alias("u"), F.col("q.rep").alias("v")))
    left = (across.union(inside).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
            .join(looked_at, ["a", "b"], "left_anti"))
    left = stored(left, "jaccard-pairs")
    late = None if left.isEmpty() else links(docs, left, k, percent)
    if late is not None and not late.isEmpty():
        first_label = label
        label = joined(label, late)
        forget_stored(first_label)
    forget_stored(members, buckets, looked_at, found, labelled, open_, left, *([late] if late is not None else []))

    known = rows.join(classes.select("class", "rep"), "class", "left").join(
        label, F.col("rep") == F.col("node"), "left")
    return known.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def unnamed_alone(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Rows of ``docs`` without an id whose set of shingles no row with an id has."""
    name = free_name(docs, "_class")

    def digests(batch: pa.RecordBatch) -> pa.Array:
        return pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None
                         for _, _, data, off in docs_of(batch) for s in sets(data, off, k)], pa.binary())

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([digests(batch)], [name])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, digests(batch)], [*batch.schema.names, name])

    bare = docs.filter(F.col("doc_id").isNull())
    if bare.isEmpty():
        return docs.limit(0)
    own = bare.mapInArrow(beside, StructType([*docs.schema.fields, StructField(name, BinaryType())]))
    named = docs.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(alone, f"`{name}` binary").distinct()
    return own.join(named, name, "left_anti").select(*docs.columns)
