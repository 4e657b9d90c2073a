"""Operator 6: near-duplicates by DartMinHash.

A document is the multiset of its 5-word shingles; weights are the counts. Every unit of weight of an
element is a region into which hashed darts fall, at ranks that are the arrivals of a Poisson
process; each dart has a coordinate, and the earliest dart of a coordinate is the signature's value there. Two
documents agree at a coordinate with the probability of their weighted Jaccard similarity, and only
darts below a rank that shrinks with the document's weight are ever thrown. Bands of ROWS coordinates
give buckets.

Similarities of candidates are computed exactly, on the shingles. Equal texts are one class from the
start. In each bucket all are compared with its most central member (the one whose
buckets are largest); classes are the connected components of the links; then what shares a bucket and
is still apart is compared too, so that a link found by the bands isn't lost. Of those, a document goes
on only where a partner is possible at all: those who share a rare shingle are paired by it, and for all other
pairs the common shingles bound what two texts can share. The bound is exact: it spares pairs and loses none.

Cases: null texts and texts without words are alone, each its own class; a text of 1 to 4 words is one shingle of
all its words; very long texts are compared whole; rows that repeat an id are one document, linked by any of its texts; rows
without an id get no class; ties go to the smallest id; an empty table gives an empty result; further columns
are not read (or pass through, where rows are filtered).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, can_checkpoint, drop_folder, flat, grams, mix, shared_folder, slices, small_batches, word_hashes, words

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of ROWS coordinates: a pair at 0.8 shares a bucket with probability 1 - (1 - 0.8^4)^20 > 0.99997.
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
#: Lanes of ids in which the holders of a rare shingle are counted.
LANES = 4
#: Edges that a task of components() takes at least: small tables lie in few files from round to round.
EDGES = 1 << 17


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every shingle in order of the texts, repeats included."""
    start, end, doc = words(raw, offsets)
    codes = word_hashes(raw, start, end)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    whole = grams(codes, SHINGLE)
    own = doc[: len(whole)] == doc[SHINGLE - 1 :] if len(whole) else np.zeros(0, bool)
    texts, values = doc[: len(whole)][own], mix(whole[own])
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if n else count
    extra_doc, extra = [], []
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        extra_doc.append(i)
        extra.append(mix(grams(codes[first[i] : first[i] + count[i]], int(count[i])) + U64(count[i]))[0])
    texts, values = np.concatenate([texts, np.array(extra_doc, np.int64)]), np.concatenate([values, np.array(extra, np.uint64)])
    order = np.argsort(texts, kind="stable")
    return texts[order], values[order]


def regions(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, region) of every unit of weight: the repeats of an element in its text are regions of their own."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))) if len(doc) else np.zeros(0, bool)
    start = np.flatnonzero(fresh)
    unit = np.arange(len(doc)) - np.repeat(start, np.diff(np.concatenate((start, [len(doc)]))))
    with np.errstate(over="ignore"):
        return doc, mix(value + unit.astype(np.uint64) * U64(0xD1342543DE82EF95))


def signatures(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The n x COORDINATES matrix of earliest darts (0: no element) of weighted sets given as
    repeated elements, sorted by text."""
    doc, region = regions(doc, value)
    weight = np.bincount(doc, minlength=n).astype(float)
    earliest, chosen = np.full(n * COORDINATES, np.inf), np.zeros(n * COORDINATES, np.uint64)
    low = np.zeros(n)
    live = weight > 0
    reach = np.where(live, (np.log(COORDINATES) + 3) / np.maximum(weight, 1), 0)
    while live.any():
        # Throw the darts of the regions of live texts with ranks in [low, reach).
        at = np.flatnonzero(live[doc])
        place, area, rank = doc[at], region[at], np.zeros(len(at))
        throw = 0
        while len(at):
            with np.errstate(over="ignore"):
                dart = mix(area + U64(throw + 1) * U64(0x9E3779B97F4A7C15))
            uniform = ((dart >> U64(11)).astype(float) + 0.5) / 2.0**53
            rank = rank - np.log(uniform) / COORDINATES
            inside = rank < reach[place]
            at, place, area, rank, dart = at[inside], place[inside], area[inside], rank[inside], dart[inside]
            new = rank >= low[place]
            slot = place[new] * COORDINATES + (mix(dart[new] ^ U64(0xA5A5A5A5)) % U64(COORDINATES)).astype(np.int64)
            by = np.lexsort((dart[new], rank[new], slot))
            slot, r, d = slot[by], rank[new][by], dart[new][by]
            one = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, bool)
            slot, r, d = slot[one], r[one], d[one]
            better = r < earliest[slot]
            earliest[slot[better]], chosen[slot[better]] = r[better], d[better]
            throw += 1
        # A text with an empty coordinate left throws again, over the next stretch of ranks.
        live &= np.isinf(earliest.reshape(n, COORDINATES)).any(1)
        low, reach = np.where(live, reach, low), np.where(live, 2 * reach, reach)
    return chosen.reshape(n, COORDINATES)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n x BANDS bucket keys."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
        return mix(key + np.arange(BANDS, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarities of text pairs."""
    n = len(left)
    count = []
    for side in (left, right):
        doc, value = shingles(*flat(side))
        count.append((doc, value))
    doc = np.concatenate([count[0][0], count[1][0]])
    value = np.concatenate([count[0][1], count[1][1]])
    sign = np.concatenate([np.zeros(len(count[0][0]), np.int64), np.ones(len(count[1][0]), np.int64)])
    order = np.lexsort((value, doc))
    doc, value, sign = doc[order], value[order], sign[order]
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))) if len(doc) else np.zeros(0, np.int64)
    if not len(edge):
        return np.zeros(n)
    right_count = np.add.reduceat(sign, edge)
    left_count = np.diff(np.concatenate((edge, [len(doc)]))) - right_count
    of = doc[edge]
    return np.bincount(of, np.minimum(left_count, right_count), n) / np.maximum(np.bincount(of, np.maximum(left_count, right_count), n), 1)


def buckets(texts: DataFrame) -> DataFrame:
    """(doc_id, key, size) of the bands of texts(doc_id, text) with words; size: shingles of the text."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                raw, offsets = flat(rows["text"])
                doc, value = shingles(raw, offsets)
                signature = signatures(doc, value, rows.num_rows)
                some = signature.any(1)
                ids, size = rows["doc_id"].to_numpy()[some], np.bincount(doc, minlength=rows.num_rows)[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BANDS)), pa.array(band_keys(signature[some]).ravel()), pa.array(np.repeat(size, BANDS))], names=["doc_id", "key", "size"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, size long")


def rare_units(texts: DataFrame) -> DataFrame:
    """`docs`, a row for each shingle unit that only a few of texts(doc_id, text) hold: who holds it. Units are
    the repeats of a shingle in a text, each of weight one. Ids fall into LANES lanes by hash, and a unit
    is rare if no lane has it more than twice: least and greatest id of each lane then name all who hold it, and a
    unit that very many hold takes no more room in the aggregation than any other."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                doc, value = shingles(*flat(rows["text"]))
                doc, region = regions(doc, value)
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(rows["doc_id"].to_numpy()[doc])], names=["unit", "doc_id"])

    held = texts.select("doc_id", "text").mapInArrow(run, "unit long, doc_id long")
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(LANES))
    parts = [f(F.when(lane == i, F.col("doc_id"))).alias(f"{n}{i}") for i in range(LANES) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    few = F.greatest(*[F.col(f"n{i}") for i in range(LANES)]) <= 2
    names = F.array(*[F.col(f"{n}{i}") for i in range(LANES) for n in ("low", "high")])
    return held.groupBy("unit").agg(*parts).where(few).select(F.array_distinct(F.array_compact(names)).alias("docs"))


def possible_pairs(apart: DataFrame, texts: DataFrame, single: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of different classes in apart(key, doc_id, c, size) that may be similar enough, among
    bucket mates and those who share a rare unit.

    Texts of n and m shingles need least / (1 + least) * (n + m) in common. Whoever shares a rare
    unit is paired by it; all others have at most their other units in common, which bounds how large a partner
    can be. Ids outside single(doc_id) have several texts and no bound."""
    need = (1 + least) / least
    ids = apart.groupBy("doc_id").agg(F.min("c").alias("c"), F.collect_set("key").alias("keys"), F.min("size").alias("low"), F.max("size").alias("high")).checkpoint()
    rare = rare_units(texts.join(ids.select("doc_id"), "doc_id")).checkpoint()
    own = rare.select(F.explode("docs").alias("doc_id"), F.when(F.size("docs") == 1, 1).alias("alone")).groupBy("doc_id").agg(F.count("*").alias("own"), F.count("alone").alias("alone"))
    limit = lambda c: F.when(F.col("one"), need * (F.col("high") - F.coalesce(c, F.lit(0))) - F.col("high") + 1e-6).otherwise(1e18)
    known = ids.join(single.withColumn("one", F.lit(True)), "doc_id", "left").join(own, "doc_id", "left").select("doc_id", "c", "keys", "low", "high", limit("own").alias("reach"), limit("alone").alias("far")).checkpoint()

    live = apart.join(known.select("doc_id", "reach", "keys"), "doc_id").where(F.col("reach") >= least * F.col("size") - 1e-6).checkpoint()
    for _ in range(2):  # who can't reach the smallest in the bucket goes, then buckets of one class
        some = live.groupBy("key").agg(F.min("size").alias("s"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key", "s").checkpoint()
        live = live.join(some, "key").where("reach >= s").drop("s").checkpoint()
    x, y = live.alias("x"), live.alias("y")
    differ = (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.c") != F.col("y.c"))
    sizes = (F.col("x.size") <= F.col("y.reach")) & (F.col("y.size") <= F.col("x.reach")) & (F.col("x.size") >= least * F.col("y.size") - 1e-6) & (F.col("y.size") >= least * F.col("x.size") - 1e-6)
    # Of the buckets that two share, the first pairs them.
    first = F.col("x.key") == F.array_min(F.array_intersect("x.keys", "y.keys"))
    mates = x.join(y, (F.col("x.key") == F.col("y.key")) & differ & sizes & first).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))

    both = rare.where(F.size("docs") > 1).select("docs", F.explode("docs").alias("a")).select("a", F.explode("docs").alias("b")).where("a < b").distinct()
    side = lambda n: known.select(F.col("doc_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("c", "low", "high", "far")])
    by_unit = both.join(side("a"), "a").join(side("b"), "b").where(f"a_c <> b_c AND a_low <= b_far AND b_low <= a_far AND a_high >= {least} * b_low - 1e-6 AND b_high >= {least} * a_low - 1e-6").select("a", "b")
    return mates.unionByName(by_unit).distinct()


def linked(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "left", "right"):
                good = similarity(rows["left"].combine_chunks(), rows["right"].combine_chunks()) >= least - 1e-12
                yield pa.RecordBatch.from_arrays([rows["a"].combine_chunks().filter(pa.array(good)), rows["b"].combine_chunks().filter(pa.array(good))], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, class): the smallest id of each connected component of links(a, b), by alternating large-star
    and small-star steps until nothing changes. A node's neighbours meet only in aggregates and joins."""
    can_checkpoint(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()
    n = edges.count()
    while True:
        kept = lambda df, tasks=n // EDGES + 1: df.coalesce(tasks).checkpoint()
        edges = edges.coalesce(n // EDGES + 1)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        # Large star: each larger neighbour is tied to the node's smallest.
        large = kept(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        # Small star: the smaller neighbours and the node are tied to the smallest of them.
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        small = kept(large.join(low, "u").select(pair.alias("e")).select("e.*").where("u > v").distinct())
        # Neither has a row twice, so that as many rows and none that is new mean the same rows.
        before, n = n, small.count()
        if n == before and small.exceptAll(edges).isEmpty():
            break
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): a row for each id of docs(doc_id, text). Tables that joins meet by a key that
    many rows may share are checkpointed first: Spark can then split such a key."""
    spark = docs.sparkSession
    can_checkpoint(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    # Equal texts: only the smallest id goes on. Texts don't move for that, their digests do.
    digest, some = F.sha2("text", 256), F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).otherwise(0)
    digests = rows.groupBy("doc_id").agg(F.min(digest).alias("h"), F.max(digest).alias("h1"), F.max(some).alias("some"), F.count("*").alias("texts")).checkpoint()
    single = digests.where("some = 1 and h = h1").select("doc_id", "h")
    first = single.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("h", "first_id").checkpoint()
    copies = single.join(first, "h").where("doc_id > first_id").select("doc_id", "first_id").checkpoint()

    path = shared_folder(spark)
    buckets(rows).join(copies, "doc_id", "left_anti").write.parquet(path)
    found = spark.read.parquet(path)
    sizes = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
    shared = found.join(sizes, "key").checkpoint()
    central = shared.groupBy("doc_id").agg(F.sum("n").alias("central"))
    ranked = shared.join(central, "doc_id")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("d"))).alias("p")).select("key", (-F.col("p.d")).alias("b")).checkpoint()
    tried = shared.join(pivots, "key").where("doc_id <> b").select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct().checkpoint()
    links = linked(tried, rows, least).checkpoint()
    classes = components(links).checkpoint()
    # Bucket mates in different classes that were not compared yet.
    member = shared.join(classes, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("class", "doc_id").alias("c"), "size").checkpoint()
    split = member.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key").checkpoint()
    apart = member.join(split, "key").checkpoint()
    mates = possible_pairs(apart, rows, digests.where("texts = 1").select("doc_id"), least)
    more = mates.join(tried, ["a", "b"], "left_anti").checkpoint()
    if not more.isEmpty():
        found_late = linked(more, rows, least).checkpoint()
        if not found_late.isEmpty():
            # Each node's tie to its class stands for the links that are already joined up.
            classes = components(classes.toDF("a", "b").unionByName(found_late)).checkpoint()
    drop_folder(spark, path)
    out = digests.select("doc_id").join(copies, "doc_id", "left").withColumn("node", F.coalesce("first_id", "doc_id"))
    return out.join(classes, "node", "left").select("doc_id", F.coalesce("class", "node").alias("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: those of the smallest id of each class, and rows without an id."""
    gone = near_classes(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
