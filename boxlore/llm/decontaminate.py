"""Benchmark decontamination with DataFrame functions alone.

Windows of a document that are as long as a benchmark item get SimHash fingerprints; fingerprints
within a radius are found by equal blocks of bits (with one block more than the radius, two
fingerprints that near must agree in a whole block); an exact weighted-shingle similarity decides.

A window can only be similar if it shares a shingle with the item. So windows are placed where
shared shingles put the item: words that were put in or left out give two starts, and both are
tried. Equal windows of many documents are fingerprinted and verified once.

So shared shingles choose the pairs, and the fingerprints only test them again: a fingerprint of
every window of every item's length costs 64 sums per word and length in native expressions, and
with the radius of 23 that weighted similarity 0.8 needs on short items, blocks of two or three
bits would let nearly every pair pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlore.llm.store import fresh_name
from boxlore.session import Scratch

SHINGLE = 5
BITS, RADIUS = 64, 23
BROADCAST_ROWS = 200_000  # shingles of a benchmark that may be broadcast, about 10 MB; more are merged


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words; words are parted by blank and 0x09-0x0D."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order; empty if there are fewer words."""
    def runs(a: Column) -> Column:
        last = F.size(a) - width
        run = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(width)], F.lit(width)))
        return F.when(last >= 0, run).otherwise(F.array().cast("array<bigint>"))

    # The outer transform binds the words, which would otherwise be split again for every run.
    return F.element_at(F.transform(F.array(words), runs), 1)


def simhash(features: Column) -> Column:
    """64 signs of the summed feature bits; a repeated feature weighs as often as it occurs."""
    def fold(a: Column) -> Column:
        half = F.size(a) / F.lit(2)
        ones = lambda b: F.aggregate(a, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int"))
        return F.aggregate(
            F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(ones(b) > half, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))),
            F.lit(0).cast("bigint"), lambda s, v: s.bitwiseOR(v),
        )

    return F.element_at(F.transform(F.array(features), fold), 1)


def blocks(fingerprint: Column) -> Column:
    """RADIUS + 1 structs (number, bits)."""
    n = RADIUS + 1
    out = []
    for j in range(n):
        low, high = BITS * j // n, BITS * (j + 1) // n
        out.append(F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("bits")))
    return F.array(*out)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists: shared occurrences over the greater occurrences."""
    times = lambda v, x: F.size(F.filter(v, lambda y: y == x))
    total = lambda pick: F.aggregate(F.array_union(a, b), F.lit(0), lambda s, x: s + pick(times(a, x), times(b, x)))
    return total(F.least) / total(F.greatest)


def matches(docs: DataFrame, benchmark: DataFrame, own: Scratch, threshold: float = 0.8, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The best window of each contaminated document per item: ``doc_id, item_id, similarity, start, n_words, distance``.

    ``start`` counts words from 0. Items of fewer than five words match as a whole run of words;
    null, empty and blank texts and items match nothing. Ties go to the earlier window. Rows of one
    document key count as one document, rows of one item id as one item with several texts. A null
    document key matches nothing.
    """
    items = own.keep(
        benchmark.select(F.col(item).alias("item_id"), word_hashes(F.col(item_text).cast("string")).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("width"), "w")
    )
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # five at most
    empty = docs.select(F.col(key).alias("doc_id")).limit(0)
    if not widths:
        return empty.selectExpr("doc_id", "cast(null as bigint) item_id", "cast(null as double) similarity", "cast(null as int) start", "cast(null as int) n_words", "cast(null as int) distance")
    own_shingles = None
    for width in widths:
        some = items.where(F.col("width") == width).select("item_id", "n", "width", shingles(F.col("w"), width).alias("s"))
        own_shingles = some if own_shingles is None else own_shingles.unionByName(some)
    own_shingles = own.keep(own_shingles.withColumn("item_row", F.xxhash64("item_id", "s")))
    marks = own.keep(own_shingles.select("item_row", "n", "width", F.posexplode("s").alias("o", "h")))
    small = marks.count() <= BROADCAST_ROWS
    hinted = F.broadcast(marks) if small else marks.hint("merge")
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    hits = None
    for width in widths:
        placed = base.select("doc_id", F.posexplode(shingles(word_hashes(F.col("text")), width)).alias("p", "h"))
        some = placed.join(hinted.where(F.col("width") == width), "h").select("doc_id", "item_row", "width", "n", (F.col("p") - F.col("o")).alias("start"))
        hits = some if hits is None else hits.unionByName(some)
    hits = own.keep(hits.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("item_row", "width", "n", "start")).alias("hits")))
    # A document's hits are no more than its words times the items that hold them. One plan at every size.
    met = base.join(hits.hint("merge"), "doc_id").select("doc_id", word_hashes(F.col("text")).alias("w"), "hits")
    windows = None
    for width in widths:
        some = met.select("doc_id", shingles(F.col("w"), width).alias("s"), F.explode(F.filter("hits", lambda x: x["width"] == width)).alias("x"))
        low, high = F.greatest(F.col("x.start"), F.lit(0)), F.least(F.col("x.start") + F.col("x.n") - (width - 1), F.size("s"))
        some = some.select("doc_id", F.col("x.item_row").alias("item_row"), low.alias("start"), (high - low + width - 1).alias("n_words"), F.slice("s", low + 1, high - low).alias("a"))
        windows = some if windows is None else windows.unionByName(some)
    windows = own.keep(windows.where(F.size("a") > 0).withColumn("window", F.xxhash64("a")))
    pairs = windows.groupBy("window", "item_row", "a").agg(F.lit(1).alias("one")).drop("one")
    prints = own.keep(pairs.withColumn("f", simhash(F.col("a"))))
    targets = own_shingles.dropDuplicates(["item_row"]).select("item_row", F.col("s").alias("b"), simhash(F.col("s")).alias("g"))
    near = (
        prints.select("window", "item_row", "a", "f", F.explode(blocks(F.col("f"))).alias("k"))
        .join(targets.select(F.col("item_row").alias("target"), "b", "g", F.explode(blocks(F.col("g"))).alias("l")), (F.col("item_row") == F.col("target")) & (F.col("k") == F.col("l")))
        .withColumn("distance", F.bit_count(F.col("f").bitwiseXOR(F.col("g"))))
        .where(F.col("distance") <= RADIUS)
        .groupBy("window", "item_row", "a").agg(F.first("b").alias("b"), F.first("distance").alias("distance"))
    )
    verified = near.withColumn("similarity", similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= threshold).select("window", "item_row", "similarity", "distance")
    named = verified.join(own_shingles.select("item_row", "item_id").distinct(), "item_row")
    found = windows.drop("a").join(named, ["window", "item_row"])
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "distance")).alias("m"))
    return best.select("doc_id", "item_id", "m.similarity", (-F.col("m.back")).alias("start"), "m.n_words", F.col("m.distance").cast("int").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, own: Scratch, threshold: float = 0.8, key: str = "doc_id", **how: object) -> DataFrame:
    """The documents that hold no item, and those without a key; all columns as they were."""
    name = fresh_name(docs, "found")
    found = matches(docs, benchmark, own, threshold, key=key, **how).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found.hint("merge"), docs[key] == found[name], "left_anti")
