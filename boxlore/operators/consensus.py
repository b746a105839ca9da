"""Model answers to votes, votes to consensus, consensus to corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxlore.functions.scalars import strip, without_fence

# The phrases that decide an answer that is not JSON.
DIFFERENT_PHRASES = ["not the same", "different product", "do not match"]
SAME_PHRASE = "same product"


def _is_object(text: Column) -> Column:
    kind = F.call_function("schema_of_variant", F.try_parse_json(text))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def parse_verdict(response: Column) -> Column:
    """Struct ``match, reason`` out of an answer: JSON, cut JSON, or phrases, in that order."""
    text = without_fence(response)
    lower = F.lower(text)
    said = lambda v: text.contains(f'"match": {v}') | text.contains(f'"match":{v}')
    different = F.lit(False)
    for phrase in DIFFERENT_PHRASES:
        different = different | lower.contains(phrase)
    value = F.get_json_object(text, "$.match")
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    parsed = F.struct(
        F.when(value == "true", yes).when(value == "false", no).otherwise(unknown).alias("match"),
        F.coalesce(F.get_json_object(text, "$.reason"), F.lit("")).alias("reason"))
    make = lambda m, r: F.struct(m.alias("match"), r.alias("reason"))
    return (
        F.when(_is_object(text), parsed)
        .when(said("true"), make(yes, F.lit("")))
        .when(said("false"), make(no, text))
        .when(different, make(no, F.substring(text, 1, 100)))
        .when(lower.contains(SAME_PHRASE) & ~lower.contains("not"), make(yes, F.lit("")))
        .otherwise(make(unknown, F.lit("parse_error")))
    )


def parse_choice(response: Column) -> Column:
    """Struct ``choice, cat_id, confidence, reason`` out of an answer."""
    raw = strip(response)
    text = without_fence(response)
    number = lambda p: F.regexp_extract(raw, p, 1)
    choice, cat = number(r'"choice"\s*:\s*(\d+)'), number(r'"cat_id"\s*:\s*(\d+)')
    field = lambda n: F.get_json_object(text, f"$.{n}")
    make = lambda c, k, f, r: F.struct(c.cast("int").alias("choice"), k.cast("int").alias("cat_id"), f.alias("confidence"), r.alias("reason"))
    return (
        F.when(_is_object(text), make(
            F.coalesce(field("choice").try_cast("int"), F.lit(0)), field("cat_id").try_cast("int"),
            F.coalesce(field("confidence"), F.lit("unknown")), F.coalesce(field("reason"), F.lit(""))))
        .when(choice != "", make(choice.try_cast("int"), F.when(cat != "", cat.try_cast("int")), F.lit("unknown"), F.lit("partial_parse")))
        .otherwise(make(F.lit(0), F.lit(None).cast("int"), F.lit("error"), F.concat(F.lit("parse_error: "), F.substring(raw, 1, 80))))
    )


def _verdict(yes: Column, no: Column) -> Column:
    return (
        F.when(yes + no >= 2, F.when(yes >= 2, "match").when(no >= 2, "mismatch").otherwise("disagree"))
        .when(yes == 1, "match").when(no == 1, "mismatch").otherwise("error"))


def vote_consensus(votes: DataFrame, without_reference: DataFrame | None = None) -> DataFrame:
    """Consensus per annotation of long-format votes ``ann_id, voter, vote``; NULL is no vote."""
    counts = votes.groupBy("ann_id").agg(
        F.count_if(F.coalesce("vote", F.lit(False))).alias("yes"), F.count_if(F.coalesce(~F.col("vote"), F.lit(False))).alias("no"))
    out = counts.select("ann_id", "yes", "no", _verdict(F.col("yes"), F.col("no")).alias("consensus"))
    if without_reference is None:
        return out
    none = without_reference.select("ann_id", F.lit(True).alias("_none"))
    return out.join(none, "ann_id", "left").select(
        "ann_id", "yes", "no", F.when(F.col("_none"), "no_ref").otherwise(F.col("consensus")).alias("consensus"))


def vote_consensus_wide(*votes: Column) -> Column:
    """The same for one boolean column per voter."""
    count = lambda want: sum((F.when(v == F.lit(want), 1).otherwise(0) for v in votes), F.lit(0))
    return _verdict(count(True), count(False))


def resolve_choice(cat_id: Column, choice: Column, candidates: Column) -> Column:
    """Class of the chosen option where the answer named an option but no class."""
    ok = cat_id.isNull() & (choice > 0) & (choice <= F.size(candidates))
    return F.when(ok, F.try_element_at(candidates, F.greatest(choice, F.lit(1)))).otherwise(cat_id)


def relabel_consensus(votes: DataFrame, skip_zero: bool = True) -> DataFrame:
    """Most-voted class per annotation (``ann_id, voter, cat_id``); first voter breaks ties.

    Two equal votes agree, a single best vote is a split. ``skip_zero`` ignores class 0.
    """
    valid = F.col("cat_id").isNotNull() & (F.col("cat_id") != 0 if skip_zero else F.lit(True))
    counts = votes.where(valid).groupBy("ann_id", "cat_id").agg(F.count("*").alias("n"), F.min("voter").alias("first"))
    best = counts.groupBy("ann_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "first", "cat_id")).alias("b"))
    every = votes.select("ann_id").distinct()
    n = F.coalesce(-F.col("b.k"), F.lit(0))
    return every.join(best, "ann_id", "left").select(
        "ann_id", n.alias("vote_count"), F.col("b.cat_id").alias("best_cat"),
        F.when(n >= 2, "agree").when(n == 1, "split").otherwise("none").alias("consensus"),
        F.when(n >= 2, F.col("b.cat_id")).alias("new_cat"))


def consensus_summary(results: DataFrame) -> DataFrame:
    counts = results.groupBy("consensus").agg(F.count("*").alias("n"))
    total = results.agg(F.count("*")).scalar()
    return counts.select("consensus", "n", (F.lit(100.0) * F.col("n") / total).alias("percent")).orderBy(F.col("n").desc(), F.col("consensus").asc())


def disagreements(results: DataFrame, k: int = 20) -> DataFrame:
    return results.where(F.col("consensus") == "disagree").orderBy("ann_id").limit(k)


def agreed_corrections(relabels: DataFrame, anns: DataFrame) -> DataFrame:
    agreed = relabels.where(F.col("consensus") == "agree").select("ann_id", "new_cat")
    return agreed.join(anns.select("ann_id", F.col("category_id").alias("old_cat")), "ann_id").select("ann_id", "old_cat", "new_cat")


def suspicious(sims: DataFrame, min_suspicion: float, k: int | None = None) -> DataFrame:
    rows = sims.where(F.col("suspicion") >= min_suspicion)
    ordered = rows.orderBy(F.col("suspicion").desc(), F.col("ann_id").asc())
    return ordered.limit(k) if k is not None else ordered


def unprocessed(candidates: DataFrame, done: DataFrame) -> DataFrame:
    return candidates.join(done.select("ann_id"), "ann_id", "left_anti")


def _image_classes(anns: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent classes per image as one short array, and where class 0 stands."""
    counts = anns.groupBy("image_id", "category_id").agg(F.count("*").alias("n"), F.min("ann_id").alias("first"))
    ranks = W.partitionBy("image_id").orderBy(F.col("n").desc(), F.col("first").asc())
    top = counts.withColumn("r", F.row_number().over(ranks)).where(F.col("r") <= k)
    return top.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("r", F.col("category_id").alias("c"), "n"))).alias("classes"))


def cooccurring_categories(items: DataFrame, anns: DataFrame, k: int = 5) -> DataFrame:
    """Up to ``k`` other classes of the same image per item, most frequent first.

    ``items``: ``ann_id, image_id, gt_cat``. One class more than needed is kept per image, so
    the own class can be removed later and items never meet all boxes of their image.
    """
    rows = items.select("ann_id", "image_id", "gt_cat").join(_image_classes(anns, k + 1), "image_id")
    others = F.slice(F.filter("classes", lambda s: s["c"] != F.col("gt_cat")), 1, k)
    return rows.select("ann_id", "gt_cat", F.posexplode(others).alias("pos", "o")).select(
        "ann_id", "gt_cat", (F.col("pos") + 1).alias("rank"), F.col("o.c").alias("category_id"), F.col("o.n").alias("n"))


def relabel_candidates(
    sims: DataFrame, anns: DataFrame, references: DataFrame, limit: int = 8, k: int = 5, skip_zero: bool = True
) -> DataFrame:
    """Ordered candidate classes per item: similar classes first, then co-occurring ones.

    The own class and classes without a reference are left out. With ``skip_zero`` class 0 is
    passed over among the similar ones; it then enters only through co-occurrence, behind the
    others when it is not among the ``k`` most frequent. Items nothing remains for give no row.
    """
    nearby = cooccurring_categories(sims, anns, k).select("ann_id", F.col("category_id").alias("cat_id"), (F.col("rank") + 3).alias("pos"))
    similar = sims.select("ann_id", "gt_cat", F.posexplode(F.array("top1_cat", "top2_cat", "top3_cat")).alias("pos", "cat_id"))
    wanted = similar.where((F.col("cat_id") != F.col("gt_cat")) & F.col("cat_id").isNotNull())
    parts = wanted.where(F.col("cat_id") != 0) if skip_zero else wanted
    parts = parts.select("ann_id", "cat_id", "pos").unionByName(nearby)
    if skip_zero:
        holds_zero = anns.where(F.col("category_id") == 0).select("image_id").distinct()
        late = wanted.where(F.col("cat_id") == 0).select("ann_id").distinct().join(
            sims.select("ann_id", "image_id"), "ann_id").join(holds_zero, "image_id", "left_semi")
        parts = parts.unionByName(late.select("ann_id", F.lit(0).alias("cat_id"), F.lit(1000).alias("pos")))
    known = parts.join(references.select(F.col("category_id").alias("cat_id")).distinct(), "cat_id", "left_semi")
    first = known.groupBy("ann_id", "cat_id").agg(F.min("pos").alias("pos"))
    ordered = W.partitionBy("ann_id").orderBy("pos", "cat_id")
    return first.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= limit).select("ann_id", "rank", "cat_id")


def without_candidates(sims: DataFrame, candidates: DataFrame) -> DataFrame:
    return sims.join(candidates.select("ann_id"), "ann_id", "left_anti").select("ann_id", F.lit("no_candidates").alias("consensus"))


def reference_code(cats: DataFrame, product_map: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Reference code per class: product metadata first, the catalogue's number only where that has none."""
    meta = product_map.select("category_id", F.col("product_code").alias("meta_code"))
    api = reconciled.select("category_id", "api_ean")
    return cats.select("category_id").join(meta, "category_id", "left").join(api, "category_id", "left").select(
        "category_id", F.coalesce("meta_code", F.when(F.col("api_ean") != "", F.col("api_ean"))).alias("code"))


def review_summary(reviews: DataFrame) -> DataFrame:
    """Totals of reviewed items ``ann_id, verdict, new_cat``."""
    v = F.col("verdict")
    return reviews.agg(
        F.count_if(v.isNotNull()).alias("reviewed"), F.count_if(v == "correct").alias("correct"), F.count_if(v == "wrong").alias("wrong"),
        F.count_if((v == "wrong") & F.col("new_cat").isNotNull()).alias("corrections"))
