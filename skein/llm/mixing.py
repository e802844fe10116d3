"""Mixing sources to target weights: Pareto order sampling with certain whole copies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

BEFORE = (Window.unboundedPreceding, -1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target, n for each source of sizes (source, size).

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes; no target
    exceeds `most` times its source's size, the excess going to the others by weight. One row a source is sorted in one
    task; documents are not."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    step = (F.row_number().over(order) - 1) % len(weights)
    ranked = sums.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (step + 1).cast("int")).cast("long"))
    fill = Window.orderBy(F.col("source_size") * 10 / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = ranked.withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(most * F.sum("source_size").over(fill.rowsBetween(*BEFORE)), F.lit(0)))
    ranked = ranked.withColumn("free", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("full", F.col("left") * F.col("w") >= F.col("free") * most * F.col("source_size"))
    level = F.first(F.when(~F.col("full"), F.col("left") / F.col("free")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(level * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target"), "n")


def _drawn(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, salt: str, per_bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes, targets, and for each document with words its certain copies, rank q (null if all is certain) and bucket."""
    sizes = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    sizes = sizes.withColumn("bits", F.length(F.bin("size")))
    goal = materialise(source_targets(sizes, weights, share, most)).toDF("g_source", "source_size", "target", "n")
    classes = sizes.where("size > 0").groupBy("source", "bits").agg(F.sum("size").alias("s"), F.count("*").alias("docs")).toDF("c_source", "bits", "s", "docs")
    down = Window.partitionBy("c_source").orderBy(F.col("bits").desc())
    classes = classes.join(goal, F.col("c_source").eqNullSafe(F.col("g_source"))).withColumn("w", F.col("bits") + 8)
    classes = classes.withColumn("left", F.col("target") - F.coalesce(most * F.sum("s").over(down.rowsBetween(*BEFORE)), F.lit(0)))
    classes = classes.withColumn("mass", F.sum(F.col("w") * F.col("s")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    classes = classes.withColumn("full", F.col("left") * F.col("w") >= F.col("mass") * most)
    level = F.first(F.when(~F.col("full"), F.col("left") / F.col("mass")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    classes = classes.withColumn("copies", F.when(F.col("full"), F.lit(float(most))).otherwise(level * F.col("w")))
    classes = classes.withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    lack = F.round("target").cast("long") - F.sum(F.col("whole") * F.col("s")).over(Window.partitionBy("c_source"))
    own = Window.partitionBy("c_source")
    drawn_docs = F.when(F.col("p") > 0, F.col("docs"))
    classes = classes.withColumn("lack", lack).withColumn("share", drawn_docs / F.sum(drawn_docs).over(own))
    classes = classes.withColumn("every", F.sort_array(F.collect_list(F.when(F.col("p") > 0, F.struct("bits", "p", "share"))).over(own)))
    classes = classes.select("c_source", F.col("bits").alias("c_bits"), "whole", "p", "lack", "every", F.greatest(F.lit(1), F.ceil(F.col("n") / per_bucket)).alias("buckets"))

    odds = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":" + salt))), 1, 13), 16, 10).cast("double") + 0.5) / 4503599627370496.0
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bits") == F.col("c_bits"))
    drawn = sizes.where("size > 0").join(classes, same).withColumn("u", odds)
    drawn = drawn.withColumn("q", F.when(F.col("p") > 0, F.col("u") / (1.0 - F.col("u")) * ((1.0 - F.col("p")) / F.col("p"))))
    # the share of the source's documents that are expected before q; each term rises with q, in floating point as well
    below = F.aggregate("every", F.lit(0.0), lambda acc, c: acc + c["share"] * (1.0 - 1.0 / (1.0 + F.col("q") * (c["p"] / (1.0 - c["p"])))))
    drawn = drawn.withColumn("bucket", F.least(F.col("buckets") - 1, F.floor(below * F.col("buckets"))))
    drawn = drawn.select("doc_id", "source", "size", "whole", "lack", "q", "bucket")
    return sizes, goal, drawn


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, salt: str = "mix", per_bucket: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target, whole, taken for each row of docs (doc_id, text, source).

    Expected copies of a document rise with its length class (weight 8 + bits of its size), are scaled to its source's
    target and stop at `most`. Their whole part is taken for certain. For the rest, documents are ranked by
    u/(1-u) * (1-p)/p, u a hash of doc_id and p the fraction, and taken in that order until the source has its words;
    the last one gives only the words still missing. Prefix sums over buckets of the rank, about per_bucket documents
    each, keep a hot source from landing in one task; the buckets are cut where the rank's distribution, which the
    classes' fractions give, has equal shares. Null texts and texts without words have size 0 and taken 0; very long texts
    only count; a null source is a source, a null doc_id hashes as 'null'; equal ranks are ordered by doc_id and size, and
    rows that repeat both are interchangeable; repeated rows are documents of their own; an empty table gives an empty
    table; other columns are ignored. Reruns agree."""
    sizes, goal, drawn = _drawn(docs, weights, share, most, salt, per_bucket)
    ranked, rest = drawn.where("q is not null"), drawn.where("q is null")
    before = Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(*BEFORE)
    offsets = ranked.groupBy(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket")).agg(F.sum("size").alias("s"))
    offsets = offsets.select("b_source", "b_bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("q", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(*BEFORE)
    ranked = ranked.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("lack") - F.col("offset") - F.col("ahead")))
    taken = ranked.select("doc_id", "source", "size", "whole", (F.col("whole") * F.col("size") + extra).alias("taken"))
    taken = taken.union(rest.select("doc_id", "source", "size", "whole", F.col("whole") * F.col("size")))
    taken = taken.union(sizes.where("size = 0").select("doc_id", "source", "size", F.lit(0), F.lit(0)))
    out = taken.join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    return out.select("doc_id", "source", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", F.col("whole").cast("long"), F.col("taken").cast("long"))
