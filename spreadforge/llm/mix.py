"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; a document's expected copies are
its source's target divided by its source's size.  Within a source, documents
are put in a fixed order, their expected copies are summed up from the first,
one offset is added, and a document is emitted once for every integer that its
part of the sum crosses.  Ordered by size, so each size class is hit in
proportion and the words taken stay within about one document of the target.

The prefix sum is distributed: counts by (source, size, bucket) are summed in
small tables; documents are only ranked within (source, size, bucket), so a
source with a third of all rows never meets in one task.  The table of sources
itself is ordered in one task; it has a row per source.

Defined results: a null text has size 0 and so takes 0 words; null sources form
one source, last in order; repeated rows are separate documents of equal size;
an empty table gives an empty mix; other columns are kept or ignored."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadforge.llm.tables import fresh, materialize, row_id, shuffled

#: fixed values: weights by position in the order of sources, repeating
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKETS = 64
SEED = 17


def size_of(text: Column) -> Column:
    """Number of words, a word being a run without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def offset_of(source: Column, seed: int = SEED) -> Column:
    """The source's offset in [0, 1), from a hash of its name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` from a table of ``source, size``.

    A target is ``min(max_copies * size, level * weight)`` with one level for
    which the targets add up to all sizes; that is where resharing the excess
    ends.  Sources stop in the order of ``max_copies * size / weight``."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source: ordering them in one task is bounded by the catalogue
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("w", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    cap = F.col("source_size") * F.lit(float(max_copies))
    s = s.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("w_capped", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
         .withColumn("level", (F.sum("source_size").over(every).cast("double") - F.col("capped"))
                     / (F.sum("w").over(every) - F.col("w_capped"))))
    # the first source in this order that the level reaches sets it for all behind
    s = s.withColumn("open", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every))
    level = F.col("open.level")
    return s.select("source", "source_size", F.when((F.col("ratio") < F.col("open.ratio")) | level.isNull(), F.col("cap"))
                    .otherwise(F.least(F.col("cap"), level * F.col("w"))).alias("target"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """Per document row: ``doc_id, row (its identity), nth (among repeated
    rows), size, source, source_size, target, copies``."""
    light = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                                    F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
                                    row_id("doc_id", "source", "text").alias("row"))
                        .withColumn("bucket", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(BUCKETS))))
    cell = ["source", "size", "bucket"]
    n = light.groupBy(*cell).agg(F.count("*").alias("n"))
    n = materialize(n)
    up_to = (Window.unboundedPreceding, -1)
    by_size = (n.groupBy("source", "size").agg(F.sum("n").alias("m"))
               .withColumn("below", F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("size").rowsBetween(*up_to)), F.lit(0)))
               .select(F.col("source").alias("s1"), F.col("size").alias("z1"), "below"))
    inner = n.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(*up_to)), F.lit(0)))
    start = (inner.join(by_size, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1")))
             .select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("bucket").alias("b2"),
                     (F.col("below") + F.col("before")).alias("start")))
    goal = targets(n.select("source", (F.col("size") * F.col("n")).alias("size")), weights, max_copies)
    start = (start.join(goal, F.col("s2").eqNullSafe(F.col("source")))
             .select("s2", "z2", "b2", "start", "source_size", "target",
                     # a source of any length has one rate: target / size
                     F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
                     offset_of(F.col("source"), seed).alias("offset")))
    nth = Window.partitionBy("row").orderBy(F.lit(1))
    rank = Window.partitionBy(*cell).orderBy("doc_id", "digest")
    ranked = light.withColumn("rank", F.row_number().over(rank)).withColumn("nth", F.row_number().over(nth))
    at = F.col("start") + F.col("rank")
    crossed = F.floor(at * F.col("rate") + F.col("offset")) - F.floor((at - 1) * F.col("rate") + F.col("offset"))
    return (ranked.join(start, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("bucket") == F.col("b2")))
            .select("doc_id", "row", "nth", "size", "source", "source_size", "target", crossed.cast("bigint").alias("copies")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was drawn, its columns and
    ``copy`` (1, 2, ...)."""
    key, nth, copy = fresh(docs, "mix_row"), fresh(docs, "mix_nth"), fresh(docs, "copy")
    drawn = materialize(copies(docs, **options).where("copies > 0").select(
        F.col("row.a").alias(key + "_a"), F.col("row.b").alias(key + "_b"), F.col("nth").alias(nth), F.col("copies").alias(copy)))
    keyed = (docs.withColumn(key, row_id("doc_id", "source", "text"))
             .withColumn(key + "_a", F.col(key + ".a")).withColumn(key + "_b", F.col(key + ".b")).drop(key))
    keyed = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(key + "_a", key + "_b").orderBy(F.lit(1))))
    return (keyed.join(shuffled(drawn), [key + "_a", key + "_b", nth])
            .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int"))).alias(copy)))
