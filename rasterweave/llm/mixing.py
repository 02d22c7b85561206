"""Mixing sources to target weights by Pareto order sampling.

Each source's target is a share of all words, at most ``max_repeat`` times what the source holds. A document is
due ``target / source size`` copies: the whole part is certain, and the rest is an inclusion probability p.
Documents are ranked by the odds of a uniform number divided by the odds of p, and taken in that order until
their words fill what the certain copies left open, so the sample's size in words is fixed. The order is cut by
sums over narrow ranges of the rank first, so no task ranks a whole source. Last, the one open document whose
size comes nearest to the words still missing closes the gap.

Uniform numbers come from a hash of seed, id and size: reruns agree. Defined cases: null text has size 0; a null
source is a source of its own, after all others; a source without words has target 0; null ids take part;
rows that repeat an id are ranked alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.shared import free_names, materialize, named, sized_join, spread
from rasterweave.llm.textfn import filled, word_count

#: Ranges of the rank into which each source's words are summed.
RANK_BINS = 4096


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_repeat: float) -> DataFrame:
    """Adds ``target`` to (source, source_size). The table has a row per source; its windows see no document.

    Water-filling: with sources by limit / weight, the first ones whose limit is reached keep it, and the others
    share what is left by weight. This is where resharing the excess again and again ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sources.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    named = named.withColumn("most", F.col("source_size") * F.lit(float(max_repeat)))
    everything, order = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    level = F.col("most") / F.col("weight")
    filled_up = (
        named.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("given", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(onward))
        .withColumn("full", F.col("given") + level * F.col("open_weight") <= F.col("total"))
    )
    spent = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything)
    rest = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise((F.col("total") - spent) * F.col("weight") / rest)
    return filled_up.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    max_repeat: float = 3.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bins: int = RANK_BINS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken (copies * size)."""
    sized = spread(docs).select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(filled(F.col(text_col))).alias("size"))
    # 52 bits of md5, which every engine has, moved off 0 and 1.
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    sized = materialize(sized.withColumn("u", uniform), "mix-sizes")

    sources = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat), "mix-sources")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(due + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), due - F.col("whole")))
    sources = sources.withColumn("open_words", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumnRenamed("source", "__source")

    def with_source(df: DataFrame, per_source: DataFrame) -> DataFrame:
        return sized_join(df, per_source, df["source"].eqNullSafe(per_source["__source"]), "inner").drop("__source")

    odds = F.col("p") / (1 - F.col("p"))
    ranked = with_source(sized, sources).withColumn("rank", F.when(F.col("p") > 1e-9, F.col("u") / (1 - F.col("u")) / odds))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * bins))

    # Words before each range; the first range that passes the open words is cut row by row.
    per_bin = ranked.filter("rank is not null").groupBy("source", "open_words", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin")
    edges = per_bin.withColumn("upto", F.sum("words").over(upto)).filter("upto > open_words").groupBy("source").agg(F.min("bin").alias("edge"), F.min("upto").alias("edge_upto"))
    edge_words = per_bin.select("source", F.col("bin").alias("edge"), "words")
    edges = edges.join(edge_words, [edges["source"].eqNullSafe(edge_words["source"]), edges["edge"] == edge_words["edge"]]).select(
        edges["source"].alias("__source"), edges["edge"], (F.col("edge_upto") - F.col("words")).alias("edge_before")
    )
    edges = materialize(edges, "mix-edges")
    marked = sized_join(ranked, edges, ranked["source"].eqNullSafe(edges["__source"]), "left").drop("__source")
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    at_edge = marked.filter("bin = edge").withColumn("run", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    at_edge = at_edge.withColumn("chosen", F.col("edge_before") + F.col("run") <= F.col("open_words")).drop("run")
    chosen = F.col("rank").isNotNull() & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")))
    others = marked.filter("edge is null or bin is null or bin <> edge").withColumn("chosen", chosen)
    drawn = materialize(at_edge.unionByName(others).select("doc_id", "source", "size", "source_size", "target", "whole", "rank", "open_words", "chosen"), "mix-drawn")

    # The closing document of each source.
    gaps = drawn.groupBy("source", "open_words").agg(F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0)).alias("drawn_words"))
    gaps = gaps.select(F.col("source").alias("__source"), (F.col("open_words") - F.col("drawn_words")).alias("gap"))
    left = with_source(drawn.filter("not chosen and rank is not null and size > 0"), gaps.filter("gap > 0")).withColumn("off", F.abs(F.col("size") - F.col("gap"))).filter("off < gap")
    best = left.groupBy("source").agg(F.min(F.struct("off", "doc_id", "size")).alias("best"))
    best = materialize(best.select(F.col("source").alias("__source"), F.col("best.doc_id").alias("__close_id"), F.col("best.size").alias("__close_size"), F.lit(1).alias("__close")), "mix-close")
    closing = [drawn["source"].eqNullSafe(best["__source"]), drawn["doc_id"].eqNullSafe(best["__close_id"]), drawn["size"] == best["__close_size"]]
    out = sized_join(drawn, best, closing, "left")
    copies = (F.col("whole") + F.when(F.col("chosen"), 1).when(F.col("rank").isNotNull() & F.col("__close").isNotNull(), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies.

    Rows that agree in id, size and source are taken alike, each as often as the one of them with most copies; other
    columns may have any names; an empty table gives an empty one.
    """
    words, i, size, source, n, copy = free_names(docs.columns, "__words", "__id", "__size", "__source", "__copies", "__copy")
    copies = mix_sources(docs, **options).groupBy("doc_id", "size", "source").agg(F.max("copies").alias("copies")).filter("copies <> 1")
    copies = materialize(copies.toDF(i, size, source, n), "mix-copies")
    on = [named("doc_id").eqNullSafe(F.col(i)), F.col(words) == F.col(size), named("source").cast("string").eqNullSafe(F.col(source))]
    joined = sized_join(docs.withColumn(words, word_count(filled(named("text")))), copies, on, "left").withColumn(n, F.coalesce(n, F.lit(1)).cast("int"))
    repeated = joined.filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    return repeated.select(*[named(c) for c in docs.columns])
