"""Diverse selection, whose choices depend on earlier ones, and what concepts score.

Selection goes through all candidates in order. Candidates of one source alone limit each other by number and by
distance in the image, so that part runs for each source by itself; only what a source may contribute, a few rows, meets
in one place to be put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalars import clamp
from ..sources.scratch import cut
from .leaders import leader_clusters  # noqa: F401
from .neighbours import knn


def fits(p: pd.DataFrame, picks: list[dict], per_source: int, least_pixels: float, least_embedding: float | None, new_scale: bool) -> np.ndarray:
    """Which candidates the picks leave open."""
    open_, count = np.ones(len(p), bool), np.zeros(len(p), int)
    v = np.stack(p.v).astype(float) if least_embedding is not None and len(p) and picks else None
    for x in picks:
        same = (p.source == x["source"]).to_numpy() if x["source"] is not None else p.source.isna().to_numpy()
        count += same
        open_ &= (p.id != x["id"]).to_numpy() & ~(same & (np.hypot(p.cx - x["cx"], p.cy - x["cy"]).to_numpy() < least_pixels))
        if new_scale:
            open_ &= (p.of_scale != x["of_scale"]).to_numpy()
        if v is not None:
            open_ &= np.linalg.norm(v - np.asarray(x["v"], float), axis=1) >= least_embedding
    return open_ & (count < per_source)


def diverse(candidates: DataFrame, k: int, per_source: int = 3, least_pixels: float = 32.0, least_embedding: float | None = None, ahead: int = 1000) -> DataFrame:
    """position and the columns of candidates (id, source, x, y, scale, score, ... and w, h where sizes differ): picks by
    (-score, id) such that a source has at most per_source, its picks' centres lie least_pixels apart, and, if given, all
    picks' vectors least_embedding. With several scales a first pass takes one of each new scale; k picks in all.

    The first pass, and every pass with least_embedding, looks at the `ahead` best candidates that the picks leave open
    until none are left: what picks rule out stays ruled out. Otherwise the sources go on each by itself.
    """
    size = lambda c: F.col(c) / 2 if c in candidates.columns else F.lit(0.0)
    centres = ((F.col("x") + size("w")).cast("double").alias("cx"), (F.col("y") + size("h")).cast("double").alias("cy"))
    candidates = cut(candidates, "candidates")  # every pass reads them
    slim = candidates.select("id", "source", F.coalesce("scale", F.lit("single-scale")).alias("of_scale"), "score", *centres, *(["v"] if least_embedding is not None else []))
    picks: list[dict] = []

    def go_on(new_scale: bool) -> None:
        while len(picks) < k:
            known = list(picks)

            def left_open(parts):
                for p in parts:
                    yield p[fits(p, known, per_source, least_pixels, least_embedding, new_scale)]

            best = slim.mapInPandas(left_open, slim.schema).orderBy(F.desc("score"), "id").limit(ahead).toPandas()
            left = best
            while len(left) and len(picks) < k:
                picks.append(left.iloc[0].to_dict())
                left = left[fits(left, picks, per_source, least_pixels, least_embedding, new_scale)]
            if len(best) < ahead:
                break

    if slim.select("of_scale").distinct().limit(2).count() > 1:
        go_on(True)
    if least_embedding is not None:
        go_on(False)
    spark = candidates.sparkSession
    ids = candidates.select("id").schema
    lead = spark.createDataFrame([(x["id"], i) for i, x in enumerate(picks)], StructType([*ids.fields, StructField("_lead", IntegerType())]))  # k rows at most
    rows = candidates.select("id", "source", "score", *centres).join(F.broadcast(lead), "id", "left").withColumn("_lead", F.coalesce("_lead", F.lit(k)))

    def by_source(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept, any_ = None, [], False
        for p in parts:
            keep = np.zeros(len(p), bool)
            source = p.source.astype(object).where(p.source.notna(), None)
            for i, (s, first, x, y) in enumerate(zip(source, p._lead, p.cx, p.cy)):
                if not any_ or s != last:
                    last, kept, any_ = s, [], True
                if first < k or least_embedding is None and len(kept) < per_source and all(np.hypot(x - a, y - b) >= least_pixels for a, b in kept):
                    kept.append((x, y))
                    keep[i] = True
            yield p[keep]

    # sources come one after the other in their tasks: very many small ones pass without a group's cost for each
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "source").sortWithinPartitions("source", "_lead", F.desc("score"), "id")
    kept = rows.mapInPandas(by_source, rows.schema)
    order = ("_lead", F.desc("score"), "id")
    best = kept.orderBy(*order).limit(k).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    row = lambda of: F.struct(*[of(c) for c in ("id", "source", "score")], *[c if of is F.col else F.col(n) for c, n in zip(centres, ("_x", "_y"))])
    names = best.select(*[F.col(c).alias(f"_{c}") for c in ("id", "source", "score")], F.col("cx").alias("_x"), F.col("cy").alias("_y"), "position")
    picked = candidates.join(F.broadcast(names), row(F.col).eqNullSafe(row(lambda c: F.col(f"_{c}"))))
    return cut(picked.select(*candidates.columns, "position"), "picked")  # k rows; what follows reads them several times


def undiversified(candidates: DataFrame, k: int) -> DataFrame:
    """What selection gives when it is switched off: the k best by (-score, id), with position and reason."""
    best = candidates.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumn("reason", F.lit("high novelty"))


def scale_labels(patches: DataFrame) -> DataFrame:
    """One row: scales, the sorted names of the patches' scales."""
    return patches.select("scale").where("scale is not null").distinct().agg(F.array_sort(F.collect_list("scale")).alias("scales"))


def concept_scores(clustered: DataFrame, limit: int = 5, supporting: int = 5) -> DataFrame:
    """concept_id, size, parts and confidence of the concepts of highest mean score.

    Novelty is the mean over the concept's own largest score, or over 1 where that is smaller; support is full from
    `supporting` members on.
    """
    means = clustered.select("concept_id", F.posexplode("v").alias("i", "x")).groupBy("concept_id", "i").agg(F.avg("x").alias("m"))
    raw = means.groupBy("concept_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    g = clustered.join(raw, "concept_id").groupBy("concept_id").agg(F.count("*").alias("size"), F.avg("score").alias("mean_score"), F.max("score").alias("most"), F.avg(d).alias("spread"), F.count_distinct("source").alias("sources"), F.avg((F.size("v") > 0).cast("double")).alias("quality"))
    novelty = clamp(F.col("mean_score") / F.greatest("most", F.lit(1.0)))
    support = clamp(F.col("size") / F.lit(float(supporting)))
    consistency = F.when(F.col("size") <= 1, 1.0).otherwise(1 / (1 + F.col("spread")))
    diversity = F.col("sources") / F.col("size")
    confidence = 0.30 * novelty + 0.20 * support + 0.25 * consistency + 0.15 * diversity + 0.10 * F.col("quality")
    out = g.select("concept_id", "size", *[F.round(c, 6).alias(n) for n, c in (("mean_score", F.col("mean_score")), ("novelty", novelty), ("support", support), ("consistency", consistency), ("diversity", diversity), ("confidence", clamp(confidence)))])
    return out.orderBy(F.desc("mean_score"), "concept_id").limit(limit)


def confidences(evidence: DataFrame) -> DataFrame:
    """concept_id, confidence of (concept_id, average_novelty, example_count, consistency, final_confidence).

    A final_confidence is passed through, at most 1; without one novelty by the largest of all, count and consistency
    stand in.
    """
    top = evidence.agg(F.max("average_novelty").alias("_top"))
    share = F.col("average_novelty") / F.when(F.col("_top") != 0, F.col("_top")).otherwise(1.0)
    instead = 0.5 * share + 0.3 * F.least(F.col("example_count") / 5, F.lit(1.0)) + 0.2 * F.col("consistency")
    both = evidence.crossJoin(F.broadcast(top))  # one row
    return both.select("concept_id", F.round(F.least(F.coalesce("final_confidence", instead), F.lit(1.0)), 6).alias("confidence"))


def concept_neighbours(clustered: DataFrame, memory: DataFrame, k: int = 5, members: int = 5) -> DataFrame:
    """concept_id, query_id, id, distance, position: the k rows of memory nearest to a concept's best `members`.

    Rows that belong to the concept are no neighbours; ties go to the smaller id, then to the smaller query.
    """
    best = Window.partitionBy("concept_id").orderBy(F.desc("score"), "id")
    asking = clustered.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= members).select("id", "v", F.col("concept_id").alias("source"))
    own = clustered.select("id", F.col("concept_id").alias("source"))
    near = knn(asking, memory.select("id", "v").join(own, "id", "left"), k, exclude_same="source")
    near = near.join(asking.select(F.col("id").alias("query_id"), F.col("source").alias("concept_id")), "query_id")
    order = Window.partitionBy("concept_id").orderBy("distance", "id", "query_id")
    return near.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("concept_id", "query_id", "id", "distance", "position")


def evidence(clustered: DataFrame, k: int = 5, memory: DataFrame | None = None, neighbours: int = 5) -> DataFrame:
    """concept_id, representative, supporting (k best ids), sources, size; with a memory (id, v) also near_matches, the
    rows of it nearest to the supporting ones (id, query_id, distance), nearest first.

    Ranks beyond k are dropped in every task before rows of a concept meet; sizes and sources are counted apart, so a
    concept that holds most rows is never sorted as a whole.
    """
    w = Window.partitionBy("concept_id").orderBy(F.desc("score"), "id")
    best = clustered.select("concept_id", "id", "score").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    few = best.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("b"))  # k rows a concept
    sizes = clustered.groupBy("concept_id").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("size"))
    out = few.join(sizes, "concept_id").select("concept_id", F.col("b")[0]["id"].alias("representative"), F.transform("b", lambda s: s["id"]).alias("supporting"), "sources", "size")
    if memory is None:
        return out
    near = concept_neighbours(clustered, memory, neighbours, k)
    near = near.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "query_id", "distance"))).alias("n"))
    matches = F.transform("n", lambda s: F.struct(s["id"].alias("id"), s["query_id"].alias("query_id"), s["distance"].alias("distance")))
    none = F.array().cast("array<struct<id:bigint,query_id:bigint,distance:double>>")
    return out.join(near, "concept_id", "left").withColumn("near_matches", F.coalesce(matches, none)).drop("n")


def hypothesis(concept: str = "concept_id", size: str = "size"):
    return F.format_string("%s holds %d similar examples; check whether they share a cause.", F.col(concept), F.col(size))
