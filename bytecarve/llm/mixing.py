r"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words; the expected copies of its documents follow from it, a little
more for longer ones (the inclusion odds are unequal), three at most. The whole part of the copies is
allocated for certain. For the rest the documents of a source are ranked by their random odds divided by
their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the remaining words are spent.

The cut in the ranking is found by prefix sums over narrow slices of it, so no source, however large, is
sorted in one task: only the one slice per source in which the words run out is walked row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, uniform, work_dir

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3.0
SEED = 20_240
#: Rows of a slice of the ranking, on average.
SLICE_ROWS = 1000
#: Slices whose sums are taken together.
PAGE = 1000
#: Plan rows (sources times length classes) up to which the plan is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 50_000


def fill(total: float, weights: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Shares of ``total`` by weight, none above its cap; what exceeds a cap goes to the others by weight."""
    out = np.zeros(len(weights))
    free = np.ones(len(weights), bool)
    while free.any():
        rest = max(0.0, total - out[~free].sum())
        share = rest * weights / weights[free].sum()
        over = free & (share > caps)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = caps[over]
        free &= ~over
    return out


def plan(groups: pd.DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> pd.DataFrame:
    """``groups``: source, length_class, n, words. Adds source_size, target, whole (copies for certain), p
    (inclusion probability of one more), rest (words still to take), shift and slices of the ranking."""
    groups = groups.copy()
    names = sorted(groups.source.dropna().unique()) + ([None] if groups.source.isna().any() else [])
    key = groups.source.map({n: k for k, n in enumerate(names)}).fillna(len(names) - 1).astype(int).to_numpy()
    size = np.bincount(key, weights=groups.words, minlength=len(names))
    target = fill(float(size.sum()), np.array([weights[k % len(weights)] for k in range(len(names))]), most * size)
    copies = np.zeros(len(groups))
    by_source = np.argsort(key, kind="stable")
    for k, at in enumerate(np.split(by_source, np.cumsum(np.bincount(key, minlength=len(names)))[:-1]) if len(names) else ()):
        words = groups.words.to_numpy(float)[at]
        affinity = 1 + groups.length_class.to_numpy(float)[at] / 32
        got = fill(float(target[k]), affinity * words, most * words) if words.sum() else words
        copies[at] = np.divide(got, words, out=np.zeros(len(at)), where=words > 0)
    whole = np.floor(copies + 1e-9)
    p = np.clip(copies - whole, 0, None)
    p[p < 1e-9] = 0
    words = groups.words.to_numpy(float)
    rest = np.round(target - np.bincount(key, weights=whole * words, minlength=len(names)))
    drawn = p > 0
    n = np.bincount(key, weights=groups.n * drawn, minlength=len(names))
    mean = np.bincount(key, weights=p * groups.n, minlength=len(names)) / np.maximum(n, 1)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return groups.assign(source_size=size[key].astype(np.int64), target=target[key], whole=whole.astype(np.int64), p=p, rest=np.maximum(rest, 0)[key].astype(np.int64), shift=np.log(mean / (1 - mean))[key], slices=np.maximum(1, np.ceil(n / SLICE_ROWS)).astype(np.int64)[key])


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The slice in which a source's words run out: in rank order, what still fits; the last one if nearer."""
    rows = rows.sort_values(["order", "doc_id", "size"], na_position="first")
    left = int(rows.left.iloc[0])
    taken = np.zeros(len(rows), bool)
    size = rows["size"].to_numpy()
    for k, n in enumerate(size):
        if n <= left:
            taken[k] = True
            left -= n
    skipped = np.flatnonzero(~taken)
    if len(skipped):
        k = skipped[np.argmin(size[skipped])]
        if 2 * left > size[k]:
            taken[k] = True
    return rows.assign(taken=taken)[["row", "taken"]]


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text, source): doc_id, source, size, source_size long,
    target double, copies long, taken long (copies * size), row long (any numbers), text_key long (xxhash64 of the text).

    Sources in code-point order, null last, weigh ``weights`` in turn. A null or empty text has size 0 and is taken
    0 times (0 words). Repeated rows count and are drawn as often as they occur, with the same random odds; ties in the
    ranking go to the smaller doc_id, null first. The draw depends on doc_id and ``seed`` alone. Other columns are ignored.
    """
    spark = documents.sparkSession
    base = work_dir(spark, "mixing")
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    docs = materialise(docs.withColumn("row", F.monotonically_increasing_id()), f"{base}/sizes")
    docs = docs.withColumn("length_class", F.when(F.col("size") > 0, F.floor(F.log2(F.greatest("size", F.lit(1))))).otherwise(0).cast("int"))
    groups = docs.groupBy("source", "length_class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    made = plan(groups.orderBy("source", "length_class").toPandas(), weights, most)
    made = made.astype(object).where(made.notna(), None)
    ddl = "p_source string, p_class int, source_size long, target double, whole long, p double, rest long, shift double, slices long"
    columns = ["source", "length_class", "source_size", "target", "whole", "p", "rest", "shift", "slices"]
    steps = spark.createDataFrame([tuple(r) for r in made[columns].itertuples(index=False)], ddl)
    if len(made) <= BROADCAST_ROWS:
        steps = F.broadcast(steps)
    docs = docs.join(steps, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("length_class") == F.col("p_class")))
    u = uniform(F.col("doc_id"), seed)
    drawn = (F.col("p") > 0) & (F.col("size") > 0)
    order = F.when(drawn, F.log(u / (1 - u)) - F.log(F.col("p") / (1 - F.col("p"))))
    docs = docs.withColumn("order", order)
    place = 1 / (1 + F.exp(-(F.col("order") + F.col("shift"))))
    docs = docs.withColumn("slice", F.when(drawn, F.least(F.floor(place * F.col("slices")), F.col("slices") - 1).cast("long")))
    docs = materialise(docs, f"{base}/ranked")

    # prefix sums in two levels, so that not even the slices of a hot source meet in one task
    slices = docs.where("slice is not null").groupBy("source", "slice", "rest").agg(F.sum("size").alias("words")).withColumn("page", F.floor(F.col("slice") / PAGE))
    slices = materialise(slices, f"{base}/words")
    earlier = (Window.unboundedPreceding, -1)
    pages = slices.groupBy("source", "page").agg(F.sum("words").alias("w"))
    pages = pages.select(F.col("source").alias("g_source"), F.col("page").alias("g_page"), F.coalesce(F.sum("w").over(Window.partitionBy("source").orderBy("page").rowsBetween(*earlier)), F.lit(0)).alias("g_before"))
    inside = F.coalesce(F.sum("words").over(Window.partitionBy("source", "page").orderBy("slice").rowsBetween(*earlier)), F.lit(0))
    slices = slices.withColumn("inside", inside).join(pages.hint("merge"), F.col("source").eqNullSafe(F.col("g_source")) & (F.col("page") == F.col("g_page")))
    slices = slices.withColumn("before", F.col("g_before") + F.col("inside"))
    state = slices.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), (F.col("rest") - F.col("before")).alias("left"), (F.col("before") + F.col("words") <= F.col("rest")).alias("all"))
    state = materialise(state, f"{base}/slices")
    edge = state.where(~F.col("all") & (F.col("left") > 0))
    on = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice"))
    walked = docs.join(edge, on).select("source", "row", "doc_id", "size", "order", "left").groupBy("source").applyInPandas(_walk, "row long, taken boolean")
    walked = materialise(walked.where("taken").select(F.col("row").alias("w_row")), f"{base}/walked")
    first = state.where(~F.col("all")).groupBy("s_source").agg(F.min("s_slice").alias("stop")).withColumnRenamed("s_source", "f_source")
    docs = docs.join(first, F.col("source").eqNullSafe(F.col("f_source")), "left").join(walked, F.col("row") == F.col("w_row"), "left")
    more = F.when(F.col("slice").isNotNull() & (F.col("stop").isNull() | (F.col("slice") < F.col("stop")) | F.col("w_row").isNotNull()), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("whole") + more).otherwise(0).cast("long")
    return docs.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row", "text_key")
