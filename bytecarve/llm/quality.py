r"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are fitted here (histogram splits, logistic loss, monotone constraints on chosen features)
on at most FIT_ROWS labelled documents, those with the least hash of doc_id, and flattened into numpy
node arrays that score whole batches. The statistics of every document come from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .shared import limit_arrow, materialise, work_dir

#: Most labelled documents that the trees are fitted on.
FIT_ROWS = 20_000
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
TREES, DEPTH, BINS, RATE, LEAF_ROWS = 60, 3, 32, 0.2, 20
#: A document that passes the base rules is kept if its probability of good quality is at least this.
KEEP_AT = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct", "n_same_next", "n_one_char"]


def statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every document over its whole text (see STATS)."""
    n = len(off) - 1
    w0, w1, doc = T.words(buf, off)
    h = T.span_hash(buf, w0, w1)

    def of(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[off[1:]] - total[off[:-1]]

    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": of(~T.SPACE[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": of(_SYMBOL[buf])}
    l0, l1, ldoc = T.lines(buf, off)
    has = np.searchsorted(w0, l1) > np.searchsorted(w0, l0)
    lh, ld = T.span_hash(buf, l0[has], l1[has]), ldoc[has]
    key = np.sort(T.salted(lh, ld))
    distinct = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    # the owner of each distinct line: salted keys do not carry it, so sort once more with owners
    order = np.argsort(T.salted(lh, ld), kind="stable")
    out["n_dup_lines"] = np.bincount(ld, minlength=n) - np.bincount(ld[order][distinct], minlength=n)
    g, at = T.grams(h, doc, WINDOW)
    twice = at[T.repeated(T.salted(g, doc[at]))]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    out["n_lines"] = np.bincount(ld, minlength=n)
    out["n_upper"] = of((buf >= 65) & (buf <= 90))
    out["n_digits"] = of((buf >= 48) & (buf <= 57))
    out["n_punct"] = of(((buf >= 33) & (buf <= 47)) | ((buf >= 58) & (buf <= 64)) | ((buf >= 91) & (buf <= 96)) | ((buf >= 123) & (buf <= 126)))
    s = T.salted(h, doc)
    order = np.argsort(s, kind="stable")
    fresh = np.concatenate([[True], s[order][1:] != s[order][:-1]]) if len(s) else np.zeros(0, bool)
    out["n_distinct"] = np.bincount(doc[order][fresh], minlength=n)
    out["n_same_next"] = np.bincount(doc[1:][s[1:] == s[:-1]], minlength=n) if len(s) else np.zeros(n, int)
    out["n_one_char"] = np.bincount(doc[(w1 - w0) == 1], minlength=n)
    return {k: out[k].astype(np.int64) for k in STATS}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off, _ = T.utf8(batch.column("text"))
        for i, j in T.slices(off):
            s = statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), *[pa.array(s[k]) for k in STATS]], ["doc_id", "text_key", *STATS])


#: Features of the trees; the sign says how the probability of good quality may move with them (0: freely).
FEATURES = {"log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": 0, "digits": 0, "punct": 0, "distinct": 0, "same_next": -1, "one_char": 0, "words_per_line": 0}


def features(s: dict) -> np.ndarray:
    """(rows, len(FEATURES)) ratios of the statistics."""
    a = {k: np.asarray(s[k], dtype=float) for k in STATS}
    words, chars, lines = np.maximum(a["n_words"], 1), np.maximum(a["word_chars"], 1), np.maximum(a["n_lines"], 1)
    cols = [np.log1p(a["n_words"]), chars / words, a["n_symbols"] / chars, a["n_dup_lines"] / lines, a["n_repeat_words"] / words, a["n_upper"] / chars, a["n_digits"] / chars, a["n_punct"] / chars, a["n_distinct"] / words**0.8, a["n_same_next"] / words, a["n_one_char"] / words, a["n_words"] / lines]
    return np.stack(cols, 1)


@dataclass
class Trees:
    """Flat node arrays of all trees: children of node i are left[i] and right[i]; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            margin += self.value[at]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for P(y = 1); ``signs`` constrain the direction of each feature's effect."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(value)
        feature.append(0)
        threshold.append(0.0)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = grad[rows].sum(), hess[rows].sum()
        mine = float(np.clip(-gs / (hs + 1), low, high))
        k = node(mine * rate)
        if level == depth or len(rows) < 2 * LEAF_ROWS:
            return k
        best = (1e-6, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = code[rows, f]
            g = np.cumsum(np.bincount(b, weights=grad[rows], minlength=len(c) + 1))[:-1]
            h = np.cumsum(np.bincount(b, weights=hess[rows], minlength=len(c) + 1))[:-1]
            m = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            vl, vr = np.clip(-g / (h + 1), low, high), np.clip(-(gs - g) / (hs - h + 1), low, high)
            gain = -(g * vl + 0.5 * (h + 1) * vl**2) - ((gs - g) * vr + 0.5 * (hs - h + 1) * vr**2) + (gs * mine + 0.5 * (hs + 1) * mine**2)
            bad = (m < LEAF_ROWS) | (len(rows) - m < LEAF_ROWS)
            if signs[f]:
                bad |= (vr - vl) * signs[f] < 0
            gain[bad] = -np.inf
            if len(gain) and gain.max() > best[0]:
                t = int(gain.argmax())
                best = (gain[t], (f, t, vl[t], vr[t]))
        if best[1] is None:
            return k
        f, t, vl, vr = best[1]
        goes = code[rows, f] <= t
        bounds = [(low, high), (low, high)]
        if signs[f]:
            mid = (vl + vr) / 2
            bounds = [(low, mid), (mid, high)] if signs[f] > 0 else [(mid, high), (low, mid)]
        feature[k], threshold[k] = f, float(cuts[f][t])
        left[k] = grow(rows[goes], level + 1, *bounds[0])
        right[k] = grow(rows[~goes], level + 1, *bounds[1])
        return k

    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = q - y, q * (1 - q)
        root = grow(np.arange(len(y)), 0, -np.inf, np.inf)
        roots.append(root)
        t = Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array([root]), 0.0, depth)
        margin += np.log(np.clip((s := t.score(x)), 1e-12, 1) / np.clip(1 - s, 1e-12, 1))
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), base, depth)


def fit_labelled(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees | None:
    """Trees from the ``quality`` (1 good, 0 bad) of labelled documents; None if one of the classes is missing."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # one row per label, whatever rows repeat a doc_id
    least = stats.join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*STATS)).alias("s"))
    rows = least.select("doc_id", "quality", "s.*").orderBy("doc_id").toPandas()
    if rows.quality.nunique() < 2:
        return None
    return fit(features(rows), rows.quality.to_numpy(float), list(FEATURES.values()))


def judge(documents: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``documents``: doc_id, text_key (xxhash64 of the text), the counts in STATS (long),
    base_failed, kept (boolean), quality (double).

    A null or empty text has no words and fails the base rules. Repeated rows give repeated rows; a null doc_id
    stays null (such rows carry no label). Extra columns are ignored. Without labels of both classes the
    base rules alone decide and quality is null. Of several labels of one document the worst counts, of several rows
    with one labelled doc_id the one with the least statistics.
    """
    spark = documents.sparkSession
    limit_arrow(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    stats = texts.mapInArrow(_measure, ", ".join(["doc_id long", "text_key long", *[f"{k} long" for k in STATS]]))
    stats = materialise(stats, work_dir(spark, "quality"))
    trees = fit_labelled(stats, labels, fit_rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    if trees is None:
        return stats.withColumn("kept", ~F.col("base_failed")).withColumn("quality", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def quality(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(trees.score(features(rows)))

    return stats.withColumn("quality", quality(F.struct(*STATS))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
