"""MinHash near-duplicates of word-shingle multisets by BagMinHash signatures.

The weighted Jaccard similarity of two documents is that of their multisets of five-word shingles:
sum of least counts over sum of greatest counts. A document with one to four words has the one
shingle of all its words.

BagMinHash: on each of ``m`` signature components every shingle carries a Poisson process over its
weight axis. The axis is discretised into bands [0,1), [1,2), [2,4), [4,8), ...; the m processes
of a band are drawn as one process of m times its length, whose points carry a component and a
place on the weight axis. A point counts if its place lies below the shingle's weight, so a band
that the weight cuts is refined down to the unit interval in question. The least arrival time of
each component is its hash: two documents agree on it with probability equal to their weighted
Jaccard similarity. Points are drawn in order of time and only up to a horizon, which is pushed
out for documents that have components without a point.

Signatures are banded (20 bands of 4: a pair at similarity 0.8 meets with probability 0.99997). Members of
a bucket whose signatures agree on CUT components or more (a pair at 0.8 does but for one case in
ten million) are linked into groups of candidates; inside a group the exact multiset overlaps are accumulated
over posting lists of the shingles, and links at the threshold are united.

A group of over BLOCK members is first compared with one of its members, the pivot, as a star: each member's exact
similarity to it, in as many tasks as the group has blocks. Those at the threshold form one class. Only what is
left is compared with the rest, and with those of the class alone that the triangle inequality leaves open (one minus
the weighted Jaccard similarity is a metric): a member at similarity s to the pivot cannot be linked to one at over
s + 1 - threshold. So a group around one text costs as much as it has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .components import components
from .shared import hot_keys, limit_arrow, materialise, partitions_for, salted_join, work_dir

U64 = np.uint64
SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
#: Equal signature bytes, of BANDS * ROWS, from which two members of a bucket are candidates.
CUT = 45
#: Members up to which a bucket's signatures are compared in one task; of a larger one all are candidates of each other.
#: Candidates are never links: both are verified exactly.
BUCKET = 2048
#: Members of a group that are verified together.
BLOCK = 1024
_STREAM = U64(0xD1B54A32D192ED03)
_STEP = U64(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their documents, with repeats."""
    starts, ends, doc = T.words(buf, off)
    h = T.span_hash(buf, starts, ends)
    g, at = T.grams(h, doc, SHINGLE)
    d = doc[at]
    n = np.bincount(doc, minlength=len(off) - 1)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        first = np.searchsorted(doc, few)
        short = np.zeros(len(few), U64)
        for k in range(SHINGLE - 1):
            has = n[few] > k
            short[has] = T.mix(short[has] ^ h[first[has] + k]) + U64(k + 1)
        g, d = np.concatenate([g, short]), np.concatenate([d, few])
    return g, d


def multisets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, document) with counts, grouped in no particular order."""
    g, d = shingles(buf, off)
    if not len(g):
        return g, d, np.zeros(0, np.int64)
    order = np.argsort(T.salted(g, d))
    g, d = g[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]))
    return g[new], d[new], np.diff(np.append(new, len(g)))


def _unit(state: np.ndarray) -> np.ndarray:
    return ((T.mix(state) >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(g: np.ndarray, d: np.ndarray, weight: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(n_docs, m) arrival times; documents without shingles stay at infinity."""
    sig = np.full(n_docs * m, np.inf)
    if not len(g):
        return sig.reshape(n_docs, m)
    # one stream per (shingle, weight band)
    levels = [np.arange(len(g))]
    lows, sizes = [np.zeros(len(g))], [np.ones(len(g))]
    low = 1
    while True:
        e = np.flatnonzero(weight > low)
        if not len(e):
            break
        levels.append(e)
        lows.append(np.full(len(e), float(low)))
        sizes.append(np.full(len(e), float(low)))
        low *= 2
    element = np.concatenate(levels)
    low_at, size = np.concatenate(lows), np.concatenate(sizes)
    owner = d[element]
    state = T.mix(g[element] ^ T.mix(low_at.astype(U64) + _STREAM))
    rate = m * size
    time = -np.log(_unit(state)) / rate
    total = np.bincount(d, weights=weight, minlength=n_docs)
    horizon = (np.log(m) + 2.0) / np.maximum(total, 1)
    live = np.flatnonzero(time <= horizon[owner])
    while True:
        while len(live):
            state[live] += _STEP
            r = T.mix(state[live] ^ _STREAM)
            component = ((r >> U64(32)) % U64(m)).astype(np.int64)
            place = low_at[live] + size[live] * ((r & U64(0xFFFFFFFF)).astype(np.float64) / (1 << 32))
            ok = np.floor(place) < weight[element[live]]
            np.minimum.at(sig, owner[live][ok] * m + component[ok], time[live][ok])
            state[live] += _STEP
            time[live] -= np.log(_unit(state[live])) / rate[live]
            live = live[time[live] <= horizon[owner[live]]]
        short = np.isinf(sig.reshape(n_docs, m)).any(1) & (total > 0)
        if not short.any():
            return sig.reshape(n_docs, m)
        horizon[short] *= 1.6
        live = np.flatnonzero(short[owner] & (time <= horizon[owner]))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n_docs, BANDS) 64-bit keys of the bands."""
    bits = np.ascontiguousarray(sig).view(U64).reshape(len(sig), BANDS, ROWS)
    key = np.full((len(sig), BANDS), U64(1))
    for r in range(ROWS):
        key = T.mix(key ^ bits[:, :, r]) + U64(r)
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        buf, off, valid = T.utf8(column)
        for i, j in T.slices(off):
            o = off[i : j + 1] - off[i]
            b = buf[off[i] : off[j]]
            g, d, w = multisets(b, o)
            n = j - i
            sig = signatures(g, d, w, n)
            keys = band_keys(sig).astype(np.int64)
            full = np.bincount(d, minlength=n) > 0
            raw = b.tobytes()
            text_key = [hashlib.md5(raw[o[k] : o[k + 1]]).digest() if full[k] else None for k in range(n)]
            low = np.ascontiguousarray(T.mix(np.ascontiguousarray(sig).view(U64)).astype(np.uint8)[full])
            width = BANDS * ROWS
            sigs = pa.Array.from_buffers(pa.binary(), n, [pa.py_buffer(np.packbits(full, bitorder="little").tobytes()), pa.py_buffer((np.concatenate([[0], np.cumsum(full)]) * width).astype(np.int32).tobytes()), pa.py_buffer(low.tobytes())])
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]), pa.int32()), pa.array(keys[full].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n).cast(pa.int64()), pa.array(text_key, pa.binary()), bands, sigs], ["doc_id", "text_key", "bands", "sig"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, counts) multisets."""
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][ia], b[1][ib]).sum())
    union = int(a[1].sum()) + int(b[1].sum()) - least
    return least / union if union else 0.0


def _bags(column) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    buf, off, _ = T.utf8(column)
    for i, j in T.slices(off):
        g, d, w = multisets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        order = np.lexsort((g, d))
        g, d, w = g[order], d[order], w[order]
        cut = np.searchsorted(d, np.arange(j - i + 1))
        out += [(g[s:e], w[s:e]) for s, e in zip(cut[:-1], cut[1:])]
    return out


class Sets:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.count = n

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def unite(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.count -= 1
        return True


def links(bags: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the graph of all pairs of ``bags`` at ``threshold`` or more.

    Each bag in turn accumulates its exact overlap with every later one over the shingles' posting lists,
    until all are connected.
    """
    n = len(bags)
    owner = np.repeat(np.arange(n), [len(g) for g, _ in bags])
    g = np.concatenate([g for g, _ in bags])
    w = np.concatenate([w for _, w in bags])
    order = np.argsort(g, kind="stable")
    gs, owners, ws = g[order], owner[order], w[order]
    end = np.searchsorted(gs, g, side="right")
    place = np.empty(len(g), np.int64)
    place[order] = np.arange(len(g))
    total = np.bincount(owner, weights=w, minlength=n)
    cut = np.concatenate([[0], np.cumsum([len(x) for x, _ in bags])])
    sets, out = Sets(n), []
    for k in range(n - 1):
        if sets.count == 1:
            break
        mine = slice(cut[k], cut[k + 1])
        size = end[mine] - place[mine] - 1
        if not size.any():
            continue
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(place[mine] + 1 - begin, size)
        both = np.bincount(owners[at], weights=np.minimum(ws[at], np.repeat(w[mine], size)), minlength=n)
        near = np.flatnonzero((both > 0) & (both >= threshold * (total + total[k] - both) - 1e-9))
        out += [(k, int(j)) for j in near if sets.unite(k, int(j))]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their keys, over a sorted stream."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        last = np.ones(batch.num_rows, bool)
        for k in keys:
            column = np.asarray(batch.column(k))
            last &= column == column[-1]
        same = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if same or not last.all():
            cut = rest.num_rows - (batch.num_rows - same)
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None:
        yield rest


def _firsts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = np.asarray(table.column(k))
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect the members of each bucket whose signatures are close."""
    keys = ["band", "key"]
    for table in _runs(batches, keys):
        first = _firsts(table, keys)
        rep = np.asarray(table.column("uid"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(rep), -1)
        size = np.diff(first)
        head = np.repeat(first[:-1], size)
        close = (sig == sig[head]).sum(1) >= CUT
        a, b = [rep[head][close]], [rep[close]]
        stray = np.flatnonzero(np.bincount(np.repeat(np.arange(len(size)), size), weights=~close) > 0)
        for k in stray[size[stray] > 2]:
            # from the rows that are not near the first one, spread to whatever is close
            rows = np.arange(first[k], first[k + 1])
            waiting = rows[1:] if close[rows].sum() > 1 else rows[~close[rows]]
            reached = np.zeros(len(rows), bool)
            for row in rows[~close[rows]]:
                if reached[row - rows[0]]:
                    continue
                stack = [row]
                reached[row - rows[0]] = True
                while stack:
                    now = stack.pop()
                    open_ = waiting[~reached[waiting - rows[0]]]
                    near = open_[(sig[open_] == sig[now]).sum(1) >= CUT]
                    if len(near):
                        reached[near - rows[0]] = True
                        stack += near.tolist()
                        a.append(np.full(len(near), rep[now]))
                        b.append(rep[near])
        left, right = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])


def _linked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["root", "i", "j"]
        for table in _runs(batches, keys):
            first = _firsts(table, keys)
            uid = np.asarray(table.column("uid"))
            a, b = [], []
            for s, e in zip(first[:-1], first[1:]):
                for x, y in links(_bags(table.column("text").slice(s, e - s)), threshold):
                    a.append(uid[s + x])
                    b.append(uid[s + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, uid, similarity to the pivot) over a stream sorted by (root, block, member): the pivot comes first in each block."""
    key, bag = None, None
    for batch in batches:
        out = []
        bags = _bags(batch.column("text"))
        for k, (root, block, member, uid) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "block", "member", "uid")))):
            if not member:
                key, bag = (root, block), bags[k]
                continue
            if key != (root, block):
                raise RuntimeError(f"no pivot in block {block} of group {root}")
            out.append((root, uid, similarity(bag, bags[k])))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], ["root", "uid", "s"])


def _verified(member: DataFrame, texts: DataFrame, threshold: float, n: int, base: str) -> DataFrame:
    """Links (a, b) that connect what is linked at ``threshold`` in each group: ``member`` (uid, root, size), ``texts`` (uid, text)."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    big = member.where(F.col("size") > BLOCK).withColumn("block", F.pmod(F.xxhash64("uid"), blocks).cast("int")).withColumn("blocks", blocks)
    rows = big.join(texts.hint("merge"), "uid").select("root", "block", F.lit(1).alias("member"), "uid", "text")
    pivots = big.where("uid = root").join(texts.hint("merge"), "uid").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("member"), "uid", "text")
    dealt = rows.unionByName(pivots).repartition(n, "root", "block").sortWithinPartitions("root", "block", "member", "uid")
    star = materialise(dealt.mapInArrow(_star, "root long, uid long, s double"), f"{base}/star")
    far = star.where(F.col("s") < threshold).groupBy("root").agg(F.count(F.lit(1)).alias("far"), F.max("s").alias("top"))
    far = materialise(far, f"{base}/far")
    # left: the far ones, and those near the pivot that a far one could still be linked to
    open_ = (F.col("s") < threshold) | (F.col("s") <= F.col("top") + (1 - threshold) + 1e-9)
    left = star.join(far.hint("merge"), "root").where(open_).withColumn("is_far", F.col("s") < threshold)
    near = left.where("not is_far").groupBy("root").agg(F.count(F.lit(1)).alias("near"))
    left = left.join(near.hint("merge"), "root", "left").na.fill(0, ["near"])
    n_far, n_near = F.ceil(F.col("far") / BLOCK).cast("int"), F.ceil(F.col("near") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("uid"), F.when(F.col("is_far"), n_far).otherwise(n_near)).cast("int")
    left = left.select("root", "uid", "is_far", block.alias("block"), n_far.alias("n_far"), n_near.alias("n_near"))
    every = F.sequence(F.lit(0), F.col("n_far") - 1)
    # blocks of far ones meet each other, and each block of near ones (numbered behind them) meets each of them
    mine = F.when(F.col("is_far"), F.col("block")).otherwise(F.col("n_far") + F.col("block"))
    others = F.when(F.col("is_far"), F.sequence(F.lit(0), F.col("n_far") + F.col("n_near") - 1)).otherwise(every)
    alone = (F.col("n_far") == 1) & (F.col("n_near") == 0)
    others = F.when(alone, every).otherwise(F.filter(others, lambda x: x != mine))
    unit = left.select("root", "uid", mine.alias("mine"), F.explode(others).alias("other"))
    unit = unit.select("root", "uid", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    small = member.where(F.col("size") <= BLOCK).select("root", "uid", F.lit(0).alias("i"), F.lit(0).alias("j"))
    units = unit.unionByName(small).join(texts.hint("merge"), "uid").select("root", "i", "j", "uid", "text")
    units = units.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j", "uid")
    found = units.mapInArrow(_linked(threshold), "a long, b long")
    return materialise(found.unionByName(star.where(F.col("s") >= threshold).select(F.col("root").alias("a"), F.col("uid").alias("b"))), f"{base}/edges")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``documents`` (doc_id long, text string, more columns ignored):
    (doc_id, class_id long, class_size long, text_key binary, class_key long).

    A class holds documents with equal texts and, transitively, those whose shingle multisets have
    a weighted Jaccard similarity of at least ``threshold``; class_id is its least doc_id, null if none of its rows has one.
    Null, empty and blank texts have no shingles: each is a class of its own (size 1, no keys). Rows with a null doc_id
    are documents like any other. Repeated rows are rows of the same class, and
    their ids count once for each row in class_size. An empty table gives an empty result. text_key tells equal texts
    of a class, class_key the classes of this result (rows that share a doc_id may lie in different ones).

    Equal texts are collapsed before banding, so copies are not compared. A bucket emits at most as many links as it
    has members, never its pairs.
    """
    spark = documents.sparkSession
    limit_arrow(spark)
    n = partitions_for(spark)
    base = work_dir(spark, "near")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(texts.mapInArrow(_sign, "doc_id long, text_key binary, bands array<long>, sig binary"), f"{base}/signed")

    same = signed.where("text_key is not null").groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("bands", "sig")).alias("s"))
    same = same.select("text_key", "rep", "copies", "s.bands", "s.sig", F.monotonically_increasing_id().alias("uid"))
    same = materialise(same, f"{base}/same")
    banded = same.select("uid", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialise(buckets, f"{base}/buckets")
    # by a shuffle at every size, since both sides grow with the corpus; signatures go only where a bucket is shared
    met = materialise(banded.join(buckets.hint("merge"), ["band", "key"]), f"{base}/met")
    small = met.where(F.col("n") <= BUCKET).join(same.select("uid", "sig").hint("merge"), "uid").select("band", "key", "uid", "sig").repartition(n, "band", "key").sortWithinPartitions("band", "key", "uid")
    candidates = small.mapInArrow(_candidates, "a long, b long").where("a <> b")
    candidates = candidates.unionByName(met.where((F.col("n") > BUCKET) & (F.col("uid") > F.col("a"))).select("a", F.col("uid").alias("b")))
    group = components(materialise(candidates.distinct(), f"{base}/candidates"))
    group = group.unionByName(group.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "uid")

    sizes = materialise(group.groupBy("root").agg(F.count(F.lit(1)).alias("size")), f"{base}/sizes")
    member = materialise(salted_join(group, sizes, "root", hot_keys(sizes, "root", "size"), ["uid"]), f"{base}/members")
    root = components(_verified(member, _texts(texts, same, member, base), threshold, n, base))

    classes = same.join(root.withColumnRenamed("node", "uid").hint("merge"), "uid", "left").select("text_key", "rep", F.coalesce("root", "uid").alias("class_key"), "copies")
    classes = materialise(classes, f"{base}/classes")
    sizes = materialise(classes.groupBy("class_key").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n")), f"{base}/class_sizes")
    classes = salted_join(classes, sizes.drop("n"), "class_key", hot_keys(sizes, "class_key"), ["text_key"]).select("text_key", "class_key", "class_id", "class_size", "copies")
    classes = materialise(classes, f"{base}/keyed")
    blank = signed.where("text_key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "text_key", F.lit(None).cast("long").alias("class_key"))
    keyed = salted_join(signed.where("text_key is not null").select("doc_id", "text_key"), classes.drop("copies"), "text_key", hot_keys(classes, "text_key", "copies"), ["doc_id"])
    return keyed.select("doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), "text_key", "class_key").unionByName(blank)


def _texts(texts: DataFrame, same: DataFrame, member: DataFrame, base: str) -> DataFrame:
    """(uid, text) of the members of groups, one row each."""
    with_key = texts.withColumn("md5", F.unhex(F.md5(F.col("text").cast("binary"))))
    wanted = same.select("uid", "text_key", "rep").join(member.select("uid").hint("merge"), "uid")
    # always a shuffle of the texts: the members grow with the corpus, so a broadcast would hold at small sizes only;
    # of equal texts only the rows with the least doc_id go
    on = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("md5") == F.col("text_key"))
    found = with_key.join(wanted.hint("merge"), on).select("uid", "text")
    return materialise(found.groupBy("uid").agg(F.first("text").alias("text")), f"{base}/texts")


#: Every pair of different texts that shares a shingle, by exact overlaps, and the closure of the links.
SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS k, min(doc_id) AS low, count(*) AS copies, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY text),
bags AS (
  SELECT k, array_to_string(w[i:i + 4], ' ') AS shingle, count(*) AS n
  FROM texts, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS place(i) GROUP BY ALL),
totals AS (SELECT k, sum(n) AS total FROM bags GROUP BY k),
shared AS (
  SELECT a.k AS a, b.k AS b, sum(least(a.n, b.n)) AS least
  FROM bags AS a JOIN bags AS b ON a.shingle = b.shingle AND a.k < b.k GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN totals AS x ON x.k = a JOIN totals AS y ON y.k = b
  WHERE 5 * least >= 4 * (x.total + y.total - least)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT k AS a, k AS b FROM texts
  UNION SELECT reached.a, ways.b FROM reached JOIN ways ON reached.b = ways.a),
classes AS (
  SELECT a AS k, min(low) AS class_id, sum(copies) AS class_size FROM reached JOIN texts ON reached.b = texts.k GROUP BY a)
SELECT doc_id, class_id, CAST(class_size AS BIGINT) AS class_size
FROM documents JOIN texts USING (text) JOIN classes USING (k)
UNION ALL
SELECT doc_id, doc_id, 1 FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '[^\x20\x09-\x0D]')
"""
