r"""Line deduplication by a log-template tree.

Every \n-split line with at least ``min_words`` words walks a tree of fixed depth: token count,
then its first PREFIX tokens, where tokens with a digit, ``@`` or ``://`` are variable fields
and walk as one wildcard; a line with fewer than one fixed token in FIXED (a row of figures) walks with its
tokens as they are. In the leaf it joins the template whose fixed tokens it shares at
SIMILARITY or more of all positions (positions that differ become wildcards) or founds a new one.
A leaf of over LEAF_MAX distinct lines is clustered in salted parts, in rounds for as long as they halve
it; the templates that are left are then clustered as items of one leaf, whatever their number.

A template recurs if its lines lie in ``min_docs`` documents or more (two suffice for lines of
``long_words`` words or more). Lines of a recurring template are dropped, except in the document
with the least doc_id that has it, so that the corpus keeps each passage once.

A passage may also run over several lines, none of which recurs by itself: a run of lines of one text, each next to
the one before (shorter lines between them aside), every two neighbours of which stand next to each other, word for
word, in a document with a lesser doc_id. From ``long_words`` words on such a run is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnp as T
from .shared import hot_keys, limit_arrow, materialise, salted_join, work_dir

U64 = np.uint64
PREFIX = 4
SIMILARITY = 0.7
FIXED = 3
LEAF_MAX = 1024
MIN_WORDS, LONG_WORDS, MIN_DOCS = 3, 50, 3
_WILD = U64(0x2A2A2A2A2A2A2A2A)


def _variable(buf: np.ndarray) -> np.ndarray:
    flag = ((buf >= 48) & (buf <= 57)) | (buf == 64)
    colon = np.flatnonzero(buf == 58)
    colon = colon[colon + 2 < len(buf)]
    flag[colon[(buf[colon + 1] == 47) & (buf[colon + 2] == 47)]] = True
    return flag


def parse(buf: np.ndarray, off: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Lines with enough words: document, line number, words, leaf, template, first word, all tokens, and the line word for word."""
    w0, w1, wdoc = T.words(buf, off)
    l0, _, ldoc = T.lines(buf, off)
    line = np.searchsorted(l0, w0, side="right") - 1
    token = T.span_hash(buf, w0, w1)
    seen = np.concatenate([[0], np.cumsum(_variable(buf))])
    wild = seen[w1] > seen[w0]
    n = np.bincount(line, minlength=len(l0))
    figures = FIXED * (n - np.bincount(line[wild], minlength=len(l0))) < n
    spelled = token.copy()
    token[wild & ~figures[line]] = _WILD
    at = np.flatnonzero(n >= min_words)
    first = np.searchsorted(line, at)
    count = n[at]
    leaf = T.mix(count.astype(U64))
    for k in range(PREFIX):
        has = count > k
        leaf[has] = T.mix(leaf[has] ^ token[first[has] + k]) + U64(k)
    place = np.arange(len(token)) - np.searchsorted(line, line)

    def whole(words: np.ndarray) -> np.ndarray:
        part = T.mix(words + place.astype(U64) * U64(0x9E3779B97F4A7C15))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(part)])
        return total[first + count] - total[first]

    template = T.mix(whole(token) + leaf)
    number = at - np.searchsorted(ldoc, ldoc[at])
    return ldoc[at], number, count, leaf, template, first, token, T.mix(whole(spelled) + count.astype(U64))


def _leaves(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = T.utf8(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j in T.slices(off):
                doc, _, _, leaf, *_ = parse(buf[off[i] : off[j]], off[i : j + 1] - off[i], min_words)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), ids.take(pa.array(doc + i))], ["leaf", "doc_id"])

    return run


_FOUND = "leaf long, template long, doc_id long, text_key long, line int, n_words int, tokens binary, pair long, after int, after_words int"


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = T.utf8(batch.column("text"))
            ids, keys = batch.column("doc_id").cast(pa.int64()), batch.column("text_key")
            for i, j in T.slices(off):
                doc, number, count, leaf, template, first, token, exact = parse(buf[off[i] : off[j]], off[i : j + 1] - off[i], min_words)
                short = (token >> U64(48)).astype("<u2")
                begin = np.concatenate([[0], np.cumsum(count)])
                which = np.arange(begin[-1]) - np.repeat(begin[:-1] - first, count)
                tokens = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer((begin * 2).astype(np.int64).tobytes()), pa.py_buffer(short[which].tobytes())]).cast(pa.binary())
                # with the line below it in the same text: its number and words, and a hash of both lines
                below = np.append(doc[1:] == doc[:-1], np.zeros(min(len(doc), 1), bool))
                after = np.where(below, np.roll(number, -1), -1).astype(np.int32)
                after_words = np.where(below, np.roll(count, -1), 0).astype(np.int32)
                pair = T.mix(exact * U64(3) + np.roll(exact, -1))
                which = pa.array(doc + i)
                columns = [leaf.astype(np.int64), template.astype(np.int64), ids.take(which), keys.take(which), number.astype(np.int32), count.astype(np.int32), tokens, pair.astype(np.int64), after, after_words]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], _FOUND.replace(",", "").split()[::2])

    return run


def merge(rows: np.ndarray, fixed: np.ndarray, similarity: float = SIMILARITY) -> tuple[list[int], np.ndarray]:
    """Leaf step of the tree: for each item (tokens and its fixed positions) the number of the item whose
    template it joins, and the fixed positions of those templates in the end.

    Many items are looked up by blocks of positions: of one block more than a template may differ from an
    item in, one is equal and fixed in both. All lie behind the prefix, which a leaf shares.
    """
    width = rows.shape[1]
    fixed = fixed.copy()
    cut = np.linspace(PREFIX, width, int(width - similarity * width + 1e-9) + 2).astype(int) if width > PREFIX else np.zeros(2, int)
    indexed = len(rows) > LEAF_MAX and bool((np.diff(cut) > 0).all())
    index: dict[tuple[int, bytes], list[int]] = {}
    heads = np.zeros(len(rows), np.int64)
    n, out = 0, []
    for k, row in enumerate(rows):
        keys = [(a, row[a:b].tobytes()) for a, b in zip(cut, cut[1:]) if fixed[k, a:b].all()] if indexed else []
        at = np.unique(np.concatenate([np.array(index.get(key, []), np.int64) for key in keys] or [heads[:0]])) if indexed else heads[:n]
        if len(at):
            same = (rows[at] == row) & fixed[at] & fixed[k]
            share = same.sum(1)
            best = int(share.argmax())
            if share[best] >= similarity * width:
                fixed[at[best]] = same[best]
                out.append(int(at[best]))
                continue
        heads[n] = k
        n += 1
        for key in keys:
            index.setdefault(key, []).append(k)
        out.append(k)
    return out, fixed


def cluster(templates: list[int], tokens: list[bytes], similarity: float = SIMILARITY) -> list[int]:
    """For each line form (ascending by hash) the hash of the template it joins."""
    rows = np.frombuffer(b"".join(tokens), "<u2").reshape(len(tokens), -1)
    return [templates[k] for k in merge(rows, np.ones(rows.shape, bool), similarity)[0]]


_MERGED = "leaf long, template long, cluster long, n long, tokens binary, fixed binary"


def _clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups that lie together, sorted by (place, template), over a stream of batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch.place.iloc[-1]
        if held and (batch.place.iloc[0] != last or held[-1].place.iloc[-1] != last):
            held.append(batch[batch.place != last])
            yield _grouped(pd.concat(held, ignore_index=True))
            held, batch = [], batch[batch.place == last]
        held.append(batch)
    if held:
        yield _grouped(pd.concat(held, ignore_index=True))


def _grouped(rows: pd.DataFrame) -> pd.DataFrame:
    """Each item's template; tokens and fixed positions are given for the templates of parts, which meet again."""
    names, masks = [], []
    for _, g in rows.groupby("place", sort=False):
        form = np.frombuffer(b"".join(g.tokens), "<u2").reshape(len(g), -1)
        mask = np.stack([np.ones(form.shape[1], bool) if f is None else np.frombuffer(f, bool) for f in g.fixed])
        joins, mask = merge(form, mask)
        names.append(g.template.to_numpy()[joins])
        masks += [mask[k].tobytes() if again and k == j else None for k, (again, j) in enumerate(zip(g.again, joins))]
    out = pd.DataFrame({"leaf": rows.leaf, "template": rows.template, "cluster": np.concatenate(names), "n": rows.n})
    out["fixed"] = pd.Series(masks, out.index, object)
    out["tokens"] = rows.tokens.where(out.fixed.notna(), None)
    return out[["leaf", "template", "cluster", "n", "tokens", "fixed"]]


def _generalise(items: DataFrame, base: str) -> DataFrame:
    """(template, cluster) of the line forms ``items`` (leaf, template, tokens, n forms in the leaf) that join another's template."""
    items = items.withColumns({"fixed": F.lit(None).cast("binary"), "again": F.col("n") > LEAF_MAX})
    joins, k = None, 0
    while True:
        parts = F.when(F.col("again"), F.ceil(F.col("n") / LEAF_MAX)).otherwise(1)
        place = F.xxhash64("leaf", F.pmod(F.xxhash64("template", F.lit(k)), parts))
        dealt = items.withColumn("place", place).repartition("place").sortWithinPartitions("place", "template")
        merged = materialise(dealt.mapInPandas(_clusters, _MERGED), f"{base}/merged{k}")
        step = merged.where("template <> cluster").select("template", "cluster")
        if joins is None:
            joins = step
        else:
            hot = hot_keys(joins.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster")
            moved = salted_join(joins, step.select(F.col("template").alias("cluster"), F.col("cluster").alias("to")), "cluster", hot, ["template"], "left")
            joins = materialise(moved.select("template", F.coalesce("to", "cluster").alias("cluster")).unionByName(step), f"{base}/joins{k}")
        left = merged.where("fixed is not null")
        sizes = materialise(left.groupBy("leaf").agg(F.count(F.lit(1)).alias("left")), f"{base}/left{k}")
        if sizes.isEmpty():
            return joins
        # parts that no longer halve a leaf leave the rest to one last round over all of it
        again = (F.col("left") > LEAF_MAX) & (2 * F.col("left") <= F.col("n"))
        items = left.join(sizes.hint("merge"), "leaf").select("leaf", "template", "tokens", F.col("left").alias("n"), "fixed", again.alias("again"))
        k += 1


def _passages(found: DataFrame, long_words: int, base: str) -> DataFrame:
    """(doc_id, line, cluster): lines of passages over several lines that an earlier document has; ``cluster`` is a hash of one pair."""
    pairs = found.where("after >= 0")
    shared = pairs.groupBy("pair").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    shared = materialise(shared.select("pair", "low", "n"), f"{base}/shared")
    linked = pairs.select("doc_id", "text_key", "line", "n_words", "pair", "after", "after_words")
    linked = salted_join(linked, shared.select("pair", "low"), "pair", hot_keys(shared, "pair"), ["doc_id", "line"]).where("doc_id > low").drop("low").distinct()
    text = Window.partitionBy("doc_id", "text_key").orderBy("line")
    begins = F.when(F.lag("after").over(text) == F.col("line"), 0).otherwise(1)
    runs = linked.withColumn("begins", begins).withColumn("run", F.sum("begins").over(text)).groupBy("doc_id", "text_key", "run")
    last = F.max(F.struct("line", "after", "after_words"))
    runs = runs.agg(F.collect_list("line").alias("lines"), F.sum("n_words").alias("words"), last.alias("last"), F.min("pair").alias("cluster"))
    runs = runs.where(F.col("words") + F.col("last.after_words") >= long_words)
    return runs.select("doc_id", F.explode(F.concat("lines", F.array("last.after"))).alias("line"), "cluster")


def recurring_lines(documents: DataFrame, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, line int, cluster long): the lines that the tree drops; line numbers start at 0."""
    spark = documents.sparkSession
    limit_arrow(spark)
    base = work_dir(spark, "lines")
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    leaves = texts.mapInArrow(_leaves(min_words), "leaf long, doc_id long").groupBy("leaf").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("leaf", "n")
    leaves = materialise(leaves, f"{base}/leaves")
    found = keyed.mapInArrow(_lines(min_words), _FOUND)
    found = materialise(salted_join(found, leaves.select("leaf"), "leaf", hot_keys(leaves, "leaf"), ["doc_id", "line"], "left_semi"), f"{base}/found")

    forms = materialise(found.groupBy("leaf", "template").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("lines")), f"{base}/forms")
    hot = hot_keys(forms, "template", "lines")
    big = materialise(forms.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{base}/big")
    together = salted_join(forms.drop("lines"), big, "leaf", hot_keys(big, "leaf"), ["template"])
    together = _generalise(together, base)
    joined = salted_join(found.select("template", "doc_id", "line", "n_words"), together, "template", hot, ["doc_id", "line"], "left")
    joined = materialise(joined.select("doc_id", "line", "n_words", F.coalesce("cluster", "template").alias("cluster")), f"{base}/joined")

    docs = joined.groupBy("cluster", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_words").alias("words"))
    docs = docs.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("words").alias("words"), F.sum("n").alias("n"))
    recurs = materialise(docs.where((F.col("n_docs") >= min_docs) | ((F.col("n_docs") >= 2) & (F.col("words") >= long_words))), f"{base}/recurs")
    kept = salted_join(joined, recurs.select("cluster", "first_doc"), "cluster", hot_keys(recurs, "cluster"), ["doc_id", "line"])
    kept = kept.where("doc_id > first_doc").select("doc_id", "line", "cluster").unionByName(_passages(found, long_words, base))
    return kept.groupBy("doc_id", "line").agg(F.min("cluster").alias("cluster"))


def drop_recurring_lines(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with the columns ``n_lines`` and ``n_dropped`` (long) and ``text`` without its recurring lines.

    Other columns pass through. Rows with a null doc_id or text are returned as they are
    (n_lines 0 for a null text); an empty text has one line, never dropped. Rows with the same doc_id
    are one document: their lines do not recur among themselves, and a drop holds for each of them by
    line number. Among equal lines the least doc_id keeps its own. Columns named like the new ones are replaced.
    """
    drops = recurring_lines(documents, **options).groupBy("doc_id").agg(F.collect_set("line").alias("__drop"))
    drops = drops.select(F.col("doc_id").alias("__doc"), "__drop")
    # by a shuffle at every size, since the drops grow with the corpus
    kept = documents.join(drops.hint("merge"), F.col("doc_id") == F.col("__doc"), "left")
    # linear in a text's lines: the numbers to keep are found by a hash, the lines looked up by number (two uses of
    # __lines keep the optimizer from splitting the text again for each of them)
    kept = kept.withColumn("__lines", F.when(F.col("__drop").isNotNull(), F.split("text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop")
    rest = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    kept = kept.withColumns({"n_lines": count.cast("long"), "n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long"), "text": F.when(F.col("__drop").isNull(), F.col("text")).otherwise(rest)})
    return kept.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)).cast("long")).drop("__doc", "__drop", "__lines")
