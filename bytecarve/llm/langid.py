"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text gets a probability of each language from the states of both directions; a
document's probabilities are the means over all its bytes. Texts run in windows of WINDOW bytes, whole texts,
many windows side by side: the steps of one text cannot run beside each other, so a long text in one pass would take
as many steps as it has bytes. Instead each direction enters a window with a state warmed up over the CONTEXT bytes
before it, or from the text's end if that is nearer. Where a text begins or ends the state is zero, whatever
lies beside it, so a prediction depends on the text alone. The network is trained here in numpy by
backpropagation through time (Adam) on the whole texts of at most FIT_DOCS documents a language, those with the
least hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnp as T
from .shared import limit_arrow

#: Documents of a language that the network is trained on, whole texts; windows that ``_sample`` spreads over a text.
FIT_DOCS, FIT_WINDOWS = 300, 6
#: Documents of a language, as a multiple of FIT_DOCS, among which the least hashes are sought.
OVERDRAW = 4
WINDOW, CONTEXT, HIDDEN, STEPS, BATCH, RATE = 64, 16, 8, 260, 192, 0.02
#: Windows that one numpy step advances.
SIDE_BY_SIDE = 2048
#: Places that probabilities are rounded to before the best is taken, far above what the order of additions moves.
DECIMALS = 6
UNKNOWN = "und"


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


class Network:
    """Arrays lie (units, windows): ``x`` (3H, 256) input weights with bias, ``u`` (3H, H), ``v`` (L, H); two directions."""

    def __init__(self, n_langs: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32)
            self.p["v" + d] = rng.normal(0, 0.3, (n_langs, hidden)).astype(np.float32)
        self.p["c"] = np.zeros((n_langs, 1), np.float32)

    def _run(self, d: str, codes: np.ndarray, keep: bool, live: np.ndarray | None = None) -> tuple[list, np.ndarray]:
        """``codes`` (steps, windows) in the direction's own order; logits (steps, L, windows) of its half.

        ``live`` (steps, windows) is false outside of a text, where the state stays zero; null: true everywhere.
        """
        x, u, v = self.p["x" + d], self.p["u" + d], self.p["v" + d]
        n = u.shape[1]
        h = np.zeros((n, codes.shape[1]), np.float32)
        out = np.empty((len(codes), len(v), codes.shape[1]), np.float32)
        kept = []
        for t, c in enumerate(codes):
            a = np.take(x, c, axis=1)
            q = u @ h
            zr = _sigmoid(a[: 2 * n] + q[: 2 * n])
            z, r = zr[:n], zr[n:]
            m = np.tanh(a[2 * n :] + r * q[2 * n :])
            if keep:
                kept.append((h, z, r, m, q[2 * n :]))
            h = m + z * (h - m)
            if live is not None and not live[t].all():
                h *= live[t]
            np.matmul(v, h, out=out[t])
            if keep:
                kept[-1] += (h,)
        return kept, out

    def logits(self, codes: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """(steps, L, windows) of the codes (steps, windows)."""
        forward = self._run("f", codes, False, live)[1]
        forward += self._run("b", codes[::-1], False, None if live is None else live[::-1])[1][::-1]
        forward += self.p["c"]
        return forward

    def step(self, codes: np.ndarray, lang: np.ndarray, live: np.ndarray | None = None) -> tuple[float, dict]:
        """Mean loss over all live positions, and gradients; ``lang`` (windows,) holds the label of each window."""
        live = np.ones(codes.shape, bool) if live is None else live
        n_live = max(1, int(live.sum()))
        kf, of = self._run("f", codes, True, live)
        kb, ob = self._run("b", codes[::-1], True, live[::-1])
        a = of + ob[::-1] + self.p["c"]
        a -= a.max(1, keepdims=True)
        p = np.exp(a)
        p /= p.sum(1, keepdims=True)
        w = np.arange(codes.shape[1])
        loss = -np.log(p[:, lang, w] + 1e-9)[live].sum() / n_live
        p[:, lang, w] -= 1
        p /= n_live
        p *= live[:, None, :]
        g = {"c": p.sum((0, 2))[:, None]}
        for d, kept, order, err, on in (("f", kf, codes, p, live), ("b", kb, codes[::-1], p[::-1], live[::-1])):
            u, v = self.p["u" + d], self.p["v" + d]
            n = u.shape[1]
            gx, gu, gv = np.zeros_like(self.p["x" + d]), np.zeros_like(u), np.zeros_like(v)
            back = np.zeros((n, codes.shape[1]), np.float32)
            for t in range(len(order) - 1, -1, -1):
                before, z, r, m, qm, h = kept[t]
                gv += err[t] @ h.T
                back = (back + v.T @ err[t]) * on[t]
                dm = back * (1 - z) * (1 - m * m)
                dz = back * (before - m) * z * (1 - z)
                dr = dm * qm * r * (1 - r)
                da = np.concatenate([dz, dr, dm])
                dq = np.concatenate([dz, dr, dm * r])
                gu += dq @ before.T
                for k in range(3 * n):
                    gx[k] += np.bincount(order[t], weights=da[k], minlength=256).astype(np.float32)
                back = back * z + u.T @ dq
            g |= {"x" + d: gx, "u" + d: gu, "v" + d: gv}
        return float(loss), g


def train(buf: np.ndarray, off: np.ndarray, lang: np.ndarray, n_langs: int, steps: int = STEPS, seed: int = 11) -> Network:
    """Adam over balanced batches: of each language equally many documents, of each a window at random from the whole text."""
    net = Network(n_langs)
    rng = np.random.default_rng(seed)
    windows = Windows(buf, off)
    by = [np.flatnonzero((lang == k) & (windows.count > 0)) for k in range(n_langs)]
    by = [b for b in by if len(b)]
    m = {k: np.zeros_like(a) for k, a in net.p.items()}
    v = {k: np.zeros_like(a) for k, a in net.p.items()}
    for t in range(1, steps + 1):
        docs = np.concatenate([rng.choice(b, max(1, BATCH // n_langs)) for b in by])
        codes, live, _ = windows.cut(windows.first[docs] + (rng.random(len(docs)) * windows.count[docs]).astype(np.int64))
        _, g = net.step(codes, lang[docs], live)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = RATE * (0.1 ** (t / steps))
        for k, a in g.items():
            a = a * min(1.0, 1.0 / (norm + 1e-12))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.01 * (a * a - v[k])
            net.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        net.p = {k: a.astype(np.float32) for k, a in net.p.items()}
    return net


class Windows:
    """All texts of ``buf`` in windows of WINDOW bytes, each with up to CONTEXT bytes of its text on both sides."""

    SPAN = WINDOW + 2 * CONTEXT

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        size = np.diff(off)
        self.count = -(-size // WINDOW)
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(size)), self.count)
        self.start = off[self.doc] + WINDOW * (np.arange(len(self.doc)) - self.first[self.doc])
        self.used = np.minimum(off[self.doc + 1] - self.start, WINDOW)
        # bytes of the context that lie in the text
        self.before = np.minimum(self.start - off[self.doc], CONTEXT)
        self.after = np.minimum(off[self.doc + 1] - self.start - self.used, CONTEXT)
        room = np.zeros(len(buf) + self.SPAN, np.uint8)
        room[CONTEXT : CONTEXT + len(buf)] = buf
        self.view = np.lib.stride_tricks.sliding_window_view(room, self.SPAN)

    def cut(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, whether they lie in the text, and whether in the window itself, all (steps, windows)."""
        steps = CONTEXT + int((self.used + self.after)[which].max(initial=0))
        place = np.arange(steps)[:, None] - CONTEXT
        codes = self.view[self.start[which], :steps].T.copy()
        live = (place >= -self.before[which]) & (place < (self.used + self.after)[which])
        codes[~live] = 0
        return codes, live, (place >= 0) & (place < self.used[which])


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each document has a letter (Unicode category L)."""
    plain = np.concatenate([[0], np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122))])
    high = np.concatenate([[0], np.cumsum(buf >= 128)])
    out = plain[off[1:]] > plain[off[:-1]]
    for k in np.flatnonzero(~out & (high[off[1:]] > high[off[:-1]])):
        out[k] = any(c.isalpha() for c in buf[off[k] : off[k + 1]].tobytes().decode())
    return out


def label(net: Network, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, languages) mean probabilities over all bytes."""
    windows = Windows(buf, off)
    n_langs = len(net.p["c"])
    total = np.zeros((len(off) - 1, n_langs))
    order = np.argsort(windows.used + windows.after, kind="stable")
    for s in range(0, len(order), SIDE_BY_SIDE):
        part = np.sort(order[s : s + SIDE_BY_SIDE])
        codes, live, mine = windows.cut(part)
        a = net.logits(codes, live)
        a -= a.max(1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(1, keepdims=True)
        a *= mine[:, None, :]
        # windows of a text are added in its own order, so the sum does not depend on what else is labelled
        np.add.at(total, windows.doc[part], a.sum(0, dtype=np.float64).T)
    return np.round(total / np.maximum(np.diff(off), 1)[:, None], DECIMALS)


def _least(known: DataFrame, fit_docs: int, payload: Column) -> DataFrame:
    """(lang, doc_id, payload) of the ``fit_docs`` documents of a language with the least hash of doc_id.

    A first count of each language gives a bound on the hash that leaves some OVERDRAW * fit_docs documents of it,
    whatever its size; only these are ranked, so no more texts move. The driver gets one number per language, which the
    network has an output for.
    """
    known = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("rank"), "text")
    bounds = {r.lang: min(1.0, OVERDRAW * fit_docs / r.n) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.shiftrightunsigned("rank", 11).cast("double") / float(1 << 53)
    # the signed order of ranks starts at the least negative one: place in [0, 1)
    place = F.when(share >= 0.5, share - 0.5).otherwise(share + 0.5)
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang")) if bounds else F.lit(1.0)
    few = known.where(place <= bound).select("lang", "doc_id", "rank", F.xxhash64("text").alias("tie"), payload.alias("payload"))
    least = Window.partitionBy("lang").orderBy("rank", "doc_id", "tie")
    return few.withColumn("n", F.row_number().over(least)).where(F.col("n") <= fit_docs).select("lang", "doc_id", "payload")


def _sample(known: DataFrame, fit_docs: int) -> pd.DataFrame:
    """(lang, doc_id, bytes): FIT_WINDOWS windows of each document of the sample, spread evenly over its text: a look at what is learned from."""
    size = F.octet_length("text")
    cut_at = F.transform(F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1)), lambda k: F.substring(F.encode("text", "UTF-8"), F.floor(k * F.greatest(size - WINDOW, F.lit(0)) / max(1, FIT_WINDOWS - 1)).cast("int") + 1, F.lit(WINDOW)))
    return _least(known, fit_docs, cut_at).select("lang", "doc_id", F.explode("payload").alias("bytes")).toPandas()


def predict(documents: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text, lang): doc_id, held_out boolean, lang_pred string, score double.

    held_out: crc32 of doc_id as text, mod 5, is 0 (false for a null doc_id, which is not learned from either).
    A null text or one without a letter is ``und`` with score 0, and so is every text if no language can be
    learned. Empty texts, repeated rows and extra columns need no care; lang is read for training alone.
    """
    spark = documents.sparkSession
    limit_arrow(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = docs.where(part != 0).where("lang is not null and text is not null and trim(text) <> ''")
    rows = _least(known, fit_docs, F.col("text")).toPandas().sort_values(["lang", "doc_id", "payload"])
    langs = sorted(rows.lang.unique().tolist())
    net = None
    if langs:
        buf, off, _ = T.utf8(pa.array(rows.payload, pa.large_string()))
        net = train(buf, off, np.searchsorted(langs, rows.lang.to_numpy(str)), len(langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = T.utf8(batch.column("text"))
            for i, j in T.slices(off):
                b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                name, score = np.full(j - i, UNKNOWN, object), np.zeros(j - i)
                if net is not None:
                    ok = np.flatnonzero(has_letter(b, o))
                    p = np.clip(label(net, b, o)[ok], 0, 1)
                    name[ok] = np.array(langs, object)[p.argmax(1)]
                    score[ok] = p.max(1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(name.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
