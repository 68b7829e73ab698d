"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import collections
import gzip
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytecarve.llm import bagminhash, chat, components, huffman, langid, line_templates, mixing, packing, quality, shared, textnp, tokens, topk, warc

DATA = "/root/testdata"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 4000
#: (doc_id, text, lang, source): nulls, empty, blank, long, ties, repeated rows.
EDGE = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "b"), (4, LONG, "en", "a"), (5, "one two three", "en", None), (5, "one two three", "en", None), (None, "one two three", None, "a"), (6, "x", "de", "b"), (7, "été\nété\nfin 12345 \U0001f600", "fr", "b")]
DDL = "doc_id long, text string, lang string, source string, size long, target string, rank int, n int"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([r + (1, "t", 2, 3) for r in EDGE], DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(500)]
    out = []
    for k in range(n):
        if out and rng.random() < 0.4:
            words = rng.choice(out)[1].split(" ")
            for _ in range(rng.choice([0, 1, 3, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append((k, " ".join(words)))
        else:
            out.append((k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 150)))))
    return out


def bag(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def test_near_duplicates(spark, edge, empty):
    docs = corpus()
    frame = spark.createDataFrame([d + ("x",) for d in docs], "doc_id long, text string, class_id string")
    up = {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = {d: bag(t) for d, t in docs}
    for a, _ in docs:
        for b in range(a):
            x, y = bags[a], bags[b]
            if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame).collect()}
    assert got == {d: find(d) for d, _ in docs}
    rows = sorted((r.doc_id or -1, r.class_id or -1, r.class_size) for r in bagminhash.near_duplicates(edge).collect())
    assert rows == [(-1, 5, 3), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 3), (5, 5, 3), (6, 6, 1), (7, 7, 1)]
    assert bagminhash.near_duplicates(empty).count() == 0


def test_links_of_many_bags_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 4)
    docs = [(k, " ".join(f"w{j}" for j in range(100) if j != k)) for k in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.class_id for r in bagminhash.near_duplicates(frame).collect()} == {0}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    diff = []
    for _ in range(120):
        keys = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        wa, wb = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        g, d, w = np.concatenate([keys, keys]), np.repeat([0, 1], 60), np.concatenate([wa, wb])
        sig = bagminhash.signatures(g[w > 0], d[w > 0], w[w > 0], 2)
        diff.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(diff)) < 4 * np.std(diff) / np.sqrt(len(diff)) + 1e-9 and abs(np.mean(diff)) < 0.02


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 230)]
    up = {k: k for k in range(300)}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: find(k) for k in up if find(k) != k}


def test_line_dedup(spark, edge, empty):
    boiler = "see item 17 in the list of all things"
    docs = [(k, f"{'qrstuv'[k]} line {'abcdef'[k]} alone\n{boiler.replace('17', str(k))}\nok") for k in range(6)]
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0].n_dropped == 0 and out[0].text == docs[0][1]
    for k in range(1, 6):
        assert boiler.replace("17", str(k)) not in out[k].text and out[k].text.endswith("\nok") and out[k].n_lines == 3
    passage = " ".join(f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    two = spark.createDataFrame([(1, f"a b c\n{passage}"), (2, f"{passage}\nd e f")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_templates.drop_recurring_lines(two).collect()} == {1: f"a b c\n{passage}", 2: "d e f"}
    kept = line_templates.drop_recurring_lines(edge)
    assert kept.count() == len(EDGE) and kept.where("n_dropped > 0").count() == 0
    assert line_templates.drop_recurring_lines(empty).count() == 0


def test_cluster_generalises():
    a = np.arange(10, dtype="<u2")
    b, c = a.copy(), a.copy()
    b[3], c[:8] = 99, 77
    assert line_templates.cluster([1, 2, 3], [x.tobytes() for x in (a, b, c)]) == [1, 1, 3]


def test_big_leaf_generalises(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    docs = [(k, f"posted by our member {str(k).translate(letters)}") for k in range(1500)]
    kept = line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("n_dropped = 0").collect()
    assert [r.doc_id for r in kept] == [0]


def test_passages_over_several_lines(spark):
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    pool = [[line(rng.randint(3, 25)) for _ in range(rng.randint(1, 6))] for _ in range(60)]
    docs = []
    for k in range(80):
        lines = []
        for _ in range(rng.randint(1, 5)):
            lines += rng.choice([[line(9)], ["ok", ""], *rng.sample(pool, 8)])
        docs.append((k, "\n".join(lines)))
    docs += [docs[7], (8, docs[9][1]), (8, docs[30][1]), (90, docs[3][1]), (91, None), (92, ""), (None, docs[4][1])]
    judged = [(d, [(i, x.split()) for i, x in enumerate(t.split("\n")) if len(x.split()) >= 3]) for d, t in docs if d is not None and t]
    low = {}
    for d, lines in judged:
        for (_, a), (_, b) in zip(lines, lines[1:]):
            pair = (tuple(a), tuple(b))
            low[pair] = min(d, low.get(pair, d))
    want = set()
    for d, lines in judged:
        run = lines[:1]
        for a, b in [*zip(lines, lines[1:]), (None, None)]:
            if a and low[tuple(a[1]), tuple(b[1])] < d:
                run.append(b)
                continue
            if len(run) > 1 and sum(len(x) for _, x in run) >= 50:
                want |= {(d, i) for i, _ in run}
            run = [b]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id, r.line) for r in line_templates.recurring_lines(frame, min_docs=10**6).collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want


def test_rows_of_figures_recur_by_their_text_only(spark):
    table = lambda k: "\n".join(f"{1990 + j} {k}.{j} {k * j}.5 -{j}" for j in range(20))
    docs = [(k, f"{table(k)}\ntotal of 17 items was {k} in the end") for k in range(1, 6)] + [(9, table(1))]
    rows = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[k].n_dropped for k in (1, 2, 3, 4, 5, 9)] == [0, 1, 1, 1, 1, 20]


def test_merge_by_blocks(monkeypatch):
    rng = np.random.default_rng(7)
    for width in (3, 5, 6, 9, 20):
        rows = rng.integers(0, 4, (600, width)).astype("<u2")
        rows[:, :4] = 1
        fixed = rng.random(rows.shape) < 0.95
        plain = line_templates.merge(rows, fixed)
        with monkeypatch.context() as m:
            m.setattr(line_templates, "LEAF_MAX", 10)
            blocks = line_templates.merge(rows, fixed)
        assert plain[0] == blocks[0] and (plain[1] == blocks[1]).all()


def test_quality_statistics_and_trees(spark, edge, empty):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choices(["a", "bb", "c#c", "é", "|", "dd"], k=rng.randint(0, 6))) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [t or "" for _, t, _, _ in EDGE]
    buf, off, _ = textnp.utf8(pa.array(texts))
    s = quality.statistics(buf, off)
    for k, t in enumerate(texts):
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert tuple(int(s[n][k]) for n in quality.STATS[:5]) == want
    x = np.random.default_rng(1).random((800, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.7).astype(float)
    trees = quality.fit(x, y, [1, 0, 0])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95
    grid = np.tile(np.array([[0.0, 0.4, 0.6]]), (50, 1))
    grid[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(trees.score(grid)) >= -1e-12).all()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judge(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(r.kept == (not r.base_failed) and r.base_failed for r in rows)
    assert quality.judge(empty, labels).count() == 0


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_piece_encoder(name, spaced):
    rng = random.Random(9)
    alphabet = [" ", " ", "  ", "\n", "\t", " \n", "a", "Word", "'s", "'", "don't", ".", "!!", "é", "́", "\xa0", "\x1d", "\x1c", "23", "日本", "😀", "<|endoftext|>", " ", "Σ", "ΑΣ", "\x85", "İ", "\r\n", "|", "a.b", "$$"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(800)] + ["", " ", "a ", "  a"]
    e = tokens.PieceEncoder(tokens.public_path(name), spaced)
    buf, off, _ = textnp.utf8(pa.array(texts))
    for _ in range(2):
        ids, at = e.encode(buf, off)
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == want


def _whole(name, texts, end):
    t = tokens.PieceEncoder(tokens.public_path(name), True).tokenizer
    return [x.ids + [end] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing(spark, edge, empty):
    rows = packing.pack(edge).toPandas()
    want = collections.Counter((d, tuple(i)) for (d, *_), i in zip(EDGE, _whole(packing.TOKENIZER, [t for _, t, *_ in EDGE], 0)))
    assert rows.length.sum() == sum(len(i) * n for (_, i), n in want.items())
    pieces = {(d, p * 2048): i[p * 2048 : p * 2048 + 2048] for (d, i) in want for p in range(-(-len(i) // 2048))}
    for r in rows.itertuples():
        ids = pieces[None if pd.isna(r.doc_id) else int(r.doc_id), r.start]
        assert (r.length, r.ids_crc32, r.start) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), r.piece * 2048)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 2048
    assert rows.sequence_id.nunique() == -(-rows.length.sum() // 2048)
    assert packing.pack(empty).count() == 0
    rng = random.Random(3)
    sizes = [rng.randint(1, 2047) for _ in range(2000)]
    bins = packing.best_fit(sizes)
    assert sorted(k for b in bins for k in b) == list(range(2000)) and max(sum(sizes[k] for k in b) for b in bins) <= 2048
    assert len(bins) <= 1.02 * sum(sizes) / 2048 + 1


def test_packing_forwards_every_underfull_bin(spark):
    docs = [(k, "a " * 1200) for k in range(2600)] + [(k, "a " * 700) for k in range(2600, 5200)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(docs, 2), "doc_id long, text string")
    rows = packing.pack(frame).toPandas()
    assert rows.doc_id.nunique() == len(rows) == 5200
    assert set(rows.groupby("sequence_id").length.sum()) == {sum(set(rows.length))} and rows.sequence_id.nunique() == 2600


def test_packing_plan():
    rng = random.Random(8)
    for top in (3, 40, 2047):
        sizes = [rng.randint(1, top) for _ in range(3000)]
        counts = collections.Counter(sizes)
        used = collections.defaultdict(list)
        parts = packing.plan(counts)
        for (total, number, first, each, offset), after in zip(parts, parts[1:] + [(0,)]):
            for k in range(number, after[1] if after[0] == total else counts[total]):
                used[first + (k - number) // each].append((offset + (k - number) % each * total, total))
        assert sorted(t for b in used.values() for _, t in b) == sorted(sizes)
        for b in used.values():
            b.sort()
            assert [x for x, _ in b] == [sum(t for _, t in b[:k]) for k in range(len(b))] and sum(t for _, t in b) <= 2048
        assert len(used) == len(packing.best_fit(sizes)) and set(used) == set(range(len(used)))


def test_huffman(spark, edge, empty):
    rng = np.random.default_rng(1)
    counts = (rng.pareto(1, 400) * 50).astype(int) + 1
    for most in (9, 12, 18):
        n = huffman.code_lengths(counts, most)
        assert n.max() <= most and abs(sum(2.0 ** -n.astype(float)) - 1) < 1e-9
    assert huffman.code_lengths(np.array([5, 9, 12, 13, 16, 45]), 18).tolist() == [4, 4, 3, 3, 3, 1]
    for size in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, 400, size)
        points, words = huffman.encode(ids, n, huffman.canonical(n))
        assert (huffman.decode(size, points, words, huffman.decode_table(n)) == ids).all()
    rows = huffman.round_trip(edge, file_bytes=4000).toPandas().sort_values("start")
    assert rows.start.tolist() == (rows.n_tokens.cumsum() - rows.n_tokens).tolist()
    want = collections.Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, *_), i in zip(EDGE, _whole(huffman.TOKENIZER, [t for _, t, *_ in EDGE], 2)))
    got = collections.Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows.itertuples())
    assert got == want and rows.doc_id.dropna().is_monotonic_increasing and pd.isna(rows.doc_id.iloc[0])
    assert huffman.round_trip(empty).count() == 0


def test_language_id(spark, edge, empty):
    rng = random.Random(6)
    spell = {"aa": "abcdel ", "bb": "mnopqr ", "cc": "stuvé "}
    docs = [(k, "".join(rng.choices(spell[lang], k=rng.randint(20, 300))), lang) for k in range(240) for lang in [rng.choice(list(spell))]]
    rows = langid.predict(spark.createDataFrame(docs, "doc_id long, text string, lang string")).toPandas().set_index("doc_id")
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, *_ in docs}
    assert rows.held_out.to_dict() == held
    assert np.mean([rows.lang_pred[d] == lang for d, _, lang in docs if held[d]]) >= 0.95 and rows.score.between(0, 1).all()
    rows = langid.predict(edge).collect()
    assert len(rows) == len(EDGE) and all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2, 3))
    assert langid.predict(empty).count() == 0
    net = langid.Network(3, 4)
    net.p = {k: a.astype(float) for k, a in net.p.items()}
    codes, lang = np.random.default_rng(0).integers(97, 122, (7, 5)), np.array([0, 1, 2, 0, 1])
    _, g = net.step(codes, lang)
    for k in ("xf", "uf", "ub", "vb", "c"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][i] += 1e-4
        high = net.step(codes, lang)[0]
        net.p[k][i] -= 2e-4
        low = net.step(codes, lang)[0]
        net.p[k][i] += 1e-4
        assert abs((high - low) / 2e-4 - g[k][i]) < 1e-4


def test_language_sample_is_the_least_hashes(spark):
    rng = random.Random(8)
    docs = [(k, "é" * rng.choice([1, 20, 40, 300]), rng.choice(["aa", "aa", "aa", "bb"])) for k in range(3000)] + [(9001, "solo", "cc")] * 2
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rank = {r.doc_id: r.h for r in frame.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    expected = []
    for lang in ("aa", "bb", "cc"):
        for k, text, _ in sorted((d for d in docs if d[2] == lang), key=lambda d: (rank[d[0]], d[0]))[:20]:
            raw = text.encode()
            at = [i * max(0, len(raw) - langid.WINDOW) // (langid.FIT_WINDOWS - 1) for i in range(langid.FIT_WINDOWS)]
            expected += [(lang, k, raw[a : a + langid.WINDOW]) for a in at]
    got = langid._sample(frame, 20)
    assert sorted(zip(got.lang, got.doc_id, map(bytes, got.bytes))) == sorted(expected)


def test_topk(spark):
    rng = random.Random(8)
    rows = [(k, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(6)]) for k in range(260)]
    rows += [(300, None), (301, [1.0] * 5 + [None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (5, rows[5][1]), (400, [])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    ok = [(k, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, a in dict(ok).items():
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), k) for k, b in ok if k != q)[:10]
            want |= {(q, n + 1): (k, -s) for n, (s, k) in enumerate(best)}
    assert got == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mixing(spark, edge, empty):
    rng = random.Random(5)
    docs = [(k, "w " * int(rng.paretovariate(1.2) * 10), rng.choice(["a", "b", "c", None, "￿", "\U00010000"])) for k in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(frame).toPandas()
    assert (rows.taken <= 3 * rows["size"]).all()
    assert rows.set_index("doc_id")["size"].to_dict() == {d: len(t.split()) for d, t, _ in docs}
    by = rows.groupby(rows.source.fillna("~null")).agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.told).all() and ((by.taken - by.target).abs() <= np.maximum(30, 0.01 * by.target)).all()
    weights = {"a": 1, "b": 2, "c": 3, "￿": 1, "\U00010000": 2, "~null": 3}
    free = by[by.target < 3 * by["size"] - 1]
    assert len({round(t / weights[s], 3) for s, t in free.target.items()}) == 1 and abs(by.target.sum() - by["size"].sum()) < 1e-6 * by["size"].sum()
    again = mixing.mix(frame).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mixing.mix(edge).count() == len(EDGE) and mixing.mix(empty).count() == 0
    assert mixing.fill(10, np.array([1.0, 1.0, 2.0]), np.array([1.0, 9.0, 9.0])).tolist() == [1, 3, 6]


def test_chat(spark, empty):
    rows = [(1, 1, "assistant", "a<b [INST] %3C 100%"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "<|turn|>x\n<|end|></s>"), (2, 3, "assistant", ""), (None, 1, "we\nird", "é😀"), (3, 70, "assistant", "z"), (3, 2, "assistant", "y")]
    frame = spark.createDataFrame([r + ("clash",) for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(frame).collect()}
    assert set(got) == {1, 2, 3, None}
    for c in got:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c))
        told, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha(told), len(loss), sha(loss))
    ddl = "conv_id long, turn long, role string, parts array<struct<type string, text string, ref string, units long>>"
    parts = [("text", "see ", None, None), ("image", None, "s3://x/1.png", 4), ("audio", None, "a.wav", None), ("odd", "kept", None, None), ("document", None, None, 2)]
    out = chat.format_turns(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], ddl)).first()
    assert out.formatted == "<s><|turn|>user\nsee <|image|><|audio|>kept<|document|><|end|><|turn|>assistant\n<|end|></s>"
    assert [(a.type, a.ref, a.tokens) for a in out.attachments] == [("image", "s3://x/1.png", 1024), ("audio", "a.wav", 25), ("document", None, 1024)]
    assert out.expanded_tokens == 2073 and sum(m.chars for m in out.mask) == len(out.formatted) - 7
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/ b", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (5, "u", "<p>other"), (5, "u", "<p>other"), (None, "u", "<p>other"), (None, "u", "lone"), (6, "v", "x" * 300_000)]
    frame = spark.createDataFrame([p + ("clash",) for p in pages], "page_id long, url string, html string, payload_digest string")
    rows = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.round_trip(frame).collect())
    want = collections.Counter()
    for page, _, html in pages:
        raw = (html or "").encode()
        ids = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        again = bool(ids) and page != max(ids)
        want[(page, len(raw), "revisit" if again else "response", max(ids) if again else None, warc.digest(raw))] += 1
    assert rows == want
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    big = warc.round_trip(frame, min_revisit_bytes=5).where("record_type = 'revisit'").select("page_id").collect()
    assert sorted(r.page_id or 0 for r in big) == [0, 1]


def test_salvage():
    records = [warc.record(k, f"http://h/{k}", f"page {k}".encode() * 50) for k in range(6)]
    data = b"".join(records)
    assert len(warc.salvage(data).records) == 6 and not warc.salvage(data).gaps
    at = len(records[0]) + len(records[1])
    broken = bytearray(data)
    broken[at + 40 : at + 50] = b"\xff" * 10
    got = warc.salvage(bytes(broken))
    assert [r.headers["warc-target-uri"][-1] for r in got.records] == list("01345") and got.gaps[0][:2] == (at, at + len(records[2]))
    cut = warc.salvage(b"junk" + data[: at + 30])
    assert len(cut.records) == 2 and cut.gaps[0][:2] == (0, 4) and cut.gaps[-1][:2] == (at + 4, at + 34)
    plain = zlib.decompress(records[0], 31)
    mixed = plain + b"garbage WARC/1.1 not" + records[1] + zlib.decompress(records[2], 31)
    got = warc.salvage(mixed)
    assert len(got.records) == 3 and got.gaps[0][:2] == (len(plain), len(plain) + 20)
    wrong = plain.replace(b"page 0page", b"page Xpage", 1)
    assert not warc.salvage(wrong).records


def test_language_prediction_depends_on_the_text_alone():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdé fgh\n", k=n)) for n in (1, 5, 63, 64, 65, 100, 700, 3000)]
    net = langid.Network(3, 4)
    buf, off, _ = textnp.utf8(pa.array(texts))
    beside = langid.label(net, buf, off)
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert (langid.label(net, raw, np.array([0, len(raw)])) == beside[k]).all()
        # by hand: one window after the other, with its context
        total = np.zeros(3)
        for s in range(0, len(raw), langid.WINDOW):
            low, high = max(0, s - langid.CONTEXT), min(len(raw), s + langid.WINDOW + langid.CONTEXT)
            a = net.logits(raw[low:high, None])[:, :, 0]
            p = np.exp(a - a.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            total += p[s - low : s - low + min(langid.WINDOW, len(raw) - s)].sum(0)
        assert np.allclose(total / len(raw), beside[k], atol=1e-5)


def test_language_training_masks_what_is_outside_of_a_text():
    net = langid.Network(3, 4)
    net.p = {k: a.astype(float) for k, a in net.p.items()}
    codes, lang, live = np.random.default_rng(0).integers(97, 122, (9, 5)), np.array([0, 1, 2, 0, 1]), np.ones((9, 5), bool)
    live[:2, 1] = live[6:, 2] = live[:3, 3] = live[7:, 3] = False
    _, g = net.step(codes, lang, live)
    for k in ("xf", "uf", "ub", "vb", "c"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][i] += 1e-4
        high = net.step(codes, lang, live)[0]
        net.p[k][i] -= 2e-4
        low = net.step(codes, lang, live)[0]
        net.p[k][i] += 1e-4
        assert abs((high - low) / 2e-4 - g[k][i]) < 1e-4


@pytest.mark.skipif(not os.path.exists(f"{DATA}/sf0.1"), reason="needs the driver's tables")
def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    rows = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    n, right = rows.selectExpr("count(*)", "count_if(lang = lang_pred)").first()
    assert n > 1500 and right >= 0.99 * n


def test_loss_text_is_cut_by_the_runs_of_the_mask(spark):
    rows = [(1, k, "assistant" if k % 3 == 1 else "user", "é😀<%[x" * (k % 5)) for k in range(700)]
    out = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    r = chat.read_back(out).first()
    assert r.loss_text == "".join(t for _, _, role, t in rows if role == "assistant")
    # a mask that counts one point more of a head and one less of its body moves the loss text by that point
    moved = F.transform("mask", lambda m, i: F.struct((m["chars"] + F.when(i % 3 == 0, 1).when(i % 3 == 1, -1).otherwise(0)).alias("chars"), m["loss"].alias("loss")))
    other = chat.masked_text(out.withColumn("mask", moved)).first()
    at, want = len(chat.OPEN), []
    for m in other["mask"]:
        if m.loss:
            want.append(other.formatted[at : at + m.chars])
        at += m.chars
    assert other.masked == want


def test_labels_have_one_meaning(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choices(["good", "plain", "word", "is", "the"] if k % 2 else ["X1", "zz!", "9"], k=80))) for k in range(400)]
    docs += [(1, "the plain word")] * 50
    labels = [(k, k % 2, 0) for k in range(400)] + [(k, 1, 0) for k in range(0, 400, 4)]
    frame, told = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = sorted(quality.judge(frame, told).select("doc_id", "n_words", "kept", "quality").collect())
    two = sorted(quality.judge(frame.orderBy(F.desc("doc_id")), told.orderBy(F.desc("doc_id"))).select("doc_id", "n_words", "kept", "quality").collect())
    assert one == two and len(one) == 450


def test_salvage_inside_of_a_member():
    plain = [zlib.decompress(warc.record(k, f"u{k}", f"page {k} ".encode() * 30), 31) for k in range(4)]
    broken = plain[1].replace(b"page 1 page", b"page X page", 1)
    together = gzip.compress(plain[0] + broken + plain[2], mtime=0)
    data = together + warc.record(9, "u9", b"nine")
    got = warc.salvage(data)
    assert [r.headers["warc-target-uri"] for r in got.records] == ["u0", "u2", "u9"]
    assert got.gaps == [(0, len(together), "payload digest differs")]
    cut = gzip.compress(plain[0] + plain[1] + os.urandom(5000), 0, mtime=0)[:-3000]
    got = warc.salvage(cut)
    assert [r.headers["warc-target-uri"] for r in got.records] == ["u0", "u1"] and got.gaps[0][0] == 0
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>"
    http = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{warc.digest(b'<p>')}\r\nContent-Length: {len(body)}\r\n\r\n"
    got = warc.salvage(http.encode() + body + b"\r\n\r\n")
    assert [(r.payload, r.http[:8]) for r in got.records] == [(b"<p>", b"HTTP/1.1")] and not got.gaps


def test_salvage_is_linear():
    began = time.time()
    assert len(warc.salvage(b"".join(warc.record(k, "u", b"x" * 20) for k in range(20_000))).records) == 20_000
    good = b"".join(warc.record(k, "u", os.urandom(3000)) for k in range(2000))
    got = warc.salvage(b"\x1f\x8b\x08zz" * 20_000 + good)
    assert len(got.records) == 2000 and got.gaps[0][:2] == (0, 100_000)
    bomb = gzip.compress(bytes(200 << 20), mtime=0)
    assert time.time() - began < 60 and len(bomb) < 1 << 20


def test_damaged_archive_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}") for k in range(50)], "page_id long, url string, html string")
    listing = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/a")
    path = listing.first().path.removeprefix("file:").replace("//", "/")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2 : len(data) // 2 + 20] = b"\xff" * 20
    open(path, "wb").write(bytes(data))
    rows = warc.read_archives(listing).groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in rows}["gap"] >= 1
    with pytest.raises(Exception, match="of 50 records"):
        warc.read_archives(listing, whole=True).count()


def test_mixing_slices_in_pages(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(k, "w " * rng.randint(1, 30), "hot" if k % 3 else "b") for k in range(4000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    plain = sorted(mixing.mix(frame).select("doc_id", "taken").collect())
    monkeypatch.setattr(mixing, "PAGE", 1)
    assert sorted(mixing.mix(frame).select("doc_id", "taken").collect()) == plain


def test_mixing_draws_in_rank_order(spark):
    rng = random.Random(9)
    docs = [(k, "w " * rng.randint(1, 60), rng.choice("abc")) for k in range(2500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(frame).toPandas()
    u = {r.doc_id: r.u for r in frame.select("doc_id", shared.uniform(F.col("doc_id"), mixing.SEED).alias("u")).collect()}
    groups = collections.defaultdict(lambda: [0, 0])
    for _, t, s in docs:
        n = len(t.split())
        groups[s, int(np.floor(np.log2(n)))][0] += 1
        groups[s, int(np.floor(np.log2(n)))][1] += n
    made = mixing.plan(pd.DataFrame([(s, c, n, w) for (s, c), (n, w) in sorted(groups.items())], columns=["source", "length_class", "n", "words"]))
    steps = {(r.source, r.length_class): r for r in made.itertuples()}
    want = {}
    for s in "abc":
        ranked, left = [], None
        for d, t, source in docs:
            if source == s:
                n = len(t.split())
                step = steps[s, int(np.floor(np.log2(n)))]
                want[d], left = step.whole, step.rest if left is None else left
                if step.p > 0:
                    odds = np.log(u[d] / (1 - u[d])) - np.log(step.p / (1 - step.p))
                    ranked.append((odds, d, n))
        skipped = []
        for _, d, n in sorted(ranked):
            if n <= left and len(skipped) < 1:
                want[d], left = want[d] + 1, left - n
            else:
                skipped.append((n, d))
    # up to the slice in which the words run out the draw is the ranking itself
    got = rows.set_index("doc_id").copies.to_dict()
    assert sum(got[d] != want[d] for d in want) <= 0.02 * len(docs)


def test_dropping_lines_is_linear_in_a_text(spark):
    lines = [f"line of {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} here" for k in range(12_000)]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(1, text, "x"), (2, text, "x"), (3, "only this one stays\n" + text, "x")], "doc_id long, text string, n_lines string")
    began = time.time()
    rows = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert rows[1].text == text and rows[2].n_dropped == 12_000 and rows[3].text == "only this one stays" and time.time() - began < 120
    assert rows[3].n_lines == 12_001 and set(rows[1].asDict()) == {"doc_id", "text", "n_lines", "n_dropped"}


def classes_by_hand(docs, threshold=0.8):
    """doc_id -> class id, over all pairs."""
    up = {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = [(d, bag(t)) for d, t in docs]
    for k, (a, x) in enumerate(bags):
        for b, y in bags[:k]:
            if x and y and sum((x & y).values()) >= threshold * sum((x | y).values()):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in docs}


@pytest.mark.parametrize("block", [1, 3, 8])
def test_big_groups_by_a_star_and_the_rest(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{j}" for j in range(120)]
    docs = []
    for k in range(60):  # chains away from one text: near ones, far ones, and links among the far
        words = list(rng.choice(docs)[1].split() if docs and rng.random() < 0.7 else base)
        for _ in range(rng.choice([1, 2, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    rng.shuffle(docs)
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == classes_by_hand(docs) and len(set(got.values())) < 60


def test_rows_without_an_id_link_like_others(spark):
    base = [f"w{j}" for j in range(100)]

    def text(*changed):
        return " ".join(f"x{k}" if k in changed else w for k, w in enumerate(base))

    # 1 and 2 are linked only through the text that has no id
    docs = [(1, text(10, 11, 12, 13)), (None, text()), (None, text()), (2, text(70, 71, 72, 73)), (None, "alone in the world of texts")]
    rows = bagminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in rows) == [(0, 0, 1), (0, 1, 4), (0, 1, 4), (1, 1, 4), (2, 1, 4)]


@pytest.mark.skipif(not os.path.exists(f"{DATA}/sf0.01"), reason="needs the driver's tables")
def test_recall_on_the_tables(spark):
    """Every pair of sf0.01 that shares a shingle, by exact overlaps."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    bags = {d: bag(t) for d, t in docs}
    holders, up = collections.defaultdict(list), {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, x in bags.items():
        for g in x or ():
            holders[g].append(d)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    linked = [(a, b) for a, b in pairs if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())]
    for a, b in linked:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert linked and sum(got[a] == got[b] for a, b in linked) >= 0.99 * len(linked)
    assert all(find(d) == find(c) for d, c in got.items())  # nothing is linked that should not be
