"""The pipeline's stages, each on its own input, and run(), against plain Python."""

import collections
import os
import random
import re

import pandas as pd
import pytest

import corpus_pipeline as P
from bytecarve.llm import mixing, packing, quality, queries, tokens

DATA = "/root/testdata"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, row string, copies int, text_key string, __id int"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


def corpus():
    """Null and blank texts, repeated rows, one doc_id with two texts, no doc_id, near copies, shared lines, a long text."""
    rng = random.Random(12)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, words(rng, 30_000), "b")]
    plain = [words(rng, 60) for _ in range(30)]
    rows += [(10 + k, t, rng.choice(["a", "b", "c", None])) for k, t in enumerate(plain)]
    rows += [(60 + k, t + " " + words(rng, 2), "b") for k, t in enumerate(plain[:8])]  # near copies
    rows += [(80, plain[9], "a"), (80, words(rng, 70), "a"), (81, words(rng, 50), "c"), (81, words(rng, 50), "c")]
    rows += [(None, plain[10], "a"), (None, words(rng, 40), "b"), (90, plain[11], "a"), (90, plain[11], "a")]
    shared = words(rng, 12)
    rows += [(100 + k, f"{words(rng, 30)}\n{shared}\n{words(rng, 30)}", "c") for k in range(5)]
    rows += [(110, "too short", "c"), (111, "spam spam " * 40, "c")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with columns whose names clash with those of the operators."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, t, "en", s, len(t or ""), "r", 7, "k", 0) for d, t, s in corpus()], DDL).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(frame):
    return collections.Counter((r.doc_id, r.text, r.source) for r in frame.collect())


def bag(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def near_by_hand(rows):
    """One row of each class, by all pairs."""
    words_ = sorted(collections.Counter(r for r in rows if bag(r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    up = list(range(len(words_)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(words_):
        for j, y in enumerate(words_[:i]):
            a, b = bag(x[1]), bag(y[1])
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return collections.Counter(words_[k] for k in range(len(words_)) if find(k) == k) + collections.Counter(r for r in rows if not bag(r[1]))


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(d, t, s) for d, t, s in corpus()]

    def failed(t):
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        return len(w) < 20 or 100 * len({i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}) > 30 * len(w)

    kept = P.quality_rules(spark, docs, folder)
    assert kept.columns == P.COLUMNS and rows_of(kept) == collections.Counter(r for r in rows if not failed(r[1]))

    lines = P.line_dedup(spark, docs, folder)
    told = {(r.doc_id, r.text): r.n_chars for r in lines.collect()}
    shared = corpus()[-7][1].split("\n")[1]
    holders = {d for d, t in told if t and shared in t.split("\n")}
    assert lines.columns == P.COLUMNS and holders == {100} and all(n == len(t or "") for (d, t), n in told.items() if d in range(100, 105))
    # the lone lines of copies in two documents go from 50 words on
    assert (10, corpus()[4][1]) in told and told[1, None] == 0

    near = P.near_dedup(spark, docs, folder)
    assert near.columns == P.COLUMNS and rows_of(near) == near_by_hand(rows)

    mixed = P.mix_sources(spark, docs, folder)
    copies = {(r.doc_id, r.source, r.text_key): max(r.copies, r["size"] == 0) for r in mixing.mix(docs).collect()}
    got = rows_of(mixed)
    assert mixed.columns == P.COLUMNS and sum(got.values()) >= sum(copies.values()) and max(got.values()) <= 6
    assert {r for r in rows if not WORD.search(r[1] or "")} <= set(got)
    assert rows_of(P.mix_sources(spark, docs, folder)) == got

    packed = P.pack_sequences(spark, docs, folder).toPandas()
    encoder = tokens.PieceEncoder(tokens.public_path(packing.TOKENIZER), False).tokenizer
    size = collections.Counter()
    for d, t, _ in rows:
        size[d] += len(encoder.encode(t or "", add_special_tokens=False).ids) + 1
    assert packed.groupby(packed.doc_id.fillna(-1)).length.sum().astype(int).to_dict() == {-1 if d is None else d: n for d, n in size.items()}


def test_stages_take_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_run_is_its_stages_and_leaves_no_folders(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), "doc_id long, text string, lang string, source string, n_chars long")
    want = packing.pack(docs).toPandas()
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    out = P.run(spark, folder)
    got = out.toPandas()
    assert sorted(map(str, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(str, want[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)))
    assert got.sequence_id.nunique() == want.sequence_id.nunique()
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and os.listdir(os.path.join(base, left.pop())) == [str(len(P.STAGES) - 1)]


@pytest.mark.skipif(not os.path.exists(f"{DATA}/sf0.001"), reason="needs the driver's tables")
def test_every_query_gives_its_columns(spark):
    import duckdb

    base = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "conversations", "labels"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    told, sql = queries.queries(), queries.oracle_sql()
    n = int(base.sql("SELECT count(*) AS n FROM documents").df().n[0])
    assert len(told) == 11
    for name, query in told.items():
        frame = query(spark, f"{DATA}/sf0.001").toPandas()
        if name in sql:
            want = base.sql(sql[name]).df()
            assert plain_rows(frame) == plain_rows(want), name
        elif name not in ("op6_pack_best_fit", "pipeline"):
            assert len(frame) == n, name
        if name == "op4_quality_rules":
            want = base.sql(BASE).df().set_index("doc_id")
            got = frame.set_index("doc_id")
            for column in want.columns:
                assert (got[column].sort_index() == want[column].sort_index()).all(), column
        if name == "op3_mix_sources":
            want = base.sql(SIZES).df().set_index("doc_id")["size"].to_dict()
            assert frame.set_index("doc_id")["size"].to_dict() == want and abs(frame.taken.sum() - sum(want.values())) < 0.02 * sum(want.values()) + 1000
        if name == "op7_token_output":
            frame = frame.sort_values("doc_id")
            assert frame.start.tolist() == (frame.n_tokens.cumsum() - frame.n_tokens).tolist()


def plain_rows(frame):
    return sorted(str([None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in row]) for row in frame[sorted(frame)].itertuples(index=False))


SIZES = r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents"
BASE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(8) t(j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)"""
