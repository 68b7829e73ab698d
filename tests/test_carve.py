"""The carver: walkers, matcher, selection, sources and sinks."""

import gzip
import hashlib
import json
import random
import struct
import time
import zlib
from collections import Counter

import pytest

from bytecarve.cli import main
from bytecarve.functions import samples as S
from bytecarve.functions.registry import SIGNATURES, resolve_types
from bytecarve.functions.view import View
from bytecarve.operators.scan import Matcher, Options, parse_size, scan
from bytecarve.operators.select import containment, skip_ahead
from bytecarve.operators.sinks import json_rows, write_files, write_manifest
from bytecarve.plans.carve import candidates, carve, carve_column, carve_counted, fold, make_options
from bytecarve.plans.sql import register
from bytecarve.sources.readers import BytesSource, EwfSource, SourceError, container_kind, open_source, segment_names
from bytecarve.streaming.incremental import carve_stream


def walk(kind, data, cap=None):
    return SIGNATURES[kind].walk(View(BytesSource(data).pread, len(data), 0, cap or len(data)), False)


@pytest.mark.parametrize("kind", sorted(S.SAMPLES))
def test_walker_finds_the_end(kind):
    data, ext = S.SAMPLES[kind]
    assert walk(kind, data + bytes(700)) == (len(data), ext, True)


@pytest.mark.parametrize("name", sorted(S.VARIANTS))
def test_extension(name):
    kind, data, ext = S.VARIANTS[name]
    assert walk(kind, data + b"\0" * 64) == (len(data), ext, True)


@pytest.mark.parametrize("kind", sorted(S.SAMPLES))
@pytest.mark.parametrize("cut", [2, 20, 10])
def test_truncated_never_exceeds_the_data(kind, cut):
    data = S.SAMPLES[kind][0]
    short = data[: len(data) // 2 if cut == 2 else len(data) - cut]
    found = walk(kind, short)
    assert found is None or found.size <= len(short)


def test_pdf_line_ends_and_rtf_junk():
    body = S.pdf()[:-1]
    for tail, extra in ((b"\n", 1), (b"\r", 1), (b"\r\n", 2), (b"A", 0)):
        assert walk("pdf", body + tail + bytes(64)).size == len(body) + extra
    assert walk("rtf", S.rtf() + b"TRAILING JUNK" * 8).size == len(S.rtf())
    assert walk("rtf", S.rtf()[:-1]) is None
    long = rb"{\rtf1 " + rb"\'e9\par " * 30_000 + b"}"
    assert walk("rtf", long + b"xyz").size == len(long)


def test_pst_bogus_and_zip_fragment():
    pst = bytearray(S.pst())
    struct.pack_into("<Q", pst, 0xB8, 1 << 60)
    found = walk("pst", bytes(pst))
    assert not found.validated and found.size <= len(pst)
    whole = S.zip_("word/document.xml", bytes(500))
    found = walk("zip", whole[:600])
    assert found is None or not found.validated


def test_mp4_wrapping_size_is_rejected():
    bad = S.mp4() + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", (1 << 64) - len(S.mp4()))
    assert walk("mp4", bad) is None


def test_matcher_is_leftmost_longest_without_overlap():
    m = Matcher(tuple(SIGNATURES))
    for buf in (b"\xff\xd8\xff\xd8\xff", bytes(3) + b"\1\0\0\1\0", b"GIF87aBMM\0*", b"{\\rtftyp", b"regftyp", b"OggSQLite format 3\0", b"SQLite format 3\0\0\1\0"):
        assert list(m.matches(buf)) == [(x.start(), x.group()) for x in m.pattern.finditer(buf)]
    rng = random.Random(5)
    parts = [x for s in SIGNATURES.values() for x in s.magics]
    for _ in range(200):
        buf = b"".join(rng.choice(parts)[: rng.randint(1, 16)] for _ in range(30))
        for m.STRIDE in (1, 7, 16, 1 << 18):
            assert list(m.matches(buf)) == [(x.start(), x.group()) for x in m.pattern.finditer(buf)]


def test_property_list_ends_at_the_last_trailer():
    one = S.plist()
    assert walk("plist", one + bytes(300)) == (len(one), "plist", True)
    assert walk("plist", one + b"\x01" * 90) == (len(one), "plist", True)
    assert walk("plist", one + one)[0] == len(one)
    assert walk("plist", one[:-1]) is None
    assert walk("plist", b"bplist00" + bytes(5000)) is None


def test_names_and_sizes():
    assert resolve_types("docs, JPEG ,,jpg") == ["ole", "zip", "pdf", "rtf", "jpg"]
    for bad in ("exe", "docs,jar"):
        with pytest.raises(ValueError, match="unknown type"):
            resolve_types(bad)
    with pytest.raises(ValueError):
        resolve_types(" , ")
    assert [parse_size(x) for x in ("12", " 3k ", "2M", "1g")] == [12, 3072, 2 << 20, 1 << 30]
    for bad in ("1.5M", "1KB", "", "-1"):
        with pytest.raises(ValueError, match="not a size"):
            parse_size(bad)


def planted(names, seed=7):
    rng = random.Random(seed)
    image, truth = bytearray(4096), []
    for n in names:
        image += bytes(rng.randrange(1, 40) for _ in range(rng.randrange(1000, 5000)))
        image += bytes(-len(image) % 512)
        truth.append((n, len(image), len(S.SAMPLES[n][0]), hashlib.sha256(S.SAMPLES[n][0]).hexdigest()))
        image += S.SAMPLES[n][0]
    return bytes(image + bytes(rng.randrange(1, 40) for _ in range(3000))), truth


@pytest.fixture(scope="module")
def image(tmp_path_factory):
    data, truth = planted(sorted(S.SAMPLES))
    path = tmp_path_factory.mktemp("image") / "disk.dd"
    path.write_bytes(data)
    return str(path), data, truth


@pytest.mark.parametrize("chunk", [1 << 16, 4097, 1 << 25])
def test_scan_is_the_same_for_every_chunk_size(image, chunk):
    _, data, truth = image
    found = fold(list(scan(BytesSource(data), Options(chunk_size=chunk))), True)
    assert [(c.type, c.offset, c.size) for c in found if c.validated] == [t[:3] for t in truth]


def test_carve_path(spark, image, tmp_path):
    path, data, truth = image
    for mode in ("serial", "parallel"):
        records = carve(spark, path, mode=mode, chunk_size=1 << 16, out_dir=str(tmp_path / mode))
        rows = sorted(records.collect(), key=lambda r: r.ord)
        assert [(r.type, r.offset, r.size, r.sha256) for r in rows] == truth
    assert write_files(records) == len(truth)
    for r in rows:
        with open(r.path, "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == r.sha256
    with open(write_manifest(records, path, 1.0, str(tmp_path))) as f:
        told = json.load(f)
    assert told["source_size"] == len(data) and len(told["files"]) == len(truth) and told["files"][0]["duplicate_of"] is None
    assert json_rows(records).count() == len(truth)


def test_duplicates_nested_and_options(spark, tmp_path):
    png, zipped = S.png(), S.zip_("img.png", S.png())
    twice = bytes(512) + png + bytes(512 - len(png) % 512) + png + bytes(64)
    frame = spark.createDataFrame([(1, twice), (2, bytes(512) + zipped + bytes(512)), (3, None), (4, b"")], "id long, data binary")
    rows = {(r.source_id, r.offset): r for r in carve_column(frame, "id", "data").collect()}
    second = 512 + len(png) + 512 - len(png) % 512
    assert set(rows) == {("1", 512), ("1", second), ("2", 512)}
    assert rows["1", second].duplicate_of == 512 and rows["1", 512].duplicate_of is None
    assert carve_column(frame, "id", "data", skip_carved=False).count() == 4
    assert carve_column(frame, "id", "data", mode="parallel").count() == 3
    assert carve_column(frame, "id", "data", types="png", align=512).count() == 1 + (second % 512 == 0)
    assert carve_column(frame, "id", "data", min_size=10_000).count() == 0


def test_selection_against_a_fold(spark):
    rng = random.Random(3)
    rows = []
    for source in range(30):
        for ordinal in sorted(rng.sample(range(5000), 40)):
            rows.append((str(source), ordinal, ordinal - rng.choice([0, 0, 4]), rng.randrange(1, 400), rng.random() < 0.7))
    frame = spark.createDataFrame(rows, "source_id string, ord long, offset long, size long, validated boolean")
    kept, covered = set(), set()
    for source in {r[0] for r in rows}:
        free = -1
        for r in sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], r[2])):
            if r[2] >= free:
                kept.add(r)
                if r[4]:
                    free = r[2] + r[3]
        cover = 0
        for r in sorted((r for r in rows if r[0] == source), key=lambda r: (r[2], -r[3], r[1])):
            if not (cover and r[2] + r[3] <= cover):
                covered.add(r)
                if r[4]:
                    cover = max(cover, r[2] + r[3])
    import bytecarve.operators.select as select

    for bucket, fold_rows in ((1 << 30, 1_000_000), (256, 1)):
        select.BUCKET, select.FOLD_ROWS = bucket, fold_rows
        assert {tuple(r) for r in skip_ahead(frame).select("source_id", "ord", "offset", "size", "validated").collect()} == kept
        assert {tuple(r) for r in containment(frame).select("source_id", "ord", "offset", "size", "validated").collect()} == covered
    select.BUCKET, select.FOLD_ROWS = 1 << 30, 1_000_000


def ewf(path, data, per_chunk=2, packed=True, extra=0):
    size = per_chunk * 512
    chunks = [data[k : k + size].ljust(size, b"\0") for k in range(0, len(data), size)]
    head = b"EVF\x09\x0d\x0a\xff\x00\x01" + struct.pack("<HH", 1, 0)

    def section(kind, body, at, last=False):
        following = at if last else at + 76 + len(body)
        return kind.ljust(16, b"\0") + struct.pack("<QQ", following, 76 + len(body)) + bytes(44) + body

    volume = bytearray(1052)
    struct.pack_into("<IIIIQ", volume, 0, 1, len(chunks) + extra, per_chunk, 512, -(-len(data) // 512))
    out = head + section(b"volume", bytes(volume), 13)
    at = len(out) + 76
    stored = [zlib.compress(c) if packed else c for c in chunks]
    offsets = [at + sum(map(len, stored[:k])) for k in range(len(stored))]
    out += section(b"sectors", b"".join(stored), len(out))
    out += section(b"table", struct.pack("<IIQII", len(chunks), 0, 0, 0, 0) + b"".join(struct.pack("<I", o | (packed << 31)) for o in offsets), len(out))
    out += section(b"done", b"", len(out), True)
    path.write_bytes(out)
    return str(path)


def test_ewf(spark, tmp_path):
    data = S.png() + bytes(k * 7 % 251 for k in range(9000)) + S.jpg()
    for packed in (True, False):
        source = open_source(ewf(tmp_path / f"a{packed}.E01", data, packed=packed))
        assert isinstance(source, EwfSource) and source.size == -(-len(data) // 512) * 512
        for at, n in ((0, len(data)), (100, 50), (900, 3000)):
            assert source.pread(at, n) == data[at : at + n]
    with pytest.raises(SourceError, match="incomplete EWF set"):
        open_source(ewf(tmp_path / "b.E01", bytes(8192), extra=40))
    path = ewf(tmp_path / "c.E01", bytes(1024) + S.png() + bytes(4096), 4)
    assert [(r.type, r.offset) for r in carve(spark, path).collect()] == [("png", 1024)]
    names = segment_names("E")
    first = [next(names) for _ in range(105)]
    assert (first[0], first[98], first[99], first[100], first[104]) == ("E01", "E99", "EAA", "EAB", "EAF")


def test_refused_containers(tmp_path):
    for name, magic in (("x.dd", b"QFI\xfb"), ("y.dd", b"KDMV"), ("z.dd", b"vhdxfile"), ("w.vhd", b"\0")):
        (tmp_path / name).write_bytes(magic + bytes(4096))
        with pytest.raises(SourceError, match="cannot read"):
            open_source(str(tmp_path / name))
    (tmp_path / "plain.e01").write_bytes(bytes(4096))
    with pytest.raises(SourceError, match="EWF"):
        open_source(str(tmp_path / "plain.e01"))
    (tmp_path / "empty.dd").write_bytes(b"")
    with pytest.raises(SourceError, match="cannot determine size"):
        open_source(str(tmp_path / "empty.dd"))
    assert container_kind("a.AFF", b"") == "AFF"


def test_gzip_bomb_stays_bounded():
    data = gzip.compress(bytes(20 << 20), mtime=0)
    assert walk("gz", data + b"rest").size == len(data)


@pytest.mark.parametrize("name", sorted(S.LOOSE))
def test_loose_end(name):
    kind, data, ext, size = S.LOOSE[name]
    assert walk(kind, data + bytes(300)) == (size or len(data) + 300, ext, False)


@pytest.mark.parametrize("name", sorted(S.REJECTED))
def test_rejected_header(name):
    kind, data = S.REJECTED[name]
    assert not [c for c in scan(BytesSource(bytes(16) + data + bytes(300)), Options(types=(kind,))) if c.size]


def test_directory_of_a_zip_that_runs_off_the_end():
    short = S.zip_("word/document.xml")
    body = len(b"stored, not packed") + 30 + len("word/document.xml")
    assert walk("zip", short[: body + 46]) == (body, "docx", False)


def test_rtf_strides_begin_anew_behind_raw_data():
    stride = 1 << 16
    escaped = b"{\\rtf1 " + b"a" * (stride - 8) + b"\\}" + b" tail}"
    assert walk("rtf", escaped + b"x").size == len(escaped)
    lost = SIGNATURES["rtf"].walk(View(BytesSource(escaped).pread, len(escaped), 0, len(escaped)), True)
    assert lost.size == stride + 1  # the brace behind the cut escape closes the group
    moved = b"{\\rtf1 \\bin3 abc" + b"a" * (stride - 16) + b"\\}" + b" tail}"
    for parity in (False, True):  # the stride begins behind the raw data, so its end cuts nothing
        assert SIGNATURES["rtf"].walk(View(BytesSource(moved).pread, len(moved), 0, len(moved)), parity).size == len(moved)


def nested_heads(rng, size):
    """Headers of sizes of their own, dropped anywhere into filler: carves overlap and nest at random."""
    data = bytearray(rng.randrange(1, 40) for _ in range(size))
    for _ in range(60):
        at = rng.randrange(size - 100)
        n = rng.choice([80, 300, 1500, 6000])
        head = S.patched(S.bmp()[:54], 2, struct.pack("<I", n)) if rng.random() < 0.8 else S.riff()[:12].replace(S.riff()[4:8], struct.pack("<I", n - 8))
        data[at : at + len(head)] = head
    for _ in range(8):
        at = rng.randrange(size - 200)
        data[at : at + len(S.mp4())] = S.mp4()
    return bytes(data[:size])


def test_hidden_candidates_come_back_if_the_outer_carve_is_dropped(spark, tmp_path):
    rng = random.Random(11)
    woken = 0
    for k in range(6):
        data = nested_heads(rng, 30_000)
        path = tmp_path / f"{k}.dd"
        path.write_bytes(data)
        want = [(c.type, c.offset, c.size) for c in fold(list(scan(BytesSource(data), Options(skip_carved=False, chunk_size=1024))), True)]
        rows = sorted(carve(spark, str(path), chunk_size=1024, chunks_per_task=rng.choice([1, 2, 5])).collect(), key=lambda r: r.ord)
        assert [(r.type, r.offset, r.size) for r in rows] == want
        alone = [c for part in range(0, 30, 2) for c in scan(BytesSource(data), Options(chunk_size=1024), part, 2)]
        woken += fold(alone, True) != fold(list(scan(BytesSource(data), Options(skip_carved=False, chunk_size=1024))), True)
        assert [(c.type, c.offset, c.size) for c in sorted((c for c in scan(BytesSource(data), Options(chunk_size=1024)) if c.size), key=lambda c: c.ord)] == want
    assert woken  # the rows that tasks find by themselves would not do


def test_files_with_many_nested_headers_are_walked_once():
    page = b"OggS\0\0" + bytes(8) + struct.pack("<III", 1, 0, 0) + bytes((1, 5)) + b"abcde"
    ogg = page * 100_000
    local = [b"PK\3\4" + struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 0, 0, 4, 4, 1, 0) + b"nbody" for _ in range(50_000)]
    head = b"".join(local)
    central = b"".join(b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 20, 20, 0, 0, 0, 0, 0, 4, 4, 1, 0, 0, 0, 0, 0, 35 * k) + b"n" for k in range(len(local)))
    zipped = head + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0, 0, len(central), len(head), 0)
    for kind, data in (("ogg", ogg), ("zip", zipped), ("gz", gzip.compress(b"x", mtime=0) * 20_000)):
        began = time.time()
        found = [c for c in scan(BytesSource(data), Options()) if c.size]
        assert [(c.type, c.offset, c.size) for c in found] == [(kind, 0, len(data))] and time.time() - began < 20


def test_noise_gives_nothing_sure():
    data = random.Random(1234).randbytes(8 << 20)
    assert not [c for c in scan(BytesSource(data), Options()) if c.validated]


def test_counters_and_sources_in_one_folder(spark, tmp_path):
    paths = []
    for k in range(2):
        data = bytes(3 * 4096) + S.png() + bytes(1000) + S.REJECTED["png"][1] + b"x" + bytes([k]) * 5000
        paths.append(str(tmp_path / f"{k}" / "same.dd"))
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "same.dd").write_bytes(data)
    records, counters = carve_counted(spark, paths, "png", out_dir=str(tmp_path / "out"), chunk_size=4096)
    last = (3 * 4096 + len(S.png()) + 1000 + 20 + 1 + 5000) % 4096  # the first image ends in a part of a chunk of zeros
    assert {(r.source_id, r.rejected, r.blank_bytes, r.corrupt_chunks) for r in counters.collect()} == {(paths[0], 1, 3 * 4096 + last, 0), (paths[1], 1, 3 * 4096, 0)}
    assert write_files(records) == 2 and len(list((tmp_path / "out").rglob("*.png"))) == 2
    uri = carve(spark, "file://" + paths[0], "png").collect()
    assert [(r.offset, r.size) for r in uri] == [(3 * 4096, len(S.png()))]


def test_ewf_segments_and_corrupt_chunks(spark, tmp_path):
    raw = tmp_path / "a.dd"
    data = bytes(1024) + S.png() + random.Random(2).randbytes(40_000) + S.jpg() + bytes(300)
    raw.write_bytes(data)
    first = S.ewf_set(str(raw), str(tmp_path / "a.E01"), per_chunk=2, segments=4)
    source = open_source(first[0])
    assert source.segments == 4 and source.pread(0, len(data)) == data and source.describe() == " (EWF, 4 segments)"
    assert {(r.type, r.offset) for r in carve(spark, first[0], "png,jpg").collect() if r.validated} == {("png", 1024), ("jpg", 1024 + len(S.png()) + 40_000)}
    with open(first[1], "r+b") as f:
        f.seek(source.place[source.segment_of == 1][0] + 2)
        f.write(b"\xff" * 20)
    with pytest.raises(SourceError, match="is corrupt"):
        open_source(first[0]).pread(0, len(data))
    records, counters = carve_counted(spark, first[0], "png,jpg", on_corrupt="skip", chunk_size=1 << 16)
    assert records.where("validated").count() == 2 and counters.first().corrupt_chunks == 1
    (tmp_path / "a.E03").unlink()
    with pytest.raises(SourceError, match="incomplete EWF set"):
        open_source(first[0])


def test_small_ewf_chunks_are_inflated_once(tmp_path, monkeypatch):
    import bytecarve.sources.readers as readers

    raw = tmp_path / "a.dd"
    data = random.Random(3).randbytes(400_000)
    raw.write_bytes(data)
    first = S.ewf_set(str(raw), str(tmp_path / "a.E01"), segments=3)[0]
    inflated = []
    real = readers.zlib.decompressobj
    monkeypatch.setattr(readers.zlib, "decompressobj", lambda: inflated.append(1) or real())
    source = open_source(first)
    for at in range(0, 330_000, 5000):  # long reads that overlap, as walks of near candidates make them
        assert source.pread(at, 1 << 16) == data[at : at + (1 << 16)]
    assert len(inflated) <= source.chunks
    with open(first, "r+b") as f:
        f.seek(source.place[20] + 2)
        f.write(b"\xff" * 20)
    source = open_source(first)  # a corrupt chunk fails where it is read, not beside it
    assert source.pread(0, 20 * 1024) == data[: 20 * 1024] and source.pread(21 * 1024, 90_000) == data[21 * 1024 :][:90_000]
    with pytest.raises(SourceError, match="chunk 20 is corrupt"):
        source.pread(20 * 1024, 1)


def test_search_begins_short():
    from bytecarve.functions.view import View

    data, read = bytes(100) + b"needle" + bytes(3_000_000) + b"far", []
    view = View(lambda at, n: read.append(n) or data[at : at + n], len(data), 0, len(data))
    assert view.find(b"needle", 0) == 100 and sum(read) <= 1 << 16
    assert view.find(b"far", 0) == len(data) - 3 and view.find(b"none", 0) == -1


def test_many_ranges_share_tasks(spark, tmp_path):
    path = tmp_path / "a.dd"
    path.write_bytes((bytes(3000) + S.png() + bytes(1000) + S.zip_("x", S.png())) * 60)
    o = make_options("png,zip", chunk_size=512)
    found = candidates(spark, str(path), o)
    assert found.rdd.getNumPartitions() <= 40
    assert found.where("type = 'png' and size > 0").select("offset").distinct().count() >= 60
    whole = {tuple(r) for r in carve(spark, str(path), "png,zip").select("type", "offset", "size", "sha256").collect()}
    assert {tuple(r) for r in carve(spark, str(path), "png,zip", chunk_size=512).select("type", "offset", "size", "sha256").collect()} == whole and len(whole) == 120


def test_range_holds_whole_files(spark):
    data, n = bytes(1000) + S.png() + bytes(1000), len(S.png())
    frame = spark.createDataFrame([("a", data)], "id string, data binary")
    for cut in range(n + 3):  # the range ends ``cut`` bytes behind the file's start
        found = carve_column(frame, "id", "data", "png", start=500, length=500 + cut).collect() if cut in (0, n - 5, n, n + 2) else None
        rows = [(c.offset, c.size) for c in scan(BytesSource(data), make_options("png", start=500, length=500 + cut)) if c.size]
        assert rows == ([(1000, n)] if cut >= n else [])
        assert found is None or [(r.offset, r.size) for r in found] == rows
    whole = [(c.offset, c.size) for c in scan(BytesSource(data), make_options("png", start=500, length=499 + n, parity=True)) if c.size]
    assert whole == [(1000, n)]  # the original reads on past the range


@pytest.mark.parametrize("name", ["containment", "dedup", "skip_ahead"])
def test_first_of_equal_lines_stays(spark, tmp_path, name):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from bytecarve.plans.queries import oracle_sql, queries

    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for k, n in enumerate((40, 4000)):  # the second file is the larger one and has other quantities and flags
        rows = range(1, n + 1)
        table = {"l_orderkey": list(rows), "l_partkey": [i % 5 for i in rows], "l_linenumber": [1] * n, "l_quantity": [float(1 + (i + 7 * k) % 50) for i in rows], "l_returnflag": ["ANR"[(i + k) % 3] for i in rows]}
        pq.write_table(pa.table(table, pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_quantity", pa.float64()), ("l_returnflag", pa.string())])), folder / f"part-{k}.parquet")
    con = duckdb.connect()
    con.execute("SET threads=1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    assert Counter(tuple(r) for r in queries()[name](spark, str(tmp_path)).collect()) == Counter(con.execute(oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name, odd", [(n, x) for n in ("dedup", "skip_ahead") for x in ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "fraction") if n + x != "skip_aheadl_partkey"])
def test_odd_lines_as_in_sql(spark, tmp_path, name, odd):
    """Lines without one of their values, or with a quantity that is no whole number."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from bytecarve.plans.queries import oracle_sql, queries

    rnd = random.Random(5)
    kinds = {"l_orderkey": pa.int64(), "l_partkey": pa.int64(), "l_linenumber": pa.int32(), "l_quantity": pa.float64(), "l_returnflag": pa.string()}
    rows = [{"l_orderkey": i * 3, "l_partkey": i % 13, "l_linenumber": rnd.randint(1, 7), "l_quantity": rnd.randint(1, 40) / 1000, "l_returnflag": rnd.choice("ANR")} for i in range(2600)]
    for row in rows:
        if odd == "fraction":
            row["l_quantity"] = rnd.choice((0.5, 1.5, 2.7, 0.000125, 0.000375))
        elif rnd.random() < 0.01:
            row[odd] = None
    if odd == "l_orderkey":
        rows.append({**rows[0], "l_partkey": 99, odd: None})  # alone in its part
    pq.write_table(pa.Table.from_pylist(rows, pa.schema(list(kinds.items()))), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads=1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert Counter(tuple(r) for r in queries()[name](spark, str(tmp_path)).collect()) == Counter(con.execute(oracle_sql()[name]).fetchall())


def test_unknown_size_ends_the_sweep(spark):
    import bytecarve.operators.select as select

    rows = [("a", 0, 0, 10, True), ("a", 5, 5, 9, True), ("a", 20, 20, None, True), ("a", 30, 30, 1, False), ("a", 900, 900, 1, True), ("a", None, None, 5, True), ("b", 3, 3, None, False), ("b", 4, 4, 1, True)]
    frame = spark.createDataFrame(rows, "source_id string, ord long, offset long, size long, validated boolean")
    for bucket, fold_rows in ((1 << 30, 1_000_000), (256, 1)):
        select.BUCKET, select.FOLD_ROWS = bucket, fold_rows
        got = skip_ahead(frame).select("source_id", "ord", "size").collect()
        assert {tuple(r) for r in got} == {("a", 0, 10), ("a", 20, None), ("b", 3, None), ("b", 4, 1)}
    select.BUCKET, select.FOLD_ROWS = 1 << 30, 1_000_000


def test_offset_filters_leave_tasks_out(spark, image):
    path, data, truth = image
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        o = make_options(None, chunk_size=4096, skip_carved=False)
        every = {(r.type, r.offset) for r in candidates(spark, path, o).where("type is not null and size > 0").collect()}
        some = candidates(spark, path, o).where("offset >= 50000 and offset < 60000 and size > 0")
        assert {(r.type, r.offset) for r in some.collect()} == {x for x in every if 50000 <= x[1] < 60000}
        assert some.rdd.getNumPartitions() <= 5 < candidates(spark, path, o).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_command_line(spark, image, tmp_path, capsys):
    path, data, truth = image
    assert main(["--list-types"]) == 0 and "office" in capsys.readouterr().out
    assert main([]) == 2 and main([str(tmp_path / "none.dd")]) == 2
    with pytest.raises(SystemExit):
        main(["--nonsense", path])
    assert main([path, "-o", str(tmp_path / "out"), "-j", "2", "--chunk", "64K"]) == 0
    told = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert [(f["type"], f["offset"], f["size"], f["sha256"]) for f in told["files"]] == truth
    assert all(hashlib.sha256(open(f["path"], "rb").read()).hexdigest() == f["sha256"] for f in told["files"])
    capsys.readouterr()
    assert main([path, "-t", "mkv", "--length", "4K", "--dry-run", "-o", str(tmp_path / "dry")]) == 0
    assert json.loads(capsys.readouterr().out)["files"] == [] and not (tmp_path / "dry").exists()


def test_stream_of_files(spark, tmp_path):
    twice = bytes(64) + S.png() + bytes(64)
    spark.createDataFrame([(1, twice), (2, S.pdf())], "id long, data binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, data binary").parquet(str(tmp_path / "in"))
    got = []
    carve_stream(stream, "id", "data", lambda records, epoch: got.extend(records.collect()), f"file://{tmp_path}/state", types="png,pdf").awaitTermination()
    assert sorted((r.source_id, r.type, r.offset) for r in got) == [("1", "png", 64), ("2", "pdf", 0)]


def test_table_function(spark, image):
    path, data, truth = image
    register(spark, carve(spark, path))
    rows = spark.sql("SELECT r.size AS a, c.size AS b FROM carve_records r, LATERAL carve_at(r.source_id, r.type, r.offset, 0L) c").collect()
    assert len(rows) == len(truth) and all(r.a == r.b for r in rows)
    assert spark.sql("SELECT * FROM carve_signatures").count() == 23
    assert spark.sql(f"SELECT * FROM carve_at('{path}', 'png', 1L, 0L)").count() == 0
