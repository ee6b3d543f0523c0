"""Archives, token files and media: exact round trips, damage, odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import statistics
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialmart.llm import files, media, queries, tokenfile, tokens, warc

PAGES = "page_id long, url string, html string, key long, file string"
PAGE = "<p>é</p>" * 40
ODD = [
    (3, "http://a/x", PAGE, 1, ""),
    (1, "http://a/y z", PAGE, 1, ""),
    (1, "http://a/y z", PAGE, 1, ""),
    (None, "http://a/n", PAGE, 1, ""),
    (4, None, None, None, None),
    (5, "http://b", "", 1, ""),
    (6, "http://b", "short", 1, ""),
    (7, "http://b", "short", 1, ""),
    (8, "http://c", "WARC/1.1\r\nx\r\n\r\n" * 50_000, 1, ""),
]


def test_warc_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    first, want = {}, set()
    for p, html in sorted(zip(pages.page_id, pages.html, strict=True)):
        data = html.encode()
        digest = hashlib.sha256(data).hexdigest()
        old = first.setdefault(digest, p) if len(data) >= 100 else p
        want.add((p, len(data), digest, "response" if old == p else "revisit", None if old == p else old))
    assert {tuple(r) for r in queries.op2_warc(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("compress", [True, False])
def test_warc_odd_rows_and_damage(spark, compress):
    df = spark.createDataFrame(ODD, PAGES)
    manifest = warc.write_archives(df.coalesce(1), compress, archive_bytes=1 << 30)
    rows = warc.read_archives(manifest, with_payload=True).collect()
    kinds = sorted((r.key or 0, r.record_type, r.refers_to) for r in rows)
    assert [k for k in kinds if k[1] == "revisit"] == [(3, "revisit", 1)]
    assert len(rows) == len(ODD) and not any(r.gap for r in rows)
    assert {r.payload_digest for r in rows if r.key in (1, 3)} == {hashlib.sha256(PAGE.encode()).hexdigest()}
    assert warc.write_archives(df.limit(0)).count() == 0
    for r in manifest.collect():
        raw = bytearray(files.read_file(r.file))
        whole = list(warc.salvage(bytes(raw)))
        if len(whole) < 3:
            continue
        hit = (whole[1][0] + whole[1][1]) // 2
        raw[hit] ^= 0x55
        junk = bytes(raw[: whole[0][1]]) + b"WARC/1.1\r\njunk" + bytes(raw[whole[0][1] :]) + b"\x1f\x8b\x08cut"
        got = list(warc.salvage(junk))
        assert [g[:2] for g in got if g[2] is None] == [
            (whole[0][1], whole[1][1] + 14),
            (len(raw) + 14, len(raw) + 20),
        ]
        assert [g[2] for g in got if g[2]] == [w[2] for i, w in enumerate(whole) if i != 1]
        assert [g[0] for g in got] == sorted(g[0] for g in got) and got[-1][1] == len(junk)


def test_foreign_archive_by_sparks_reader(spark, tmp_path):
    page = warc.make_record(9, "http://z", PAGE.encode(), None)
    (tmp_path / "a.warc.gz").write_bytes(b"noise" + page + page[:-9])
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.gap is None, r.end - r.start) for r in rows] == [(False, 5), (True, len(page)), (False, len(page) - 9)]
    assert bytes(rows[1].payload).decode() == PAGE and rows[1].url == "http://z"


def record(kind, block, content_type, payload=None, label="sha1", block_label="md5"):
    """A record as other writers make them, with digests of their own."""
    digest = lambda data, how: f"{how}:" + base64.b32encode(hashlib.new(how, data).digest()).decode()
    head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    head += [f"WARC-Block-Digest: {digest(block, block_label)}"]
    head += [f"WARC-Payload-Digest: {digest(block if payload is None else payload, label)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_kinds_and_digests(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    parts = [
        record("warcinfo", b"software: x\r\n", "application/warc-fields"),
        record("resource", PAGE.encode(), "text/html", label="sha512"),
        record("metadata", b"a: b\r\n\r\nc: d", "application/warc-fields", label="md5"),
        record("response", http, "application/http; msgtype=response", http.split(b"\r\n\r\n", 1)[1]),
        record("response", http, "application/http; msgtype=response", b"hello"),
    ]
    changed = parts[1].replace(b"<p>", b"<q>", 1)
    bare = record("response", http, "application/http", b"other", label="sha256")
    (tmp_path / "a.warc").write_bytes(b"".join([*parts, changed, bare]))
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("start").collect()
    assert [r.record_type for r in rows] == ["warcinfo", "resource", "metadata", "response", "response", None, None]
    assert [r.gap for r in rows[5:]] == ["block digest", "payload digest"]
    assert rows[1].payload_digest == hashlib.sha256(PAGE.encode()).hexdigest() and bytes(rows[2].payload) == b"a: b\r\n\r\nc: d"


def test_member_of_several_records(spark, tmp_path):
    one, two = record("resource", b"first", "text/plain"), record("resource", b"second", "text/plain")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one + b"junk" + two) + gzip.compress(two))
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("start", F.coalesce("inner", F.lit(1))).collect()
    assert [(bytes(r.payload) if r.payload else None, r.inner) for r in rows if r.gap is None] == [(b"first", 0), (b"second", len(one) + 4), (b"second", None)]
    gaps = [r.gap for r in rows if r.gap]
    assert gaps == [f"version line, bytes {len(one)} to {len(one) + 4} of the member"]


def test_junk_is_searched_once():
    junk = (b"WARC/1.1\r\n" + b"\x1f\x8b\x08" + b"x" * 20) * 30_000
    began = time.perf_counter()
    got = list(warc.salvage(junk + record("resource", b"late", "text/plain")))
    assert [g[2] is None for g in got] == [True, False] and time.perf_counter() - began < 20


def test_token_file_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    tok, at, want = tokens.tokenizer_for(queries.VOCABULARY), 0, set()
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*tok.tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.add((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert {tuple(r) for r in queries.op9_token_files(spark, sf_dir).collect()} == want


def test_token_files_odd_rows(spark):
    docs = [(5, "a b"), (5, "a b"), (None, "c"), (2, None), (3, ""), (4, "word " * 5000), (6, "中文")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1))
    manifest, ranks = tokenfile.write_token_files(df, queries.VOCABULARY, 2, file_tokens=10)
    rows = tokenfile.read_token_files(manifest, ranks).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 2, 3, 4, 5, 5, 6]
    assert [r.n_tokens for r in rows][1:4] == [1, 1, 5001]
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in rows)
    assert ranks.orderBy("rank").first().n == 5000
    none = tokenfile.write_token_files(df.limit(0), queries.VOCABULARY)
    assert tokenfile.read_token_files(*none).count() == 0


def test_end_ids_beyond_two_bytes_and_other_tokenizers(spark, tmp_path):
    df = spark.createDataFrame([(1, "A b"), (2, "")], "doc_id long, text string")
    rows = tokenfile.read_token_files(*tokenfile.write_token_files(df, queries.VOCABULARY, 70_000)).orderBy("doc_id").collect()
    assert [r.ids[-1] for r in rows] == [70_000, 70_000] and rows[1].n_tokens == 1
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(queries.VOCABULARY)
    other.normalizer = normalizers.NFC()  # without lower-casing
    path = str(tmp_path / "other.json")
    other.save(path)
    assert tokens.tokenizer_for(queries.VOCABULARY).known and not tokens.tokenizer_for(path).known
    for text in ("A b", "ABC's é", ""):
        assert tokens.tokenizer_for(path).encode(text) == np.array(other.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=60))
def test_byte_coding_round_trip(values):
    ranks = np.array(values, "<u4")
    control, data = tokenfile.encode_ranks(ranks)
    assert len(control) == -(-len(values) // 4)
    assert tokenfile.decode_ranks(control, data, len(values)).tolist() == values


def test_damaged_token_file_is_refused():
    raw = bytearray(tokenfile.encode_file([1, None], np.array([1, 2]), np.array([7, 70000, 300], np.uint32)))
    docs, lengths, ranks = tokenfile.decode_file(bytes(raw))
    assert (docs, lengths.tolist(), ranks.tolist()) == ([1, None], [1, 2], [7, 70000, 300])
    raw[40] ^= 1
    with pytest.raises(ValueError):
        tokenfile.decode_file(bytes(raw))


def test_media_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    rows = {r.doc_id: r for r in queries.op7_media(spark, sf_dir).collect()}
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        data = text.encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        if len(payload) < 20_000:
            bits = f"{int(r.feature, 16):064b}"
            assert len(r.feature) == 16 and all(b in ("?", bits[i]) for i, b in enumerate(plain_hash(payload))), d
    stored = {r.doc_id: bytes(r.media) for r in media.store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        png = stored[d]
        assert (rows[d].media_bytes, rows[d].media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        if len(text) < 20_000:
            assert plain_png(png) == text.encode() + b" " * (rows[d].payload_bytes - len(text.encode()))


def plain_png(raw):
    """A decoder of its own: chunks by their lengths, filters one number at a time."""
    assert raw[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data, header = 8, b"", None
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        assert int.from_bytes(raw[at + 8 + size : at + 12 + size], "big") == zlib.crc32(raw[at + 4 : at + 8 + size])
        header, data = (body if kind == b"IHDR" else header), data + (body if kind == b"IDAT" else b"")
        at += 12 + size
    assert kind == b"IEND" and header[8:] == bytes([8, 2, 0, 0, 0])
    width = 3 * int.from_bytes(header[:4], "big")
    flat = zlib.decompress(data)
    return bytes(x for row in reference_unfilter([flat[i : i + width + 1] for i in range(0, len(flat), width + 1)]) for x in row)


def plain_hash(payload):
    """The bits of the cosine-transform hash from its definition, ? where rounding decides."""
    grey = [[sum(payload[192 * y + 3 * x : 192 * y + 3 * x + 3]) for x in range(64)] for y in range(len(payload) // 192)]
    grey = [[row[2 * x] + row[2 * x + 1] for x in range(32)] for row in grey]
    n = len(grey)
    cuts = [i * n // 32 for i in range(32)] + [n]
    small = [[statistics.fmean(r[x] for r in grey[a : max(b, a + 1)]) for x in range(32)] for a, b in zip(cuts, cuts[1:], strict=False)]
    wave = [[math.cos(math.pi / 32 * (i + 0.5) * k) for i in range(32)] for k in range(8)]
    half = [[sum(w[y] * small[y][x] for y in range(32)) for x in range(32)] for w in wave]
    low = [sum(half[k][x] * w[x] for x in range(32)) for k in range(8) for w in wave]
    middle = statistics.median(low[1:])
    return ["?" if abs(v - middle) < 2e-6 else "1" if v > middle else "0" for v in low]


def test_media_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "x"), (4, "long é " * 40_000), (4, "long é " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("media", F.lit("clash"))
    rows = media.media_features(media.store_media(df), with_payload=True).collect()
    assert sorted(r.payload_bytes for r in rows) == [192, 192, 192, 320064, 320064]
    assert len({r.payload_sha256 for r in rows}) == 3
    assert media.media_features(media.store_media(df.limit(0))).count() == 0


def reference_unfilter(rows, bpp=3):
    out = []
    for kind, *row in rows:
        line, up = [], out[-1] if out else [0] * len(row)
        for i, x in enumerate(row):
            a, b, c = (line[i - bpp] if i >= bpp else 0), up[i], (up[i - bpp] if i >= bpp else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x + [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append(line)
    return out


def test_all_five_filters():
    rng = np.random.default_rng(2)
    for height in (1, 2, 40):
        rows = rng.integers(0, 256, (height, 13)).astype(np.uint8)
        rows[:, 0] = rng.integers(0, 5, height)
        assert media.unfilter(rows).tolist() == reference_unfilter(rows.tolist())


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=1500))
def test_png_round_trip_and_checks(data):
    payload = media.pad(data)
    raw = media.to_png(payload)
    assert media.from_png(raw) == payload
    broken = bytearray(raw)
    broken[len(raw) // 2] ^= 4
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(broken))


def test_near_equal_images_have_near_hashes():
    text = media.pad(b"the quick brown fox jumps over it " * 400)
    other = bytearray(text)
    other[5000:5010] = b"JUMPED OFF"
    a, b = (int(media.cosine_hash(bytes(x)), 16) for x in (text, other))
    assert (a ^ b).bit_count() <= 6
    assert io.BytesIO(media.to_png(text)).read(8) == media.SIGNATURE
