"""GIF round trips and composition, WARC records, token-id files."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import gif, warc
from barlab.llm.gif import Frame, decode, encode, frame_table, lzw_decode, lzw_encode, media_of, samples, store
from barlab.llm.token_files import default_tokenizer, encoder_of, pack, read_ids, read_token_files, unpack, write_token_files
from barlab.llm.warc import Archive, original_records, read_archive, write_archive

DOC = "doc_id bigint, text string, feature string, body string, file int"
TEXTS = [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "zß中\U0001f600" * 50, "\0\0\0", "line\n" * 30000, "a", "  two  spaces \n\t and odd　white space  ", "don't I'll <|endoftext|> 123456 İẞ é"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i * 7, t, "clash", "clash", 0) for i, t in enumerate(texts)], DOC)


# GIF


@pytest.mark.parametrize("size", range(2, 9))
def test_lzw_round_trip(size):
    rng = np.random.default_rng(size)
    for n in (1, 2, 3, 100, 5000, 40000):
        for pixels in (rng.integers(0, 1 << size, n), np.zeros(n, int), np.arange(n) // 7 % (1 << size)):
            raw = pixels.astype(np.uint8).tobytes()
            assert lzw_decode(lzw_encode(raw, size), size, n) == raw


def test_known_stream():
    # ten pixels of a 10 x 10 sample image that is often printed to explain the format
    stream = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    pixels = lzw_decode(stream, 2, 100)
    assert len(pixels) == 100 and list(pixels[:10]) == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2] and list(pixels[30:40]) == [1, 1, 1, 0, 0, 0, 0, 2, 2, 2]


def test_disposal_and_transparency():
    red, blue = 1, 2
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 0, 255]) + bytes(253 * 3)
    full = lambda v, n=4: np.full((n, n), v, np.uint8)
    frames = [Frame(0, 0, 4, 4, full(red), None, 5, 1), Frame(1, 1, 2, 2, full(blue, 2), None, 6, 3), Frame(0, 0, 2, 2, np.array([[blue, 0], [0, blue]], np.uint8), None, 7, 2, 0), Frame(3, 3, 1, 1, full(blue, 1), None, 8, 0)]
    (w, h), out = decode(encode(frames, (4, 4), palette))
    assert (w, h, [f.delay for f in out]) == (4, 4, [5, 6, 7, 8])
    r, b, nothing = (255, 0, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    at = lambda i, y, x: tuple(out[i].canvas[y, x])
    assert at(0, 0, 0) == r and at(1, 1, 1) == b and at(1, 0, 0) == r
    assert at(2, 1, 1) == b and at(2, 2, 2) == r and at(2, 0, 1) == r  # the second frame was taken back
    assert at(3, 0, 0) == nothing and at(3, 0, 1) == nothing and at(3, 3, 3) == b and at(3, 2, 2) == r


def test_interlaced_and_local_palette():
    rows = np.arange(16, dtype=np.uint8).repeat(3).reshape(16, 3)
    order = [*range(0, 16, 8), *range(4, 16, 8), *range(2, 16, 4), *range(1, 16, 2)]
    stream = lzw_encode(rows[order].tobytes(), 4)
    local = bytes(range(48))
    data = b"GIF87a" + struct.pack("<HHBBB", 3, 16, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 3, 16, 0x80 | 0x40 | 3) + local + b"\x04" + bytes([len(stream)]) + stream + b"\0;"
    _, (f,) = decode(data)
    assert (f.pixels == rows).all() and tuple(f.canvas[5, 0]) == (15, 16, 17, 255)


def test_texts_come_back(spark):
    for text in TEXTS:
        raw = (text or "").encode()
        payload = samples(decode(store(raw))[1])
        assert payload[: len(raw)] == raw and len(payload) % 64 == 0 and len(payload) >= 64 and not payload[len(raw) :].strip(b"\0")
    rows = {r.doc_id: r for r in media_of(frame(spark)).collect()}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r, stored = rows[7 * i], store(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, sum(r.histogram)) == (len(stored), hashlib.sha256(stored).hexdigest(), len(payload))
    assert rows[14].feature == rows[63].feature and rows[0].feature == rows[7].feature
    assert media_of(frame(spark).limit(0)).count() == 0


def test_frame_table(spark):
    long = store(b"frame" * 40000)
    media = spark.createDataFrame([(1, bytearray(long), 1), (2, None, 1), (3, bytearray(b"GIF89a broken"), 1), (4, bytearray(b""), 1)], "media_id int, gif binary, frame int")
    rows = frame_table(media).orderBy("frame").collect()
    assert {r.id for r in rows} == {1} and [r.start for r in rows] == [gif.DELAY * i for i in range(len(rows))] and len(rows) == 4
    assert sum(map(sum, (r.histogram for r in rows))) == 200000


def test_media_are_stored(spark):
    media = gif.stored_media(frame(spark))
    assert media.inputFiles() and media_of(frame(spark)).inputFiles()  # read from a table, not from memory
    rows = {r.doc_id: r for r in media.collect()}
    assert {d: bytes(r.gif) for d, r in rows.items()} == {7 * i: store((t or "").encode()) for i, t in enumerate(TEXTS)}
    frames = frame_table(media, id_col="doc_id").filter("id = 56").orderBy("frame").collect()
    assert b"".join(bytes(f.pixels) for f in frames).rstrip(b"\0") == TEXTS[8].encode() and bytes(frames[0].palette) == gif.GRAY


def test_frame_table_composes(spark):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 0, 255]) + bytes(253 * 3)
    full = lambda v, n: np.full((n, n), v, np.uint8)
    frames = [Frame(0, 0, 4, 4, full(1, 4), None, 5, 1), Frame(1, 1, 2, 2, full(2, 2), None, 6, 3), Frame(0, 0, 2, 2, np.array([[2, 0], [0, 2]], np.uint8), None, 7, 2, 0), Frame(3, 3, 1, 1, full(2, 1), None, 8, 0)]
    media = spark.createDataFrame([(1, bytearray(encode(frames, (4, 4), palette)))], "media_id int, gif binary")
    rows = frame_table(media).orderBy("frame").collect()
    red, blue = 3 << 4, 3
    assert [(r.histogram[red], r.histogram[blue], r.transparent) for r in rows] == [(16, 0, 0), (12, 4, 0), (14, 2, 0), (11, 1, 4)]
    assert [(r.start, r.disposal, sum(r.histogram)) for r in rows] == [(0, 1, 16), (5, 3, 16), (11, 2, 16), (18, 0, 12)]


# WARC

PAGE = "page_id bigint, url string, html string, sha256 string, record_type int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], PAGE)


def warc_reader(data):
    """Records of a WARC file by the format's own rules, apart from our code: version line,
    named fields to an empty line, a block of Content-Length bytes, two line ends."""
    at, out = 0, []
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        assert version == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
        start, n = stop + 4, int(fields["Content-Length"])
        assert data[start + n : start + n + 4] == b"\r\n\r\n"
        out.append((fields, data[start : start + n]))
        at = start + n + 4
    return out


def test_archive_dates(spark):
    rows = spark.createDataFrame([(1, "u", "x", "2024-03-01 10:20:30"), (2, "u", "y", None)], "page_id bigint, url string, html string, at string")
    records = b"".join(bytes(r.record) for r in original_records(write_archive(rows, date_col="at")).orderBy("page_id").collect())
    assert [h["WARC-Date"] for h, _ in warc_reader(records)] == ["2024-03-01T10:20:30Z", "1970-01-01T00:00:00Z"]


def test_putting_records_together_moves_no_payload(spark):
    archive = write_archive(pages(spark, [(i, "u", f"body {i % 40}") for i in range(200)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = archive.responses.join(archive.payloads, "sha256")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_archive_round_trip(spark):
    rows = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>two</p>"), (3, None, "<p>one</p>"), (4, "http://c/\r\nX: y", None), (5, "", ""), (6, "u", "é" * 100000), (7, "v", "\r\n\r\nWARC/1.1\r\n")]
    archive = write_archive(pages(spark, rows))
    found = {r.page_id: r for r in read_archive(archive).collect()}
    last = {(b or ""): p for p, _, b in rows}
    for p, _, b in rows:
        body = (b or "").encode()
        r, to = found[p], last[b or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if p == to else ("revisit", to))
    assert archive.payloads.count() == 5
    records = {r.page_id: bytes(r.record) for r in original_records(archive).collect()}
    assert records[7].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and records[7].endswith(b"\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\n\r\n")
    assert b"WARC-Refers-To: <urn:page:3>" in records[1] and b"\r\nX: y" not in records[4]
    read = warc_reader(b"".join(records[p] for p in sorted(records)))
    assert len(read) == 7 and all(h["WARC-Date"] == "1970-01-01T00:00:00Z" for h, _ in read)
    for (h, block), (p, url, b) in zip(read, rows, strict=True):
        to = last[b or ""]
        assert h["WARC-Record-ID"] == f"<urn:page:{p}>" and block == ((b or "").encode() if p == to else b"")
        assert h["WARC-Type"] == ("response" if p == to else "revisit") and h.get("WARC-Refers-To", "<urn:page:>") == ("<urn:page:>" if p == to else f"<urn:page:{to}>")


def test_archive_edges(spark):
    same = pages(spark, [(None, "u", "x"), (None, "u", "x"), (3, "u", "y"), (3, "u", "y"), (2, "u", "y")])
    rows = read_archive(write_archive(same)).collect()
    assert len(rows) == 5 and sorted((str(r.page_id), r.record_type) for r in rows) == [("2", "revisit"), ("3", "response"), ("3", "response"), ("None", "response"), ("None", "response")]
    assert {r.record_type for r in read_archive(write_archive(same, least_bytes=2)).collect()} == {"response"}
    assert read_archive(write_archive(same.limit(0))).count() == 0


def test_damage_is_found(spark):
    a = write_archive(pages(spark, [(1, "u", "body")]))
    with pytest.raises(Exception, match="damaged payload"):
        read_archive(Archive(a.responses, a.revisits, a.payloads.withColumn("body", F.lit(b"other")))).collect()


# token-id files


def test_pack_and_unpack():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000, 90000):
        ids = (rng.pareto(0.3, n) * 3).clip(0, 70000).astype(np.uint32)
        cut = sorted(rng.integers(0, n + 1, 3).tolist())
        lengths = np.diff([0, *cut, n]).tolist()
        docs, got, back = unpack(pack([5, None, -2, 1 << 40], lengths, ids))
        assert docs == [5, None, -2, 1 << 40] and got.tolist() == lengths and (back == ids).all()
    with pytest.raises(ValueError):
        unpack(b"????" + bytes(20))


def whole(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_encoder_equals_the_library(spark):
    rng = np.random.default_rng(12)
    marks = list("aAbé ßß中 \n\t\r.,'!?-_0123 <|> 　\U0001f600  ́‍")
    odd = ["".join(rng.choice(marks, int(rng.integers(0, 60)))) for _ in range(1500)]
    odd += ["it's we'll they've I'd 'tis ''s", "<|endoftext|>a <|endoftext|> b", " lead", "trail ", "  ", "\n\n a\n b", "a\n\nb\n \nc", *[t or "" for t in TEXTS]]
    encoder = encoder_of(default_tokenizer())
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder(odd)]
    assert got == whole(odd)


@pytest.mark.parametrize("range_bytes", [1 << 25, 40_000])
def test_files_round_trip(spark, range_bytes):
    docs = frame(spark, [*TEXTS, *["word " * n for n in range(0, 400, 7)]])
    files = write_token_files(docs, default_tokenizer(), range_bytes=range_bytes)
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want, start = {}, 0
    for r, ids in zip(rows, whole([r.text for r in rows]), strict=True):
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(files).collect()} == want
    assert {r.doc_id: len(r.ids) for r in read_ids(files).collect()} == {d: n for d, (_, n, _) in want.items()}


def test_file_edges(spark):
    docs = frame(spark, ["b", "a"]).withColumn("doc_id", F.lit(4).cast("bigint"))
    rows = read_token_files(write_token_files(docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("bigint"))), default_tokenizer())).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in rows] == [(None, 0), (None, 2), (4, 4), (4, 6)]
    assert read_token_files(write_token_files(docs.limit(0), default_tokenizer())).count() == 0


def test_damaged_gifs_give_no_frames(spark):
    good = gif.store(b"some text")
    no_palette = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes([0, 0, 0, 0, 1, 0, 1, 0, 0]) + b"\x02\x02\x44\x01\x00;"
    huge = good[:-1].replace(bytes([0x2C, 0, 0, 0, 0, 64, 0, 1, 0]), bytes([0x2C, 0, 0, 0, 0, 255, 255, 255, 255]))
    bad_size = good.replace(bytes([0x2C, 0, 0, 0, 0, 64, 0, 1, 0, 0, 8]), bytes([0x2C, 0, 0, 0, 0, 64, 0, 1, 0, 0, 12]))
    assert len({good, huge, bad_size}) == 3
    rows = [(0, good), (1, no_palette), (2, huge), (3, bad_size), (4, good[:40]), (5, b""), (6, None), (7, b"GIF89a")]
    assert {r.id for r in gif.frame_table(spark.createDataFrame(rows, "media_id int, gif binary")).collect()} == {0}


def test_code_sizes_that_the_format_lacks():
    for size in (0, 1, 9):
        with pytest.raises(ValueError):
            gif.lzw_decode(b"\x44\x01", size, 4)


def test_archives_have_a_file_for_each_bucket_and_leave_no_table(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 90}</p>") for i in range(400)], "page_id bigint, url string, html string").repartition(23)
    archive = warc.write_archive(pages)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(archive.responses.inputFiles()) <= buckets and len(archive.payloads.inputFiles()) <= buckets
    assert archive.responses.count() == 90 and archive.revisits.count() == 310
    archive.drop()
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op5_warc(spark, str(tmp_path)).count() == 400
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("barlab_")]


def outside_decoder(data):
    """A GIF's frames as (indices, palette, delay), read from the format's description by
    nothing of the library: codes as bit strings, the table as a list of byte strings."""
    assert data[:6] in (b"GIF87a", b"GIF89a")
    flags, at = data[10], 13
    shared = data[at : at + 3 * 2 ** ((flags & 7) + 1)] if flags & 0x80 else None
    at += len(shared or b"")
    delay, out = 0, []
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                delay = int.from_bytes(data[at + 4 : at + 6], "little")
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        assert data[at] == 0x2C
        w, h, flags = int.from_bytes(data[at + 5 : at + 7], "little"), int.from_bytes(data[at + 7 : at + 9], "little"), data[at + 9]
        at += 10
        own = data[at : at + 3 * 2 ** ((flags & 7) + 1)] if flags & 0x80 else shared
        at += len(own) if flags & 0x80 else 0
        size, at, body = data[at], at + 1, b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        bits, pos, clear = int.from_bytes(body, "little"), 0, 1 << size
        words, width, last, pixels = [], size + 1, None, bytearray()
        while True:
            code = (bits >> pos) & ((1 << width) - 1)
            pos += width
            if code == clear:
                words, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
                continue
            if code == clear + 1:
                break
            if last is None:
                word = words[code]
            else:
                word = words[code] if code < len(words) else last + last[:1]
                if len(words) < 4096:
                    words.append(last + word[:1])
            pixels += word
            last = word
            if len(words) == 1 << width and width < 12:
                width += 1
        assert len(pixels) == w * h
        out.append((bytes(pixels), own, delay))
    return out


def test_media_against_an_outside_decoder(spark):
    """The stored bytes are a GIF whose gray levels are the text, and the feature counts them."""
    texts = ["", None, "short", "ab" * 4000, "ü€ " * 30_000, "".join(map(chr, range(1, 300))) * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    media = {r.doc_id: bytes(r.gif) for r in gif.stored_media(docs).collect()}
    rows = {r.doc_id: r for r in gif.media_of(docs).collect()}
    for i, text in enumerate(texts):
        frames = outside_decoder(media[i])
        payload = b"".join(bytes(p[3 * x] for x in pixels) for pixels, p, _ in frames)
        raw = (text or "").encode()
        assert payload == raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        bins = {}
        for pixels, p, _ in frames:
            for x in pixels:
                r, g, b = (v >> (8 - gif.HISTOGRAM_BITS) for v in p[3 * x : 3 * x + 3])
                k = r << 2 * gif.HISTOGRAM_BITS | g << gif.HISTOGRAM_BITS | b
                bins[k] = bins.get(k, 0) + 1
        feature = f"{len(frames)}:{sum(d for _, _, d in frames)}:" + ",".join(f"{k}={n}" for k, n in sorted(bins.items()))
        got = rows[i]
        assert (got.feature, got.media_bytes, got.media_sha256) == (feature, len(media[i]), hashlib.sha256(media[i]).hexdigest())
        assert (got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
