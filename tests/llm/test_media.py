import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tracewarden.llm.media import box, encode, encode_texts, full, index, payload_of, samples, tracks, walk
from tracewarden.llm.queries import op4_media


@pytest.mark.parametrize("size", [64, 128, 64 * 16, 64 * 17, 64 * 1000])
def test_round_trip(size):
    payload = bytes(k * 7 % 256 for k in range(size))
    media = encode(payload)
    (track,) = tracks(media)
    assert samples(media, track) == payload
    assert (track["codec"], track["handler"], track["timescale"], track["duration"]) == ("raw ", "soun", 8000, size)
    assert track["sizes"].tolist() == [64] * (size // 64)
    assert track["sync"].tolist() == list(range(0, size // 64, 16))
    mdat = next(s for p, s, e in walk(media) if p == (b"mdat",))
    assert track["offsets"].tolist() == list(range(mdat, mdat + size, 64))


@pytest.mark.parametrize("bad", [b"", b"x" * 63])
def test_bad_payload(bad):
    with pytest.raises(ValueError):
        encode(bad)


def test_tables_of_another_writer():
    """Two tracks, wide boxes, interleaved chunks of unequal samples, version 1 headers, no sync table in one track."""
    mdat = b"AAABBCCCCDxxxxEE"
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(mdat)) + mdat

    def trak(sizes, chunks, runs, stss, codec, handler):
        stbl = [
            full(b"stsd", struct.pack(">I", 1), box(codec, bytes(28))),
            full(b"stts", struct.pack(">IIIII", 2, 1, 10, len(sizes) - 1, 5)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)),
            full(b"co64", struct.pack(">I", len(chunks)), struct.pack(f">{len(chunks)}Q", *chunks)),
        ]
        if stss:
            stbl.append(full(b"stss", struct.pack(">I", len(stss)), struct.pack(f">{len(stss)}I", *stss)))
        mdhd = box(b"mdhd", bytes([1, 0, 0, 0]), struct.pack(">QQIQHH", 0, 0, 90000, 12345, 0, 0))
        return box(b"trak", box(b"mdia", mdhd, full(b"hdlr", bytes(4), handler, bytes(13)), box(b"minf", box(b"stbl", *stbl))))

    a = trak([3, 2, 1, 2], [16, 25, 30], [(1, 2, 1), (2, 1, 1)], [1, 3], b"avc1", b"vide")
    b = trak([4], [21], [(1, 1, 1)], None, b"mp4a", b"soun")
    data = head + box(b"free", b"junk") + box(b"moov", a, b)
    one, two = tracks(data)
    assert samples(data, one) == b"AAABBDEE" and samples(data, two) == b"CCCC"
    assert one["offsets"].tolist() == [16, 19, 25, 30] and one["times"].tolist() == [0, 10, 15, 20]
    assert one["sync"].tolist() == [0, 2] and two["sync"].tolist() == [0]
    assert (one["codec"], one["timescale"], one["duration"], two["codec"]) == ("avc1", 90000, 12345, "mp4a")


def test_broken_files():
    media = encode(payload_of("some text"))
    for cut in range(0, len(media)):
        tracks(media[:cut])
    for k in range(len(media)):
        tracks(media[:k] + b"\xff" + media[k + 1 :])
    assert tracks(None) == [] and tracks(b"plain text, no boxes") == []


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_media(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        payload = payload_of(docs[r.doc_id])
        media = encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((docs[r.doc_id] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature.startswith("raw |soun|8000|")


def test_nulls_repeats_clashing_columns_and_long_texts(spark):
    docs = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (2, "", "m"), (None, "é" * 1_000_000, "m")], "doc_id long, text string, media string")
    rows = index(encode_texts(docs), read_back=True).collect()
    assert sorted((str(r.doc_id), r.n_bytes, len(r.payload)) for r in rows) == [("1", 0, 64), ("2", 0, 64), ("2", 0, 64), ("None", 2_000_000, 2_000_000)]
    other = spark.createDataFrame([(1, bytearray(b"no media"), "t"), (2, None, "t")], "id long, media binary, tracks string")
    assert [(r.id, r.tracks, r.payload) for r in index(other, read_back=True).orderBy("id").collect()] == [(1, [], None), (2, [], None)]
    assert index(encode_texts(docs.limit(0))).count() == 0
    assert index(other).select(F.size("tracks")).count() == 2


def test_deep_nesting_ends_the_walk():
    data = b""
    for _ in range(1200):
        data = box(b"moov", data)
    assert len(data) == 9600 and tracks(data) == [] and max(len(p) for p, _, _ in walk(data)) == 32


def _movie(*more, stsz=None, offsets=(0,), entries=None):
    stbl = [
        full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(28))),
        full(b"stts", struct.pack(">I", 0) if entries is None else struct.pack(">III", 1, entries, 7)),
        full(b"stsc", struct.pack(">I", 0) if entries is None else struct.pack(">IIII", 1, 1, entries, 1)),
        stsz or full(b"stsz", struct.pack(">II", 0, 0)),
        full(b"co64", struct.pack(">I", 0) if entries is None else struct.pack(f">I{len(offsets)}Q", len(offsets), *offsets)),
    ]
    tkhd = full(b"tkhd", struct.pack(">III", 0, 0, 9), bytes(68))
    mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0))
    return box(b"moov", box(b"trak", tkhd, box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", box(b"stbl", *stbl)))), *more)


def test_fragments():
    """Sizes and marks from the runs, from the fragment's head and from the movie's defaults; a run that follows another."""
    head = box(b"ftyp", b"isom") + _movie(box(b"mvex", full(b"trex", struct.pack(">5I", 9, 1, 40, 3, 0x10000))))

    def fragment(at, base_flag):
        def made(offset):
            first = full(b"trun", struct.pack(">IiIIIII", 2, offset, 0, 10, 4, 20, 5), flags=0x1 | 0x4 | 0x100 | 0x200)  # first sample is a key frame
            second = full(b"trun", struct.pack(">I", 2))  # follows; 3 bytes and 40 units each by default
            tfhd = full(b"tfhd", struct.pack(">IQ", 9, at) if base_flag else struct.pack(">I", 9), flags=1 if base_flag else 0x20000)
            return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", tfhd, first, second))

        return made(len(made(0)) + 8)

    data, want = head, []
    for k, base_flag in enumerate((False, True)):
        part = fragment(len(data), base_flag)
        want.append(len(data) + len(part) + 8)
        data += part + box(b"mdat", f"{k}aaaBBBBBcccddd".encode())
    (t,) = tracks(data)
    assert samples(data, t) == b"0aaaBBBBBcccddd1aaaBBBBBcccddd"
    assert t["offsets"].tolist() == [w + o for w in want for o in (0, 4, 9, 12)] and t["sizes"].tolist() == [4, 5, 3, 3] * 2
    assert t["times"].tolist() == [0, 10, 30, 70, 110, 120, 140, 180] and t["duration"] == 220 and t["sync"].tolist() == [0, 4]
    for cut in range(len(head), len(data)):  # cut off anywhere: no crash, what came before stands
        (part,) = tracks(data[:cut])
        assert part["sizes"].tolist() == ([4, 5, 3, 3] * 2)[: len(part["sizes"])]


@pytest.mark.parametrize("width, raw", [(4, bytes([0x12, 0x30])), (8, bytes([1, 2, 3])), (16, bytes([0, 1, 0, 2, 0, 3]))])
def test_compact_sizes(width, raw):
    movie = lambda at: _movie(stsz=full(b"stz2", bytes([0, 0, 0, width]), struct.pack(">I", 3), raw), entries=3, offsets=(at,))
    data = movie(len(movie(0)) + 8) + box(b"mdat", b"abbccc")
    (t,) = tracks(data)
    assert t["sizes"].tolist() == [1, 2, 3] and samples(data, t) == b"abbccc"


def test_offsets_outside_the_file():
    size = full(b"stsz", struct.pack(">II", 4, 1))
    for at in (2**64 - 8, 2**63, 2**40):
        data = _movie(stsz=size, entries=1, offsets=(at,)) + box(b"mdat", b"abcd")
        (t,) = tracks(data)
        assert samples(data, t) == b"" and t["offsets"][0] > 0
