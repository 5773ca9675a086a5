"""ISO media containers (ISO/IEC 14496-12) as columns.

``encode`` stores bytes as the 8-bit samples of an audio track. ``index`` walks any file's nested boxes, decodes its
sample tables and the runs of its fragments and gives codec, duration and the byte ranges of its key frames without decoding, or even reading, the
payload; ``samples`` reads a track's stored bytes back through the tables.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import slices

UNIT, UNITS_PER_CHUNK, RATE, DEEPEST = 64, 16, 8000, 32
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"))
TRACK = "struct<handler:string,codec:string,timescale:long,duration:long,samples:long,bytes:long,keyframes:array<struct<offset:long,size:long,time:long>>>"


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
_HDLR = full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0")
_SMHD, _DINF = full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
_STSD = full(b"stsd", struct.pack(">I", 1), box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16)))


def encode(payload: bytes) -> bytes:
    """A file with ``payload`` (a positive multiple of 64 bytes) as 8-bit samples: units of 64, chunks of 16 units, the first of each a sync sample."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    units, size = len(payload) // UNIT, len(payload)
    chunks = -(-units // UNITS_PER_CHUNK)
    whole, rest = divmod(units, UNITS_PER_CHUNK)
    runs = ([(1, UNITS_PER_CHUNK, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    wide = size >= 1 << 31

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (UNIT * UNITS_PER_CHUNK)
        sync = 1 + np.arange(chunks, dtype=np.int64) * UNITS_PER_CHUNK
        duration = min(size, 0xFFFFFFFF)
        stbl = box(
            b"stbl",
            _STSD,
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
            full(b"stss", struct.pack(">I", chunks), sync.astype(">u4").tobytes()),
        )
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, duration, 0x55C4, 0)), _HDLR, box(b"minf", _SMHD, _DINF, stbl))
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0x0100, 0), _MATRIX, bytes(8), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, duration, 0x10000, 0x0100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    mdat = box(b"mdat", payload)
    head = _FTYP + moov(0)  # its size doesn't depend on the offsets
    return _FTYP + moov(len(head) + len(mdat) - size) + mdat


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of each box's content, containers before what they hold. A box that runs past its parent ends the
    walk there, and so does one that lies deeper than ``DEEPEST``: no file has a use for that."""
    open_boxes: list[tuple[int, int, tuple[bytes, ...]]] = [(start, len(data) if end is None else end, ())]
    while open_boxes:
        start, end, path = open_boxes.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            continue
        here = (*path, kind)
        yield here, start + head, start + size
        open_boxes.append((start + size, end, path))
        if kind in CONTAINERS and len(here) < DEEPEST:
            open_boxes.append((start + head, start + size, here))


def _table(data: bytes, at: int, end: int, columns: int, skip: int = 4, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, at + skip)[0]
    width = np.dtype(kind).itemsize * columns
    n = min(n, max(0, end - at - skip - 4) // width)
    found = np.frombuffer(data, kind, n * columns, at + skip + 4)
    return np.minimum(found.astype(np.uint64), np.uint64(2**62)).astype(np.int64).reshape(n, columns)  # an offset beyond any file stays beyond it


def _clipped(counts: np.ndarray, total: int) -> np.ndarray:
    """The counts, cut where their sum passes the total: a broken table can't ask for more than there is."""
    return np.diff(np.r_[0, np.minimum(np.cumsum(np.minimum(counts, total)), total)])


def _sizes(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Of each sample: one for all, a table of 32 bits each, or of 4, 8 or 16."""
    if b"stz2" in boxes:
        at, end = boxes[b"stz2"]
        width, count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        raw = np.frombuffer(data[at + 12 : end], np.uint8)
        if width == 4:
            found = np.column_stack([raw >> 4, raw & 15]).ravel()
        else:
            found = raw if width == 8 else raw[: len(raw) // 2 * 2].view(">u2")
        return found[:count].astype(np.int64)
    at, end = boxes[b"stsz"]
    fixed, count = struct.unpack_from(">II", data, at + 4)
    return np.full(min(count, len(data) // fixed), fixed, np.int64) if fixed else _table(data, at, end, 1, skip=8)[:, 0]


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict | None:
    """What the tables of a track say: per sample its offset, size and time. None if one is missing."""
    if not {b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc"} <= boxes.keys() or not ({b"stco", b"co64"} & boxes.keys()) or not ({b"stsz", b"stz2"} & boxes.keys()):
        return None
    at = boxes[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    sizes = _sizes(data, boxes)
    chunks = _table(data, *boxes[b"stco"], 1)[:, 0] if b"stco" in boxes else _table(data, *boxes[b"co64"], 1, kind=">u8")[:, 0]
    runs = _table(data, *boxes[b"stsc"], 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1])) if len(runs) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(per_chunk)), _clipped(per_chunk, len(sizes)))
    sizes = sizes[: len(owner)]
    before = np.cumsum(sizes) - sizes
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    offsets = chunks[owner] + before - np.repeat(before[first], np.diff(np.r_[first, len(owner)])) if len(owner) else before
    steps = _table(data, *boxes[b"stts"], 2)
    deltas = np.repeat(steps[:, 1], _clipped(steps[:, 0], len(sizes)))
    times = np.cumsum(deltas) - deltas
    sync = _table(data, *boxes[b"stss"], 1)[:, 0] - 1 if b"stss" in boxes else np.arange(len(sizes))
    sync = sync[(sync >= 0) & (sync < min(len(sizes), len(times)))]
    text = lambda at: data[at : at + 4].decode("latin-1")
    number = struct.unpack_from(">I", data, boxes[b"tkhd"][0] + (20 if data[boxes[b"tkhd"][0]] == 1 else 12))[0] if b"tkhd" in boxes else 0
    return {"id": number, "handler": text(boxes[b"hdlr"][0] + 8), "codec": text(boxes[b"stsd"][0] + 12), "timescale": timescale, "duration": min(duration, 2**63 - 1), "offsets": offsets, "sizes": sizes, "sync": sync, "times": times, "end": int(deltas.sum())}


def _run(data: bytes, at: int, end: int, head: dict) -> dict[str, np.ndarray] | None:
    """The samples of a track run: sizes, durations, whether each is a key frame, and where they start."""
    flags, count = struct.unpack_from(">II", data, at)
    flags &= 0xFFFFFF
    at += 8
    start = None
    if flags & 1:
        start, at = struct.unpack_from(">i", data, at)[0], at + 4
    leading = None
    if flags & 4:
        leading, at = struct.unpack_from(">I", data, at)[0], at + 4
    fields = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if fields:
        count = min(count, (end - at) // (4 * len(fields)))
    else:
        count = min(count, len(data) // max(1, head["size"]))
    table = np.frombuffer(data, ">u4", count * len(fields), at).reshape(count, len(fields)).astype(np.int64)
    of = {name: table[:, k] for k, name in enumerate(fields)}
    marks = of.get("flags", np.full(count, head["flags"], np.int64)).copy()
    if leading is not None and count:
        marks[0] = leading
    sizes, steps = (of.get(name, np.full(count, head[name], np.int64)) for name in ("size", "duration"))
    return {"sizes": sizes, "steps": steps, "sync": marks & 0x10000 == 0, "start": start}


def _fragments(data: bytes, found: list[dict], defaults: dict[int, tuple[int, int, int]]) -> None:
    """Append the samples of movie fragments to the tracks that they name."""
    by_id = {t["id"]: t for t in found if t["id"]}
    moof = current = None
    for path, at, end in walk(data):
        if path == (b"moof",):
            moof, current = at - 8, None
        elif path[:2] == (b"moof", b"traf") and moof is not None:
            if path[-1] == b"traf":
                current = None
            elif path[-1] == b"tfhd":
                flags, number = struct.unpack_from(">II", data, at)
                duration, size, marks = defaults.get(number, (0, 0, 0))
                current, at = {"track": by_id.get(number), "base": moof, "duration": duration, "size": size, "flags": marks}, at + 8
                if flags & 1:
                    current["base"], at = min(struct.unpack_from(">Q", data, at)[0], 2**62), at + 8
                at += 4 * bool(flags & 2)
                for bit, name in ((8, "duration"), (16, "size"), (32, "flags")):
                    if flags & bit:
                        current[name], at = struct.unpack_from(">I", data, at)[0], at + 4
                current["next"] = current["base"]
            elif path[-1] == b"trun" and current and current["track"]:
                run, t = _run(data, at, end, current), current["track"]
                begin = current["next"] if run["start"] is None else current["base"] + run["start"]
                offsets = begin + np.cumsum(run["sizes"]) - run["sizes"]
                clock = t["end"]
                ends = clock + np.cumsum(run["steps"])
                t["sync"] = np.r_[t["sync"], len(t["sizes"]) + np.flatnonzero(run["sync"])].astype(np.int64)
                t["offsets"], t["sizes"], t["times"] = np.r_[t["offsets"], offsets], np.r_[t["sizes"], run["sizes"]], np.r_[t["times"], ends - run["steps"]]
                current["next"] = int(begin + run["sizes"].sum())
                t["end"] = int(ends[-1]) if len(ends) else clock
                t["duration"] = max(t["duration"], t["end"])


def tracks(data: bytes | None) -> list[dict]:
    """The tracks of a file, by their tables and by its fragments. What isn't such a file, or is cut off before its tables, has none."""
    data = data or b""
    found: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragmented = False
    for path, start, end in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif found and b"trak" in path:
            found[-1].setdefault(path[-1], (start, end))
        elif path[-1] == b"trex" and end - start >= 24:
            number, _, duration, size, marks = struct.unpack_from(">5I", data, start + 4)
            defaults[number] = (duration, size, marks)
        fragmented |= path == (b"moof",)
    out = []
    for boxes in found:
        try:
            track = _track(data, boxes)
        except (struct.error, ValueError, IndexError):
            track = None
        if track:
            out.append(track)
    if fragmented:
        try:
            _fragments(data, out, defaults)
        except (struct.error, ValueError, IndexError):  # cut off: what came before stands
            pass
    return out


def samples(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track, in order; neighbours in the file are read at once. What lies outside the file is left out."""
    offsets, sizes = track["offsets"], track["sizes"]
    inside = (offsets >= 0) & (offsets <= len(data))
    offsets, sizes = offsets[inside], sizes[inside]
    if not len(offsets):
        return b""
    cuts = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    first, last = np.r_[0, cuts], np.r_[cuts, len(offsets)] - 1
    return b"".join(data[a:b] for a, b in zip(offsets[first].tolist(), (offsets[last] + sizes[last]).tolist(), strict=True))


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, zeros appended up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text stored as a media file; n_bytes is its length before padding.

    A null or empty text is 64 zeros. Equal texts give equal files. Repeated rows are kept, other columns ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, 500):
                media = [encode(payload_of(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), n_bytes).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def index(files: DataFrame, media_col: str = "media", read_back: bool = False) -> DataFrame:
    """``files`` and column ``tracks`` (array of TRACK); with ``read_back`` also ``payload``, the first track's stored bytes.

    Only boxes are read, unless ``read_back``. A null, empty, cut-off or other file has no tracks and a null payload.
    Columns named tracks or payload are replaced, all others and repeated rows kept.
    """
    kept = files.drop("tracks", *(["payload"] if read_back else []))
    columns, place = kept.columns, kept.columns.index(media_col)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, tracks array<{TRACK}>" + ", payload binary" * read_back
    frame = pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("time", pa.int64())])
    kind = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("bytes", pa.int64()), ("keyframes", pa.list_(frame))]))

    def described(t: dict) -> dict:
        sync = t["sync"]
        tables = (t["offsets"][sync].tolist(), t["sizes"][sync].tolist(), t["times"][sync].tolist())
        frames = [{"offset": o, "size": s, "time": w} for o, s, w in zip(*tables, strict=True)]
        return {k: t[k] for k in ("handler", "codec", "timescale", "duration")} | {"samples": len(t["sizes"]), "bytes": int(t["sizes"].sum()), "keyframes": frames}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, place, 500):
                media = part.column(place).to_pylist()
                found = [tracks(m) for m in media]
                more = [pa.array([[described(t) for t in ts] for ts in found], kind)]
                if read_back:
                    more.append(pa.array([samples(m, ts[0]) if ts else None for m, ts in zip(media, found, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*columns, "tracks", *["payload"] * read_back])

    return kept.mapInArrow(run, schema)
