"""Fixed-width kernel records as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_text, until_null
from ..schema import DECODED, RECORD

_NUMBERS = ("timestamp_ns", "event_type", "pid", "ppid", "uid", "auid", "saddr", "daddr", "sport", "dport", "family")


def _texts(fields: np.ndarray) -> pa.Array:
    """Strings of fixed-width fields, up to the first NUL; bytes that can't be decoded are left out."""
    raw = np.ascontiguousarray(fields).view(np.uint8).reshape(len(fields), -1)
    ends = raw == 0
    sizes = np.where(ends.any(axis=1), ends.argmax(axis=1), raw.shape[1])
    inside = raw[np.arange(raw.shape[1]) < sizes[:, None]]
    if (inside > 127).any():
        return pa.array([r[:n].tobytes().decode("utf-8", "ignore") for r, n in zip(raw, sizes.tolist(), strict=True)], pa.string())
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.StringArray.from_buffers(len(fields), pa.py_buffer(offsets.tobytes()), pa.py_buffer(inside.tobytes()))


def decode(df: DataFrame, raw_col: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of DECODED (and ``keep``) for each binary record.

    Records shorter than the layout, and nulls, are dropped; what follows the layout is ignored. Texts end at the first
    NUL, lose undecodable bytes and unprintable characters, and are null if empty. ``argv`` stops at the first empty one.
    """
    kinds = dict(df.dtypes)
    names = [f.split()[0] for f in DECODED.split(", ")]
    schema = DECODED + "".join(f", `{c}` {kinds[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {f.name: f.type for f in (pa.field(n, t) for n, t in zip(names, [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.string())] + [pa.int64()] * 2 + [pa.int32()] * 3, strict=True))}
        for b in batches:
            if not b.num_rows:
                continue
            raw = b"".join(r.as_py()[: RECORD.itemsize] for r in b.column(0))
            rows = np.frombuffer(raw, RECORD)
            columns: dict[str, pa.Array] = {n: pa.array(rows[n].astype(types[n].to_pandas_dtype()), types[n]) for n in _NUMBERS}
            columns["comm"] = _texts(rows["comm"])
            columns["filename"] = _texts(rows["filename"])
            columns["argv"] = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows["argv"].shape[1]), _texts(rows["argv"].reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(columns[n] for n in names), *b.columns[1:]], names=[*names, *keep])

    found = df.where(F.length(raw_col) >= RECORD.itemsize).select(raw_col, *keep).mapInArrow(run, schema)
    return found.withColumns({"comm": clean_text("comm"), "filename": clean_text("filename"), "argv": until_null(F.transform("argv", clean_text))})


def encode(rows: list[dict]) -> list[bytes]:
    """Records from plain values, for tests and fixtures; texts may be str or bytes, argv a list."""
    out = []
    for row in rows:
        rec = np.zeros(1, RECORD)
        for name, value in row.items():
            if name == "argv":
                for k, a in enumerate(value[:6]):
                    rec["argv"][0, k] = np.void((a.encode() if isinstance(a, str) else a)[:127].ljust(128, b"\0"))
            elif name in ("comm", "filename"):
                size = RECORD[name].itemsize
                rec[name][0] = np.void((value.encode() if isinstance(value, str) else value)[: size - 1].ljust(size, b"\0"))
            else:
                rec[name][0] = value
        out.append(rec.tobytes())
    return out
