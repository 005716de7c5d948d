"""Byte formats of tensors: safetensors files, row deltas with a checksum, and packages of named parts."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FormatError(ValueError):
    """Bytes that aren't what they should be."""


def to_safetensors(tensors: dict[str, np.ndarray], half: bool = False) -> bytes:
    """A length, a JSON header padded to eight bytes, and the tensors one after another, as F32 or F16."""
    header, at, parts = {}, 0, []
    for name, t in tensors.items():
        data = np.ascontiguousarray(t, "<f2" if half else "<f4").tobytes()
        header[name] = {"dtype": "F16" if half else "F32", "shape": list(t.shape), "data_offsets": [at, at + len(data)]}
        at += len(data)
        parts.append(data)
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(parts)


def from_safetensors(data: bytes) -> dict[str, np.ndarray]:
    if len(data) < 8 or len(data) < 8 + struct.unpack("<Q", data[:8])[0]:
        raise FormatError("the header is cut short")
    n = 8 + struct.unpack("<Q", data[:8])[0]
    out = {}
    for name, entry in json.loads(data[8:n]).items():
        if name == "__metadata__":
            continue
        if entry["dtype"] not in ("F32", "F16"):
            raise FormatError(f"{name} is {entry['dtype']}")
        a, b = entry["data_offsets"]
        kind = "<f4" if entry["dtype"] == "F32" else "<f2"
        out[name] = np.frombuffer(data[n + a : n + b], kind).astype(np.float32).reshape(entry["shape"])
    return out


def sealed(data: bytes) -> bytes:
    """With a trailer of a mark and the checksum."""
    return data + b"CRC1" + struct.pack("<I", zlib.crc32(data))


def unsealed(data: bytes) -> bytes:
    """Without the trailer, if there is one; a wrong checksum is an error."""
    if data[-8:-4] != b"CRC1":
        return data
    if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-8]):
        raise FormatError("the checksum doesn't hold")
    return data[:-8]


def delta_bytes(base: np.ndarray, now: np.ndarray, eps: float = 0.0) -> bytes:
    """The rows of ``now`` that differ from ``base`` by more than ``eps`` anywhere, sealed."""
    if base.shape != now.shape:
        raise FormatError("the shapes differ")
    moved = np.flatnonzero((np.abs(now - base) > eps).any(axis=1))
    body = struct.pack("<4sIII", b"ROWD", 1, base.shape[1], len(moved)) + moved.astype("<u4").tobytes() + now[moved].astype("<f4").tobytes()
    return sealed(body)


def apply_delta(base: np.ndarray, data: bytes) -> np.ndarray:
    body = unsealed(data)
    mark, version, width, n = struct.unpack("<4sIII", body[:16])
    if mark != b"ROWD" or version != 1 or width != base.shape[1] or len(body) != 16 + 4 * n + 4 * n * width:
        raise FormatError("not a delta of this base")
    out = base.copy()
    out[np.frombuffer(body[16 : 16 + 4 * n], "<u4")] = np.frombuffer(body[16 + 4 * n :], "<f4").reshape(n, width)
    return out


def pack_parts(manifest: dict, parts: dict[str, bytes]) -> bytes:
    """A mark, the manifest with each part's size and checksum, and the parts."""
    head = json.dumps(manifest | {"parts": {k: [len(v), zlib.crc32(v)] for k, v in parts.items()}}).encode()
    return b"PKG1" + struct.pack("<I", len(head)) + head + b"".join(parts.values())


def unpack_parts(data: bytes) -> tuple[dict, dict[str, bytes]]:
    if data[:4] != b"PKG1":
        raise FormatError("not a package")
    n = 8 + struct.unpack("<I", data[4:8])[0]
    manifest, at, parts = json.loads(data[8:n]), n, {}
    for name, (size, crc) in manifest.pop("parts").items():
        parts[name] = data[at : at + size]
        if len(parts[name]) != size or zlib.crc32(parts[name]) != crc:
            raise FormatError(f"{name} is damaged")
        at += size
    return manifest, parts


def survives(vec: Column, way: str) -> Column:
    """Whether a row's vector is the same after a round trip as ``safetensors``, ``delta`` or ``package``."""

    def one(v: list[float] | None) -> bool:
        x = np.array(v or [], np.float32).reshape(1, -1)
        if way == "safetensors":
            return bool((from_safetensors(to_safetensors({"t": x}))["t"] == x).all())
        if way == "delta":
            return bool((apply_delta(np.zeros_like(x), delta_bytes(np.zeros_like(x), x)) == x).all())
        manifest, parts = unpack_parts(pack_parts({"dim": x.shape[1]}, {"t": x.tobytes(), "empty": b""}))
        return manifest == {"dim": x.shape[1]} and parts == {"t": x.tobytes(), "empty": b""}

    @F.arrow_udf("boolean")
    def of(v: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in v.to_pylist()], pa.bool_())

    return of(vec)


def read_tensors(files: DataFrame) -> DataFrame:
    """tensor, row, values of safetensors files as ``spark.read.format('binaryFile')`` gives them."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                for name, t in from_safetensors(data).items():
                    flat = t.reshape(t.shape[0], -1) if t.ndim > 1 else t.reshape(1, -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(flat)), pa.array(range(len(flat)), pa.int32()), pa.array(flat.tolist(), pa.list_(pa.float32()))], ["tensor", "row", "values"]
                    )

    return files.select("content").mapInArrow(run, "tensor string, row int, values array<float>")
