"""Signatures as blobs (little-endian 16-bit coefficients) and as hex hashes (means, then coefficients, big-endian)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FULL, Geometry


def lists(x: np.ndarray) -> pa.Array:
    """An array of two or three dimensions as lists (of lists), without a Python object a value."""
    out = pa.array(np.ascontiguousarray(x).ravel())
    for n in x.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, n, dtype=np.int32)), out)
    return out


def blob_length(g: Geometry = FULL) -> int:
    return 6 * g.keep


def hash_length(g: Geometry = FULL) -> int:
    return 3 * 16 + 3 * g.keep * 4


def to_blob(sig) -> bytes:
    return np.asarray(sig, "<i2").tobytes()


def blob_error(blob: bytes, g: Geometry = FULL) -> str | None:
    """Why a blob is invalid, or None. Coefficient 0 is allowed; order is not checked."""
    if len(blob) != blob_length(g):
        return f"signature blob must be {blob_length(g)} bytes, got {len(blob)}"
    c = np.frombuffer(blob, "<i2")
    if len(bad := c[np.abs(c.astype(int)) >= g.pixels]):
        return f"coefficient {bad[0]} out of range"
    return None


def from_blob(blob: bytes, g: Geometry = FULL) -> np.ndarray:
    if error := blob_error(blob, g):
        raise ValueError(error)
    return np.frombuffer(blob, "<i2").reshape(3, g.keep)


def to_hash(avglf, sig) -> str:
    """Raw bits: not-a-number and negative zero come back as they were."""
    return np.asarray(avglf, ">f8").tobytes().hex() + np.asarray(sig, ">i2").tobytes().hex()


def hash_error(s: str, g: Geometry = FULL) -> str | None:
    if (n := len(s.encode())) != hash_length(g):
        return f"hash must be {hash_length(g)} hex characters, got {n}"
    if not re.fullmatch("[0-9a-fA-F]*", s):
        return "hash has characters that are not hex digits"
    c = np.frombuffer(bytes.fromhex(s[48:]), ">i2")
    # such coefficients would point into another channel's posting lists
    return "hash has a coefficient out of range" if (np.abs(c.astype(int)) >= g.pixels).any() else None


def from_hash(s: str, g: Geometry = FULL) -> tuple[np.ndarray, np.ndarray]:
    if error := hash_error(s, g):
        raise ValueError(error)
    raw = bytes.fromhex(s)
    return np.frombuffer(raw[:24], ">f8").astype(float), np.frombuffer(raw[24:], ">i2").astype(np.int16).reshape(3, g.keep)


def _list(x) -> list:
    return np.asarray(x).tolist()


def _udfs(g: Geometry) -> dict:
    @F.arrow_udf("binary")
    def sig_blob(sig: pa.Array) -> pa.Array:
        return pa.array([None if x is None else to_blob(x) for x in sig.to_pylist()], pa.binary())

    @F.arrow_udf("array<array<short>>")
    def sig_from_blob(blob: pa.Array) -> pa.Array:
        rows = blob.drop_null()
        if not len(rows):
            return pa.nulls(len(blob), pa.list_(pa.list_(pa.int16())))
        if (np.asarray(pc.binary_length(rows)) != blob_length(g)).any():
            raise ValueError(next(e for x in rows if (e := blob_error(x.as_py(), g))))
        c = np.frombuffer(b"".join(rows.to_pylist()), "<i2").astype(np.int16).reshape(-1, 3, g.keep)
        if (np.abs(c.astype(np.int32)) >= g.pixels).any():
            raise ValueError(next(e for x in rows if (e := blob_error(x.as_py(), g))))
        place = np.cumsum(~np.asarray(blob.is_null())) - 1
        return lists(c) if blob.null_count == 0 else lists(c).take(pa.array(place, mask=np.asarray(blob.is_null())))

    @F.arrow_udf("string")
    def sig_encode_hash(avglf: pa.Array, sig: pa.Array) -> pa.Array:
        return pa.array([None if a is None or s is None else to_hash(a, s) for a, s in zip(avglf.to_pylist(), sig.to_pylist(), strict=True)], pa.string())

    @F.arrow_udf("avglf array<double>, sig array<array<short>>, error string")
    def sig_decode_hash(h: pa.Array) -> pa.Array:
        rows = []
        for x in h.to_pylist():
            error = None if x is None else hash_error(x, g)
            ok = x is not None and error is None
            a, s = from_hash(x, g) if ok else (None, None)
            rows.append({"avglf": _list(a) if ok else None, "sig": _list(s) if ok else None, "error": error})
        return pa.array(rows, pa.struct([("avglf", pa.list_(pa.float64())), ("sig", pa.list_(pa.list_(pa.int16()))), ("error", pa.string())]))

    return {"sig_blob": sig_blob, "sig_from_blob": sig_from_blob, "sig_encode_hash": sig_encode_hash, "sig_decode_hash": sig_decode_hash}


def encode_blob(sig: Column, g: Geometry = FULL) -> Column:
    return _udfs(g)["sig_blob"](sig)


def decode_blob(blob: Column, g: Geometry = FULL) -> Column:
    return _udfs(g)["sig_from_blob"](blob)


def encode_hash(avglf: Column, sig: Column, g: Geometry = FULL) -> Column:
    return _udfs(g)["sig_encode_hash"](avglf, sig)


def decode_hash(h: Column, g: Geometry = FULL) -> Column:
    """struct(avglf, sig, error); a bad hash has an error and nulls."""
    return _udfs(g)["sig_decode_hash"](h)


def hash_valid(h: Column, g: Geometry = FULL) -> Column:
    return (F.octet_length(h) == hash_length(g)) & h.rlike("^[0-9a-fA-F]+$")


def dc_prefix(h: Column) -> Column:
    """Bits of the first mean, as hex; all zeros for a black image."""
    return F.substring(h, 1, 16)


def coef_hex(coef: Column) -> Column:
    """Two's complement of a coefficient as four hex digits."""
    return F.lower(F.lpad(F.hex(F.pmod(coef.cast("int"), F.lit(65536))), 4, "0"))


def coefs_from_hash(h: Column, g: Geometry = FULL) -> Column:
    """array<int> of all coefficients in a valid hash, without Python."""
    v = lambda i: F.conv(F.substr(h, F.lit(49) + i * 4, F.lit(4)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(3 * g.keep - 1)), lambda i: F.when(v(i) >= 32768, v(i) - 65536).otherwise(v(i)))


def register(spark) -> None:
    for name, udf in _udfs(FULL).items():
        spark.udf.register(name, udf)
