"""HMAC and AES as built-in expressions, sketch hashes by Arrow batch; no Python per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 64  # SHA-256 block size in bytes

# FNV-1a 64-bit offset basis and prime, and the per-row seed step of the sketch.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
FNV_ROW_STEP = 2654435761

CMS_DEPTH = 4
CMS_WIDTH = 65_536


def literal_pads(secret: str) -> tuple[Column, Column]:
    """HMAC inner and outer pads of a secret known to the driver."""
    import hashlib

    key = secret.encode()
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return (
        F.lit(bytearray(b ^ 0x36 for b in key)),
        F.lit(bytearray(b ^ 0x5C for b in key)),
    )


def pad_column(secret: Column, mask: int) -> Column:
    """HMAC pad of a secret column. Compute it on the dimension row, before the join."""
    raw = secret.cast("binary")
    key = F.when(F.octet_length(raw) > BLOCK, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    padded = F.rpad(F.hex(key), 2 * BLOCK, "0")
    return F.unhex(
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.lit(2 * BLOCK - 1), F.lit(2)),
                lambda i: F.lpad(
                    F.hex(
                        F.conv(F.substring(padded, i, F.lit(2)), 16, 10)
                        .cast("int")
                        .bitwiseXOR(F.lit(mask))
                    ),
                    2,
                    "0",
                ),
            ),
            "",
        )
    )


def pad_columns(secret: Column) -> tuple[Column, Column]:
    return pad_column(secret, 0x36), pad_column(secret, 0x5C)


def hmac_hex(ipad: Column, opad: Column, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex from prepared pads."""
    inner = F.unhex(F.sha2(F.concat(ipad, message.cast("binary")), 256))
    return F.sha2(F.concat(opad, inner), 256)


def b64url(data: Column) -> Column:
    """Binary to base64url without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def aes_seal(text: Column, key_hex: Column) -> Column:
    """Text to base64url of nonce(12), ciphertext, tag(16), with AES-256-GCM."""
    return b64url(F.aes_encrypt(text.cast("binary"), F.unhex(key_hex), F.lit("GCM")))


def aes_open(blob: Column, key_hex: Column) -> Column:
    """Inverse of ``aes_seal``; NULL for a wrong key, a changed blob or malformed text."""
    well_formed = blob.rlike("^[A-Za-z0-9_-]+$") & (F.length(blob) % 4 != 1)
    data = F.when(well_formed, F.unbase64(F.translate(blob, "-_", "+/")))
    return F.try_aes_decrypt(data, F.unhex(key_hex), F.lit("GCM")).cast("string")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _slots(texts: pa.Array) -> pa.Array:
    """FNV-1a modulo 65,536 of whole Arrow batches, one character position at a time.

    The multiply only carries upwards, so the low 16 bits of the 64-bit hash follow from
    the low 16 bits of seed and prime alone.
    """
    mask = CMS_WIDTH - 1
    data = [(t or "").encode() for t in texts.to_pylist()]
    sizes = np.fromiter((len(d) for d in data), dtype=np.int64, count=len(data))
    starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(data) else sizes
    letters = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint32)
    seeds = [(FNV_OFFSET + row * FNV_ROW_STEP) & mask for row in range(CMS_DEPTH)]
    slots = np.tile(np.array(seeds, dtype=np.uint32), (len(data), 1))
    for place in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > place)
        mixed = slots[live] ^ letters[starts[live] + place][:, None]
        slots[live] = mixed * np.uint32(FNV_PRIME & mask) & np.uint32(mask)
    ends = np.arange(0, slots.size + 1, CMS_DEPTH, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(slots.astype(np.int32).ravel()))


def sketch_slots(text: Column) -> Column:
    """The slots of a string in the four sketch rows, as an array."""
    return _slots(text)
