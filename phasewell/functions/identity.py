"""Content ids and checksums."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: seed of the wide checksum.
XX_SEED = 0x9747B28C


def content_bytes(amplitude, phase) -> bytes:
    """Big-endian doubles, amplitudes and phases interleaved."""
    return np.column_stack([np.asarray(amplitude, float), np.asarray(phase, float)]).astype(">f8").tobytes()


def content_id_of(amplitude, phase) -> str:
    return hashlib.md5(content_bytes(amplitude, phase)).hexdigest()


@F.pandas_udf(T.StringType())
def content_id(amplitude: pd.Series, phase: pd.Series) -> pd.Series:
    """MD5 of a pattern's content; Spark has no function that gives a double's bytes."""
    ok = amplitude.notna() & phase.notna()
    a, p = amplitude[ok], phase[ok]
    sizes = a.map(len).to_numpy()
    out = pd.Series([None] * len(ok), dtype=object)
    if len(a) and (sizes == p.map(len).to_numpy()).all():  # one conversion for the whole batch
        raw = memoryview(content_bytes(np.concatenate(a.to_list()), np.concatenate(p.to_list())))
        ends = 16 * np.cumsum(sizes)
        out[ok.to_numpy()] = [hashlib.md5(raw[e - 16 * n : e]).hexdigest() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    else:
        out[ok.to_numpy()] = [content_id_of(x, y) for x, y in zip(a, p, strict=True)]
    return out


def text_id(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def is_id(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{32}$")


def checksum(data: bytes, width: int) -> int:
    """CRC32 for 4 bytes, XXH64 for 8."""
    if width == 4:
        return zlib.crc32(data)
    if width == 8:
        return xxhash.xxh64_intdigest(data, XX_SEED)
    raise ValueError(f"no checksum of {width} bytes")
