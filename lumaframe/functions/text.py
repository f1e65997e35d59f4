"""Names, checksums and semi-structured values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Colour temperatures of light sources by name and by code.
LIGHT_NAMES = {"a": 2856, "standarda": 2856, "standardlighta": 2856, "d50": 5003, "d55": 5503, "d65": 6504, "d75": 7504}
LIGHT_CODES = {17: 2856, 20: 5503, 21: 6504, 22: 7504, 23: 5003}
# 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def light_name_to_cct(name: Column) -> Column:
    """Blanks, _ and - removed, lower-cased; null for an unknown name."""
    key = F.lower(F.regexp_replace(name, r"[\s_\-]", ""))
    found = F.lit(None).cast("int")
    for k, v in LIGHT_NAMES.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def light_code_to_cct(code: Column) -> Column:
    """A value over 1000 is a temperature; unknown codes give 0."""
    found = F.lit(0.0)
    for k, v in LIGHT_CODES.items():
        found = F.when(code == k, F.lit(float(v))).otherwise(found)
    return F.when(code > 1000, code.cast("double")).otherwise(found)


def broadcast_levels(levels: Column) -> Column:
    """One level for all four sites, two as [a, b, b, a], four as they are; another number raises."""
    a, b = F.element_at(levels, 1), F.element_at(levels, -1)
    wrong = F.raise_error(F.lit("levels need 1, 2 or 4 values")).cast("array<double>")
    return F.when(F.size(levels) == 1, F.array(a, a, a, a)).when(F.size(levels) == 2, F.array(a, b, b, a)).when(F.size(levels) == 4, levels).otherwise(wrong)


def codec_tag(profile: Column) -> Column:
    # Four-character codes.
    found = F.lit(None).cast("string")
    for k, v in {"proxy": "apco", "lt": "apcs", "standard": "apcn", "hq": "apch", "4444": "ap4h", "4444xq": "ap4x"}.items():
        found = F.when(F.lower(profile) == k, F.lit(v)).otherwise(found)
    return found


#: So many strings or fewer are hashed one by one.
FEW = 8


def fnv1a_numpy(values: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once: step j takes byte j of all that are long enough."""
    order = np.argsort([-len(v) for v in values], kind="stable")
    sizes = np.array([len(values[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join(values[i] for i in order), np.uint8).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
    h = np.full(len(values), FNV_OFFSET, np.uint64)
    live = len(sizes)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        while live and sizes[live - 1] <= j:
            live -= 1
        if live <= FEW:
            # The last few, long ones, byte by byte: an array step for so few values costs more.
            for k in range(live):
                value = int(h[k])
                for byte in flat[starts[k] + j : starts[k] + sizes[k]].astype(np.uint8).tobytes():
                    value = (value ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
                h[k] = value
            break
        h[:live] = (h[:live] ^ flat[starts[:live] + j]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


@F.pandas_udf(LongType())
def plane_hash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a of a plane's codes as little-endian 16-bit numbers, in their order; null gives null."""
    for s in parts:
        raw = [b"" if v is None else np.asarray(v).astype("<u2").tobytes() for v in s]
        yield pd.Series(fnv1a_numpy(raw).view(np.int64), index=s.index).astype("Int64").mask(s.isna())


@F.pandas_udf(LongType())
def fnv1a(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit FNV-1a of a string's UTF-8 or a binary's bytes, as a bigint's bits; null gives null."""
    for s in parts:
        raw = [b"" if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in s]
        yield pd.Series(fnv1a_numpy(raw).view(np.int64), index=s.index).astype("Int64").mask(s.isna())
