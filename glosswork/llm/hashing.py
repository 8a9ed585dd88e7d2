"""Helpers for models over hashed features: chunks of texts, sums by text, sampling by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

CHUNK_CHARS = 1 << 20


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def hash_unit(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)


def text_chunks(column: pa.Array, most_chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The column's texts in order, null as empty, in lists of about ``most_chars`` characters (one text at least)."""
    chunk, size = [], 0
    for value in column:
        text = value.as_py() or ""
        chunk.append(text)
        size += len(text)
        if size >= most_chars:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` (first axis) whose lengths are ``counts``; 0 for an empty run."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.cumsum(counts) - counts
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out
