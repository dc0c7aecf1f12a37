"""Texts of whole Arrow batches as arrays of bytes or code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about ``most`` bytes; a longer text is a slice of its own.
    Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return
    every = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(every, every[at] + most, "right")) - 1)
        yield at, end, data[every[at] : every[end]], every[at : end + 1] - every[at]
        at = end


def code_points(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, where each text begins in them, and the end) of slices."""
    for low, high, data, offsets in slices(texts):
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        yield low, high, codes, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]


def per_text(hits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of ``hits``, one for each code point, over each text."""
    sums = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]
