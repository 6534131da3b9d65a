"""Words of texts in Python tasks: bytes between ASCII white space, and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; a null text has none. bytes.split() parts at just these characters."""
    return text.encode().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, alike on all machines."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words; of the whole text if it has fewer words, nothing if it has none."""
    if len(hashes) == 0:
        return hashes
    m = max(1, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(min(n, len(hashes))):
        out = mix64(out + hashes[i : i + m] + np.uint64(i + 1))
    return out


def slices(rows: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that a task's Python objects stay few whatever Spark's batch size."""
    for batch in rows:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def batches(rows: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in slices(rows):
        yield batch, batch.column(column).to_pylist()
