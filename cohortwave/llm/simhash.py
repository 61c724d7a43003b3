"""SimHash fingerprints of word shingles, as numpy work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

SEED = 42
#: Shingles that are counted in one step; bounds the memory that a very long text takes.
BLOCK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8) * 256


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case; ASCII white space alone parts them."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle, repeats included; the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    spans = zip(first.tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(first))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes set each of the 64 bits, lowest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        lanes = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        seen = np.bincount((lanes + _LANES).ravel(), minlength=2048).reshape(8, 256)
        total += (seen @ _BITS).ravel()
    return total


def fingerprint(words: list[bytes], size: int) -> int:
    """64 bits; a bit is 1 where over half of the shingle hashes set it. No words: 0."""
    hashes = shingle_hashes(words, size)
    bits = (2 * bit_counts(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, size: int) -> Column:
    """The fingerprint of a text column as a signed LONG; null texts have no words."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.fromiter((fingerprint(words_of(t), size) for t in texts), np.uint64, len(texts))
            yield pd.Series(prints.view(np.int64))

    return of(text.cast("binary"))


def as_hex(fingerprint: Column) -> Column:
    """16 lower-case hex digits of a LONG's bits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
