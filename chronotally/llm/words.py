"""Words of whole texts as integer columns.

A word is a maximal run of characters other than space and U+0009..U+000D.
Everything works on Arrow buffers: a batch of texts becomes one flat array of
word codes, the offsets of each text in it, and the distinct words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Odd multipliers of the two polynomial hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of a base (or of its inverse) modulo 2**64."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), (INVERSES if inverse else BASES)[which], dtype=U64)
        step[0] = 1
        _POWERS[which, inverse] = have = np.cumprod(step, dtype=U64)
        if n > 1 << 20:
            del _POWERS[which, inverse]  # long ones are not kept
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for each span; equal spans have equal hashes wherever they stand."""
    total = np.empty(len(values) + 1, dtype=U64)
    total[0] = 0
    np.cumsum(values * powers(which, len(values)), out=total[1:])
    back = powers(which, len(values) + 1, inverse=True)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64))


def hash_pairs(strings: pa.Array) -> np.ndarray:
    """128-bit XXH3 of each string's UTF-8 bytes, as rows of two 64-bit halves."""
    digests = b"".join(map(xxhash.xxh3_128_digest, strings.cast(pa.large_binary()).to_pylist()))
    return np.frombuffer(digests, dtype="<u8").reshape(-1, 2)


def hash_strings(strings: pa.Array, which: int = 0) -> np.ndarray:
    """64-bit hash of each string's UTF-8 bytes: one half of ``hash_pairs``."""
    return np.ascontiguousarray(hash_pairs(strings)[:, which])


@dataclass
class Words:
    codes: np.ndarray  # index into vocab, one for each word
    offsets: np.ndarray  # len(texts) + 1 places in codes
    vocab: pa.Array  # distinct words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of strings; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if len(texts) and np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset]:
        # some string kernels misread an array whose values don't start at 0, as those of a slice
        texts = pa.concat_arrays([texts, pa.array([], texts.type)])
    return pc.fill_null(texts, "")


def encode_split(split: pa.Array, drop_empty: bool) -> Words:
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.flatten().dictionary_encode()
    codes, vocab = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    offsets = offsets - offsets[0]
    if drop_empty:
        empty = pc.index(vocab, pa.scalar("", vocab.type)).as_py()
        if empty >= 0:
            keep = codes != empty
            kept = np.concatenate([[0], np.cumsum(keep)])
            codes, offsets = codes[keep], kept[offsets]
            codes = codes - (codes > empty)
            vocab = vocab.take(pa.array(np.delete(np.arange(len(vocab)), empty)))
    return Words(codes, offsets, vocab)


def split_words(texts: pa.Array | pa.ChunkedArray) -> Words:
    return encode_split(pc.ascii_split_whitespace(plain(texts)), drop_empty=True)


def by_size(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = 4 << 20) -> Iterator[pa.Table]:
    """Slices of about ``most`` bytes of text, one row at least, so that memory doesn't follow the batch size."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    if not table.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(table[column]), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < table.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield table.slice(start, stop - start)
        start = stop
    release()


def release() -> None:
    """Free memory goes back to the machine: a Python worker lives on and shares its executor's limit."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each count, one after another."""
    total = int(counts.sum())
    starts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(starts, counts)


def gather_spans(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``flat[start:start+count]`` of each span, concatenated."""
    return flat[np.repeat(starts, counts) + ranges(counts)]
