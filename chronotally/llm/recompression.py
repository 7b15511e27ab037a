"""Substring deduplication by recompression.

Rounds shorten every document's word stream alike wherever the same words stand: a run
round replaces each maximal run of one symbol by a symbol named after (symbol, length), a pair
round merges a symbol of coin 0 with a following symbol of coin 1 (the coins come from the symbols' names and
the round). A new symbol's name is a 128-bit hash of what it replaces, so all tasks and documents give
equal content one name without talking to each other, and the rounds need no exchange between them. With each symbol goes the
span of words its making depended on; if that span lies inside a window, every equal window elsewhere holds the same symbol at the same place.

A window of 35 words that holds such an interior symbol that occurs once in the corpus is therefore
unique. Windows whose interior symbols are all shared (or that have none) are left; each is described by the names of its interior symbols
and the words before and after them, which are a function of its words and fix them. Windows of equal
description (128 bits) are the repeats, counted over the corpus. Words covered by a repeated window are removed.

Distribution: documents are dealt once into blocks of a few MB by a hash of id and text; the three passes read
that one shuffle. Blocks send each distinct name (or window hash) once, in packed arrays by bucket of
the hash, and get a bit for each back, so a passage that a third of all documents share is at most one
entry a block. The packed rows are at most blocks x buckets and never more than the entries, that is linear in the words. Every document is whole
in a block; equal rows (null ids, one text) are spread by the input partition they come from.

Defined results: a null text has no words (n_words 0, SHA-256 of the empty string). A text under 35 words loses
nothing. Copies of a document (equal doc_id too) each count as another occurrence. Null doc_ids stay null. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import shuffle_width
from .words import U64, Words, hash_pairs, mix, powers, split_words

WINDOW = 35
#: R: runs, P: pairs.
ROUNDS = "RPPPPPP"
LONGEST = 16
OUTSIDE = 1 << 40
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Symbols:
    """What the rounds leave of a word stream, in order: each symbol's name, its words [start, end) and the words [low, high) it depended on."""

    names: np.ndarray  # rows of two 64-bit halves
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _named(*parts: np.ndarray, salt: int) -> np.ndarray:
    """Names of made symbols: rows of two halves, each a mix of the same halves of the parts."""
    out = np.full(parts[0].shape, U64(salt), dtype=U64)
    for odd, part in zip((0xFF51AFD7ED558CCD, 0x9FB21C651E98DF25), parts, strict=False):
        out = mix(out * U64(0xC4CEB9FE1A85EC53) + part * U64(odd))
    return out


def compress(names: np.ndarray, doc: np.ndarray, rounds: str = ROUNDS) -> Symbols:
    """The symbols left after all rounds. names: rows of two halves, one for each word.

    A symbol that depended on an end of its document has an endless span.
    """
    n = len(names)
    start = np.arange(n)
    length = np.ones(n, dtype=np.int64)
    low, high = start.copy(), start + 1
    for number, kind in enumerate(rounds):
        if not len(names):
            break
        inside = doc[1:] == doc[:-1]
        has_left, has_right = np.concatenate([[False], inside]), np.concatenate([inside, [False]])
        before = np.where(has_left, np.concatenate([low[:1], low[:-1]]), -OUTSIDE)
        after = np.where(has_right, np.concatenate([high[1:], high[-1:]]), OUTSIDE)
        if kind == "R":
            head = np.concatenate([[True], ~(inside & (names[1:] == names[:-1]).all(axis=1))])
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, len(names)))
            low, high = before[at], after[at + size - 1]
            length = np.add.reduceat(length, at)
            runs = np.flatnonzero(size > 1)
            names, doc, start = names[at], doc[at], start[at]
            names[runs] = _named(names[runs], np.repeat(size[runs, None].astype(U64), 2, axis=1), salt=number + 1)
        else:
            coin = mix(names[:, 0] + U64(0x9E3779B97F4A7C15 * (number + 1) % (1 << 64))) >> U64(63) == 1
            joins = np.concatenate([~coin[:-1] & coin[1:] & inside & (length[:-1] + length[1:] <= LONGEST), [False]])
            joined = np.concatenate([[False], joins[:-1]])
            low = np.where(coin & ~joined, before, low)
            high = np.where(~coin & ~joins, after, high)
            first = np.flatnonzero(joins)
            names, high, length = names.copy(), high.copy(), length.copy()
            names[first] = _named(names[first], names[first + 1], salt=number + 1)
            high[first] = high[first + 1]
            length[first] += length[first + 1]
            keep = ~joined
            names, start, low, high, length, doc = names[keep], start[keep], low[keep], high[keep], length[keep], doc[keep]
    return Symbols(names, start, start + length, low, high)


def _sums(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of ``values`` times powers of a base."""
    return np.concatenate([np.zeros(1, U64), np.cumsum(values * powers(which, len(values)), dtype=U64)])


class Block:
    """The words of some documents and what the rounds make of them."""

    def __init__(self, table: pa.Table, window: int):
        self.words: Words = split_words(table["text"])
        self.window, n = window, len(self.words.codes)
        self.doc = self.words.doc_of_word()
        self.hashes = hash_pairs(self.words.vocab)[self.words.codes]
        self.symbols = compress(self.hashes, self.doc)
        self.distinct, self.which, counts = np.unique(self.symbols.names[:, 0], return_inverse=True, return_counts=True)
        self.twice = counts > 1
        self.fits = np.zeros(n, dtype=bool)  # a window starts here
        if n >= window:
            self.fits[: n - window + 1] = self.doc[: n - window + 1] == self.doc[window - 1 :]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Window starts that no unique interior symbol rules out; shared: of each distinct name."""
        alone = ~(shared | self.twice)[self.which]
        first, last = self.symbols.high[alone] - self.window, self.symbols.low[alone]
        good = first <= last
        first, last = np.maximum(first[good], 0), last[good]
        n = len(self.fits)
        out = np.cumsum(np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(last + 1, minlength=n + 2)[: n + 1])[:n] > 0
        return np.flatnonzero(self.fits & ~out)

    def described(self, starts: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit halves that stand for each window: of its interior symbols' names and of the words around them.

        The interior symbols depend on the window's words alone, so equal windows are described alike; names fix the
        words they replaced, so windows described alike are equal.
        """
        s, n = self.symbols, len(self.doc)
        ends = starts + self.window
        bounds = self.words.offsets
        # spans beyond an end of a document reach just past it: lows and highs ascend over all documents
        own = np.searchsorted(bounds, s.start, side="right") - 1
        low = np.where(s.low < 0, bounds[own] - 1, s.low)
        high = np.where(s.high > n, bounds[own + 1] + 1, s.high)
        first, last = np.searchsorted(low, starts, "left"), np.searchsorted(high, ends, "right")
        some = first < last
        first, last = np.where(some, first, 0), np.where(some, last, 0)
        # without an interior symbol the words before it are the whole window
        head = np.where(some, s.start[np.minimum(first, len(s.start) - 1)], ends) if len(s.start) else ends
        tail = np.where(some, s.end[np.maximum(last - 1, 0)], ends) if len(s.end) else ends
        halves = []
        for k in (0, 1):
            of_words, of_names = _sums(self.hashes[:, k], k), _sums(s.names[:, k], k)
            back, back_names = powers(k, n + 1, inverse=True), powers(k, len(s.names) + 1, inverse=True)
            out = mix((of_words[head] - of_words[starts]) * back[starts] + (head - starts).astype(U64))
            out = mix(out * U64(0xC4CEB9FE1A85EC53) + (of_names[last] - of_names[first]) * back_names[first] + (last - first).astype(U64))
            halves.append(mix(out * U64(0x9FB21C651E98DF25) + (of_words[ends] - of_words[tail]) * back[tail]))
        return halves

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct descriptions of the windows in order, the place of each start among them, and which occur twice here."""
        a, b = self.described(starts)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, dtype=bool)
        place = np.empty(len(a), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        return a[new], b[new], place, np.bincount(place, minlength=int(new.sum())) > 1


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def packed(block: int, buckets: int, first: np.ndarray, second: np.ndarray | None) -> pa.Table:
    """One row for each bucket; ``first`` ascends."""
    bounds = np.searchsorted(bucket_of(first, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(bounds))
    cut = lambda x, k: x[bounds[k] : bounds[k + 1]].tobytes()
    return pa.table({
        "bucket": pa.array(used, pa.int64()),
        "blk": pa.array(np.full(len(used), block), pa.int64()),
        "first": pa.array([cut(first, k) for k in used], pa.binary()),
        "second": pa.array([cut(second, k) if second is not None else b"" for k in used], pa.binary()),
    })


PACKED, REPLY = "bucket long, blk long, first binary, second binary", "blk long, kind int, bucket long, bits binary"


def _met_in_two(kind: int):
    """For each row of a bucket, a bit for each of its entries: does another block have it?"""

    def run(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, U64) for x in table["first"].to_pylist()]
        sizes = np.array([len(x) for x in rows])
        a = np.concatenate(rows)
        if kind == 1:
            order = np.argsort(a, kind="stable")
            a = a[order]
            same = a[1:] == a[:-1]
        else:
            b = np.concatenate([np.frombuffer(x, U64) for x in table["second"].to_pylist()])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        met = np.zeros(len(a), dtype=bool)
        met[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        ends = np.cumsum(sizes)
        bits = [np.packbits(met[e - s : e]).tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return pa.table({"blk": table["blk"], "kind": pa.array(np.full(len(sizes), kind), pa.int32()), "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    return run


def _reply(replies: pa.Table, kind: int, values: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of this block's entries, in the order they were sent."""
    rows = replies.filter(pc.equal(replies["kind"], kind)).sort_by("bucket")
    bounds = np.searchsorted(bucket_of(values, buckets), np.arange(buckets + 1))
    out = np.zeros(len(values), dtype=bool)
    for k, bits in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        a, b = bounds[k], bounds[k + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def _block_of(table: pa.Table) -> int:
    return table["blk"][0].as_py()


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)))


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with ``texts``) kept_text of each document of ``docs``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = shuffle_width(spark)
    blocks = max(width, size // BLOCK_BYTES)
    buckets = max(width, size // (64 << 20))
    rows = dealt(docs, blocks)

    def names(table: pa.Table) -> pa.Table:
        return packed(_block_of(table), buckets, Block(table, window).distinct, None)

    def windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(table, window)
        a, b, _, _ = block.windows(block.candidates(_reply(replies, 1, block.distinct, buckets)))
        return packed(_block_of(table), buckets, a, b)

    def result(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(table, window)
        starts = block.candidates(_reply(replies, 1, block.distinct, buckets))
        a, b, place, twice = block.windows(starts)
        repeated = starts[(_reply(replies, 2, a, buckets) | twice)[place]]
        n = len(block.doc)
        covered = np.cumsum(np.bincount(repeated, minlength=n + 1)[: n + 1] - np.bincount(repeated + window, minlength=n + 1)[: n + 1])[:n] > 0
        words = block.words
        total = np.concatenate([[0], np.cumsum(~covered)])
        kept = pa.ListArray.from_arrays(pa.array(total[words.offsets].astype(np.int32)), words.vocab.cast(pa.string()).take(pa.array(words.codes[~covered])))
        kept = pc.binary_join(kept, " ")
        sums = [hashlib.sha256(x.as_buffer()).hexdigest() for x in kept.cast(pa.binary())]
        n_words = words.counts
        return pa.table({
            "doc_id": table["doc_id"], "n_words": pa.array(n_words), "n_removed": pa.array(n_words - np.diff(total[words.offsets])), "kept_sha256": pa.array(sums, pa.string()),
            "kept_text": kept if texts else pa.nulls(len(kept), pa.string()),
        })

    shared = rows.groupBy("blk").applyInArrow(names, PACKED).groupBy("bucket").applyInArrow(_met_in_two(1), REPLY)
    repeats = rows.groupBy("blk").cogroup(shared.groupBy("blk")).applyInArrow(windows, PACKED).groupBy("bucket").applyInArrow(_met_in_two(2), REPLY)
    out = rows.groupBy("blk").cogroup(shared.unionByName(repeats).groupBy("blk")).applyInArrow(result, RESULT)
    return out if texts else out.drop("kept_text")


def sql(window: int = WINDOW) -> str:
    """The same in DuckDB's SQL, window by window."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d),
marked AS (SELECT r, i, w[i] AS word, CASE WHEN i + {window - 1} <= len(w) THEN array_to_string(list_slice(w, i, i + {window - 1}), ' ') END AS win FROM places),
counted AS (SELECT r, i, word, win IS NOT NULL AND count(win) OVER (PARTITION BY win) > 1 AS again FROM marked),
covered AS (SELECT r, i, word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM counted),
kept AS (SELECT r, sum(gone) AS n_removed, coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i), '') AS words FROM covered GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.r = d.r"""


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, texts=False)
