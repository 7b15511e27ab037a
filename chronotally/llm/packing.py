"""Packing documents into fixed-length training sequences, order kept.

Documents stand in ascending doc_id order, each as its ids and the end id. Within a
run of consecutive documents, dynamic programming picks the sequences' ends among the
ends of documents (free), the ends of sentences (``SENTENCE_CUT``) and, only where those lie
further apart than ``FILLER``, other places (``WORD_CUT``). The cost of a sequence is its padding
plus its cut's penalty; it is padded up to ``length`` unless its size is a power of two.
For padded sequences the best start is the minimum of cost minus position over the last ``length``
ids, kept in a monotone queue; the few power-of-two sizes are looked up.

A range partition holds consecutive documents; runs end when they reach ``RUN`` ids, so
memory is bounded by that or by the longest document, and padding lost between runs is
under one sequence in ``RUN`` ids.

Defined results: a null text is empty (the end id only); null doc_ids come first; rows of equal
doc_id follow each other, ordered by a hash of their text; equal rows are separate documents; an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from .shared import stage
from .subwords import append_id, encoder, vocabulary_path
from .words import by_size

SENTENCE_CUT, WORD_CUT, FILLER, RUN = 8.0, 64.0, 1024, 1 << 20
PIECES = "part long, sequence long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long"


def padding(size: int, length: int) -> int:
    return 0 if size & (size - 1) == 0 else length - size


def candidates(offsets: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sequence may end, with their penalties; offsets[0] is 0."""
    total = int(offsets[-1])
    known = np.unique(np.concatenate([offsets, sentence_ends]))
    gaps = np.flatnonzero(np.diff(known) > FILLER)
    extra = [np.arange(known[g] + FILLER, known[g + 1], FILLER) for g in gaps]
    places = np.unique(np.concatenate([known, *extra])) if extra else known
    places = places[places <= total]
    penalty = np.full(len(places), WORD_CUT)
    penalty[np.isin(places, sentence_ends)] = SENTENCE_CUT
    penalty[np.isin(places, offsets)] = 0.0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, length: int) -> np.ndarray:
    """Ends of the sequences of least total cost over ``places`` (ascending from 0, gaps below ``length``)."""
    n = len(places)
    # for each place, the earlier candidates a power of two before it
    later, earlier = [], []
    size = 1
    while size < length:
        at = np.searchsorted(places, places - size)
        hit = np.flatnonzero((places >= size) & (places[np.minimum(at, n - 1)] == places - size))
        later.append(hit)
        earlier.append(at[hit])
        size *= 2
    later_all, earlier_all = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later_all, kind="stable")
    bounds = np.searchsorted(later_all[order], np.arange(n + 1)).tolist()
    exact = earlier_all[order].tolist()
    where, fine = places.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for k in range(1, n):
        here = where[k]
        least = here - length
        while where[queue[0][1]] < least:
            queue.popleft()
        value, source = queue[0]
        best = value + length - here
        for i in exact[bounds[k] : bounds[k + 1]]:
            if cost[i] < best:
                best, source = cost[i], i
        best += fine[k]
        cost[k], back[k] = best, source
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, k))
    ends, k = [], n - 1
    while k:
        ends.append(where[k])
        k = back[k]
    return np.array(ends[::-1], dtype=np.int64)


def _sentence_ends(words, per_word: np.ndarray) -> np.ndarray:
    """Ids before the end of each word that closes a sentence."""
    closing = pc.match_substring_regex(words.vocab, r"[.!?…。！？][\"'”’»)\]]*$").to_numpy(zero_copy_only=False).astype(bool)
    return np.cumsum(per_word)[closing[words.codes]] if len(words.codes) else np.empty(0, dtype=np.int64)


def _pack(path: str, end_id: int, length: int):
    schema = pa.schema([("part", pa.int64()), ("sequence", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])

    def solved(part: int, first: int, docs: list, ids: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[pa.RecordBatch, int]:
        places, penalty = candidates(offsets, ends)
        cuts = best_cuts(places, penalty, length)
        borders = np.unique(np.concatenate([offsets, cuts]))
        a, b = borders[:-1], borders[1:]
        doc = np.searchsorted(offsets, a, side="right") - 1
        row = np.searchsorted(cuts, a, side="right")
        row_start = np.concatenate([[0], cuts])[row]
        raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
        sums = [zlib.crc32(raw[x * 4 : y * 4]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        out = [np.full(len(a), part), row + first, pa.array(docs, pa.int64()).take(pa.array(doc)), a - offsets[doc], b - a, np.array(sums, dtype=np.int64), np.diff(offsets)[doc], a - row_start]
        return pa.RecordBatch.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x for x, t in zip(out, schema.types, strict=True)], schema=schema), first + len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(path, spaces=False), TaskContext.get().partitionId()
        first, docs, held, lengths, ends, size = 0, [], [], [], [], 0
        for batch in batches:
            for table in by_size(batch, most=4 << 20):
                ids, offsets, words, per_word = tool.encode(table["text"])
                # the end id of each earlier document in this table moves the later ends
                closing = _sentence_ends(words, per_word)
                closing = closing + np.searchsorted(offsets[1:], closing, side="left")
                ids, offsets = append_id(ids, offsets, end_id)
                docs += table["doc_id"].to_pylist()
                held.append(ids)
                lengths.append(np.diff(offsets))
                ends.append(closing + size)
                size += len(ids)
                if size >= RUN:
                    out, first = solved(part, first, docs, np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), np.concatenate(ends))
                    yield out
                    docs, held, lengths, ends, size = [], [], [], [], 0
        if docs:
            yield solved(part, first, docs, np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), np.concatenate(ends))[0]

    return run


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, length: int = 2048) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # the row's number only parts equal rows, so that a range may end between them
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy"))
    ordered = rows.repartitionByRange("doc_id", "tie", "copy").sortWithinPartitions("doc_id", "tie", "copy").select("doc_id", "text")
    pieces = stage(ordered.mapInArrow(_pack(vocabulary_path(vocabulary), end_id, length), PIECES), "pieces")
    # sequences are numbered in order; one row for each partition, whose number is set
    counts = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return pieces.join(F.broadcast(firsts), "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset")


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs)
