"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are compared in lower case without the signs around them. A first pass counts the test items' words and their n-grams of
``SHORTEST`` to ``COUNTED`` words in all documents. From each place of an item the shortest rare n-gram of ``SHORTEST`` to ``LONGEST`` words
is a seed. An n-gram is rare if it stands in at most ``RARE_SHARE`` of the corpus' places or ``RARE_COUNT`` of them, or if its chance probability (the product of its
words' corpus frequencies) is below ``RARE``: the second keeps a passage that a third of all documents leak a seed. An n-gram that more
than ``SHARED`` items hold is not rare either way, so a template of the items isn't one, and where none is rare the longest is taken, so
that each place has a seed. A second pass joins the documents' n-grams to the seeds (a hash join whose built side is the broadcast seeds); hits of an item whose
places agree make a candidate passage, which is aligned with the whole item (match 2, mismatch and gap -1). A candidate is
read in windows of the item's length and slack, half overlapping, so a text that repeats an item gives one row for
each copy, and the longest array is bounded by the item. A passage is reported if its score is at least ``THRESHOLD`` of the item's score against itself, so
edited and paraphrased copies are found; of overlapping passages of one item in one text the best is.
The items are a stated query set; they are broadcast in blocks of at most ``ITEM_BYTES``.

Defined results: null and empty texts and items match nothing; items of equal words are all reported; every repeated document
is; a null doc_id or item_id stays null. A part of an item scores by its share of the whole item, so copies of less than half of it are not reported. Empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import documents
from .words import U64, by_size, hash_strings, ranges, span_hash, split_words

FOUND = "doc_id long, item_id long, score double, start_word long, end_word long"
SHORTEST, COUNTED, LONGEST, RARE, RARE_SHARE, RARE_COUNT, SHARED, THRESHOLD = 2, 3, 8, 1e-8, 1e-6, 20, 20, 0.5
ITEM_BYTES = 16 << 20


def normal_words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each normalised word, offsets of each text, the place of each among the text's words, and codes' distinct hashes.

    Words without a letter or digit are left out.
    """
    words = split_words(texts)
    vocab = pc.utf8_lower(words.vocab)
    vocab = pc.replace_substring_regex(vocab, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    hashes = hash_strings(vocab)
    some = pc.greater(pc.binary_length(vocab), 0).to_numpy(zero_copy_only=False).astype(bool)
    keep = some[words.codes]
    kept = np.concatenate([[0], np.cumsum(keep)])
    place = (np.arange(len(words.codes)) - np.repeat(words.offsets[:-1], words.counts))[keep]
    return words.codes[keep], kept[words.offsets], place, hashes


@dataclass(frozen=True)
class Items:
    ids: list
    words: list[np.ndarray]  # word hashes of each item
    vocabulary: np.ndarray  # distinct word hashes, ascending
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by n: hashes ascending, item, place
    heads: dict[int, np.ndarray]  # by n: the words that begin a seed, ascending


def read_items(rows: list) -> tuple[list, list[np.ndarray], np.ndarray]:
    codes, offsets, _, hashes = normal_words(pa.array([r[1] for r in rows], pa.string()))
    flat = hashes[codes]
    words = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return [r[0] for r in rows], words, np.unique(flat)


def item_grams(words: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the hash of every n-gram of the items, its item and its place. An item shorter than ``SHORTEST`` is one n-gram."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.concatenate([*words, np.empty(0, dtype=U64)])
    firsts = np.cumsum(sizes) - sizes
    out = {}
    for n in range(1, LONGEST + 1):
        many = np.where(sizes < SHORTEST, (sizes == n).astype(np.int64), np.maximum(sizes - n + 1, 0) if n >= SHORTEST else 0)
        item = np.repeat(np.arange(len(words)), many)
        place = ranges(many)
        starts = firsts[item] + place
        out[n] = (span_hash(flat, starts, starts + n), item, place)
    return out


def counted_grams(grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """The distinct hashes of the sizes whose occurrences are counted, ascending."""
    return {n: np.unique(grams[n][0]) for n in range(SHORTEST, COUNTED + 1)}


def make_seeds(ids: list, words: list[np.ndarray], vocabulary: np.ndarray, counts: np.ndarray, total: int, gram_counts: dict[int, np.ndarray] | None = None) -> Items:
    """gram_counts: occurrences of each of ``counted_grams``."""
    chance = np.log((counts + 0.5) / (total + 1.0))
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    logs = np.concatenate([[0.0], np.cumsum(np.concatenate([chance[np.searchsorted(vocabulary, w)] for w in words] or [[]]))])
    firsts = np.cumsum(sizes) - sizes
    seeds, heads, done = {}, {}, np.zeros(int(sizes.sum()), dtype=bool)  # places that have their seed
    flat = np.concatenate([*words, np.empty(0, dtype=U64)])
    for n, (h, item, place) in item_grams(words).items():
        distinct, where = np.unique(h, return_inverse=True)
        pairs = np.unique(np.stack([where, item]), axis=1) if len(h) else np.empty((2, 0), dtype=np.int64)
        common = np.bincount(pairs[0], minlength=len(distinct))[where] > SHARED
        at = firsts[item] + place
        rare = logs[at + n] - logs[at] < np.log(RARE)
        if gram_counts is not None and n in gram_counts and len(h):
            rare |= gram_counts[n][where] <= max(RARE_COUNT, RARE_SHARE * total)
        last = (n == LONGEST) | (place + n == sizes[item]) if n >= SHORTEST else np.ones(len(h), dtype=bool)
        # near an item's end the n-gram that reaches it is the longest there
        take = ~done[at] & ((rare & ~common) | last)
        done[at[take]] = True
        if take.any():
            order = np.argsort(h[take], kind="stable")
            seeds[n] = (h[take][order], item[take][order], place[take][order])
            heads[n] = np.unique(flat[at[take]])
    return Items(ids, words, vocabulary, seeds, heads)


def align(item: np.ndarray, length: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair and the place in the text where it ends.

    item: pairs x words (places from ``length`` on never match), text: pairs x words; 0 matches nothing.
    """
    pairs, width = text.shape
    steps = np.arange(width)
    above = np.zeros((pairs, width + 1))
    best, end = np.zeros(pairs), np.zeros(pairs, dtype=np.int64)
    for i in range(item.shape[1]):
        same = (text == item[:, i : i + 1]) & (text != 0)
        row = np.maximum(np.maximum(above[:, :-1] + np.where(same, 2, -1), above[:, 1:] - 1), 0)
        row = np.maximum.accumulate(row + steps, axis=1) - steps
        row[i >= length] = 0
        top = row.argmax(axis=1)
        value = row[np.arange(pairs), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
        above = np.concatenate([np.zeros((pairs, 1)), row], axis=1)
    return best, end


def _padded(rows: list[np.ndarray], width: int, back: bool = False) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=U64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r[::-1] if back else r
    return out


def _runs(known_words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words of the vocabulary follow each place without a break, in its text."""
    n = len(known_words)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    outside = np.flatnonzero(np.concatenate([~known_words, [True]]))
    return np.minimum(outside[np.searchsorted(outside, np.arange(n))], offsets[doc + 1]) - np.arange(n)


def _known(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=bool)
    return vocabulary[np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)] == hashes


def find(items: Items, codes: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end word) of each passage, in kept words of the text."""
    inside = _known(items.vocabulary, hashes)[codes]
    if not inside.any():
        return []
    values = hashes[codes]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    run = _runs(inside, offsets)
    hits = []
    for size, (seeds, item, place) in items.seeds.items():
        starts = np.flatnonzero((run >= size) & _known(items.heads[size], hashes)[codes])
        if not len(starts):
            continue
        h = span_hash(values, starts, starts + size)
        first, last = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
        many = last - first
        which = np.flatnonzero(many)
        if len(which):
            rows = np.repeat(first[which], many[which]) + ranges(many[which])
            pos = np.repeat(starts[which], many[which])
            hits.append(np.stack([doc[pos], item[rows], pos - place[rows]]))
    if not hits:
        return []
    # a hit says where its item would begin; hits of an item whose beginnings lie close are one candidate
    hits = np.concatenate(hits, axis=1)
    d, it, begin = hits[:, np.lexsort((hits[2], hits[1], hits[0]))]
    sizes = np.array([len(w) for w in items.words])
    slack = sizes // 4 + 5
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (it[1:] != it[:-1]) | (begin[1:] - begin[:-1] > slack[it[1:]])])
    group = np.flatnonzero(new)
    bounds = np.append(group, len(d))
    cand_doc, cand_item, low, high = d[group], it[group], begin[group], begin[bounds[1:] - 1]
    # a candidate whose beginnings spread further than the slack is read in windows that overlap by half
    spread, step = high - low, np.maximum(sizes[cand_item], 1)
    many = 1 + np.where(spread > slack[cand_item], spread // step, 0)
    which = np.repeat(np.arange(len(group)), many)
    low = low[which] + ranges(many) * step[which] - slack[cand_item][which]
    high = np.minimum(np.where(many[which] > 1, low + step[which] + 2 * slack[cand_item][which], high[which] + slack[cand_item][which]), high[which] + slack[cand_item][which]) + sizes[cand_item][which]
    cand_doc, cand_item = cand_doc[which], cand_item[which]
    low, high = np.maximum(low, offsets[cand_doc]), np.minimum(high, offsets[cand_doc + 1])
    order = np.flatnonzero(high > low)
    order = order[np.argsort((high - low)[order], kind="stable")]
    out = []
    while len(order):  # each round reports the best passage of a window and looks at what is left around it
        left = []
        at = 0
        while at < len(order):
            size = max(1, min(128, (1 << 20) // max(int((high - low)[order[min(at + 127, len(order) - 1)]]), 1)))
            part = order[at : at + size]
            at += size
            item_rows = [items.words[k] for k in cand_item[part]]
            text_rows = [values[low[g] : high[g]] for g in part]
            length = np.array([len(r) for r in item_rows])
            score, end = align(_padded(item_rows, length.max()), length, _padded(text_rows, max(map(len, text_rows))))
            good = np.flatnonzero(score >= THRESHOLD * 2 * length)
            if not len(good):
                continue
            back, start = align(_padded([item_rows[k] for k in good], length[good].max(), True), length[good], _padded([text_rows[k][: end[k] + 1] for k in good], int(end[good].max()) + 1, True))
            for k, s in zip(good.tolist(), start.tolist(), strict=True):
                g = part[k]
                a, b = int(low[g] + end[k] - s), int(low[g] + end[k] + 1)
                out.append((int(cand_doc[g]), int(cand_item[g]), float(score[k] / (2 * length[k])), a, b))
                left += [(cand_doc[g], cand_item[g], low[g], a), (cand_doc[g], cand_item[g], b, high[g])]
        # what is left of a window on either side of a passage can hold another one only if half of the item fits
        left = [x for x in left if x[3] - x[2] >= THRESHOLD * sizes[x[1]]]
        cand_doc, cand_item, low, high = (np.array(x, dtype=np.int64) for x in zip(*left, strict=True)) if left else (np.empty(0, np.int64),) * 4
        order = np.argsort(high - low, kind="stable")
    return _best(out)


def _best(found: list[tuple[int, int, float, int, int]]) -> list[tuple[int, int, float, int, int]]:
    """Of passages of one item that overlap in a text, the best; of equal ones the first."""
    kept: list[tuple[int, int, float, int, int]] = []
    taken: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for row in sorted(set(found), key=lambda r: (r[0], r[1], -r[2], r[3])):
        own = taken[row[:2]]
        k = bisect_left(own, (row[3], row[4]))
        if (k and own[k - 1][1] > row[3]) or (k < len(own) and own[k][0] < row[4]):
            continue
        own.insert(k, (row[3], row[4]))
        kept.append(row)
    return sorted(kept)


def _blocks(benchmark: DataFrame) -> list[list]:
    """The items' rows, in blocks of at most ITEM_BYTES (and one item at least)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(size * 2 // ITEM_BYTES)
    for k in range(parts):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]  # a block


def _count(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Occurrences (kind, key, n): of the vocabulary's words (kind 1, their place; key -1: of all words) and of counted n-grams (kind: their size)."""
    vocabulary, grams = shared.value
    for batch in batches:
        for part in by_size(batch):
            codes, offsets, _, hashes = normal_words(part["text"])
            each = np.bincount(codes, minlength=len(hashes))
            known = _known(vocabulary, hashes)
            at = np.searchsorted(vocabulary, hashes)
            total = np.bincount(at[known], weights=each[known], minlength=len(vocabulary)).astype(np.int64)
            used = np.flatnonzero(total)
            found = [(np.ones(len(used) + 1, np.int64), np.append(used, -1), np.append(total[used], len(codes)))]
            values, run = hashes[codes], _runs(known[codes], offsets)
            for n, wanted in grams.items():
                starts = np.flatnonzero(run >= n)
                if not len(starts) or not len(wanted):
                    continue
                h = span_hash(values, starts, starts + n)
                place = np.searchsorted(wanted, h[_known(wanted, h)])
                count = np.bincount(place, minlength=len(wanted))
                used = np.flatnonzero(count)
                found.append((np.full(len(used), n), used, count[used]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["kind", "key", "n"])


def prepared(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast items with their seeds, block by block."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for block in _blocks(benchmark):
        ids, words, vocabulary = read_items(block)
        grams = counted_grams(item_grams(words))
        shared = spark.sparkContext.broadcast((vocabulary, grams))
        # one row for each word and counted n-gram of the block at most
        counted = texts.mapInArrow(lambda it, v=shared: _count(it, v), "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
        kind, key, n = (counted[c].to_numpy() for c in ("kind", "key", "n"))
        total = int(n[(kind == 1) & (key < 0)].sum())
        of = lambda k, size: np.bincount(key[(kind == k) & (key >= 0)], weights=n[(kind == k) & (key >= 0)], minlength=size)
        yield spark.sparkContext.broadcast(make_seeds(ids, words, vocabulary, of(1, len(vocabulary)), total, {k: of(k, len(h)) for k, h in grams.items()}))


def _report(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    own = items.value
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
    for batch in batches:
        for part in by_size(batch):
            codes, offsets, place, hashes = normal_words(part["text"])
            got = find(own, codes, offsets, hashes)
            if got:
                d, it, score, a, b = (np.array(x) for x in zip(*got, strict=True))
                docs = part["doc_id"].combine_chunks().take(pa.array(d))
                yield pa.RecordBatch.from_arrays([docs, pa.array([own.ids[k] for k in it], pa.int64()), pa.array(score), pa.array(place[a]), pa.array(place[b - 1] + 1)], schema=schema)


def _keep_clean(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    own = items.value
    for batch in batches:
        for part in by_size(batch):
            codes, offsets, _, hashes = normal_words(part["text"])
            clean = np.ones(part.num_rows, dtype=bool)
            clean[[row[0] for row in find(own, codes, offsets, hashes)]] = False
            yield from part.filter(pa.array(clean)).combine_chunks().to_batches()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each passage of a document that copies an item: doc_id, item_id, score, start_word, end_word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in prepared(docs, benchmark):
        part = rows.mapInArrow(lambda it, items=items: _report(it, items), FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that copy no item, with all their columns."""
    out = docs
    for items in prepared(docs, benchmark):
        out = out.mapInArrow(lambda it, items=items: _keep_clean(it, items), docs.schema)
    return out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
