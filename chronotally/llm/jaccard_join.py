"""N-gram Jaccard join by chosen paths.

A text's set holds its distinct runs of five words (a shorter text has one: all its words). Equal sets are one class from the start.
Each set samples about ``SAMPLED`` of its tokens by a hash of the token against a threshold that falls with the set's size (a set
of fewer tokens keeps all); these are the first steps of all runs at once, and a pair of similarity ``threshold`` shares none of them with
a chance below exp(-threshold * SAMPLED), under 1e-6, which is the recall that the runs aim at. The sets that chose a token form a
bucket. A bucket of up to ``SMALL`` sets is compared by brute force on sketches (one-permutation minhash). The sets of a larger one are held against
three of them (the pivots) on sketches: sets over ``LIKE`` are linked to the pivot, and those over ``SAME`` leave the bucket; distance being a metric, what is
similar to one that left is near enough the pivot to be linked to it too. A bucket whose sets, all but ``SMALL``, are linked to the same pivot
is done by brute force: these few are held against all, and the rest are one candidate group already.
So a group of near copies ends as links, and only what differs is split: each of these sets
extends the path by further tokens of its sample that have large buckets too, chosen by a hash of path and token, ``BRANCH`` on average and more from a small sample before step ``BOOSTED``, ``LEAP`` steps
at a time. Texts that only share a passage part there, as fewer than one of their extensions is common on
average. After ``DEEPEST`` steps a bucket is kept together without comparing.

Splitting may lose a pair all of whose buckets are large: each path dies if its two sets have no extension in common. For a pair of
similarity 0.8 that is a branching process of about 16 first paths with 1.42 common extensions each, which dies out from one path with chance 0.47; all
die with a chance of about exp(-16 * 0.53), 2e-4, in one run. Sets that were split go through ``RUNS`` runs in all, each with its own sample and its own extensions;
no pair outside can have been lost by splitting. The target is a recall of 0.999 of links at the threshold itself whose sets were all split (links that
are closer are missed far less, and those in buckets of up to ``SMALL`` with the chance of the first tokens, under 1e-6); one run reaches it, two would miss 4e-8.

Sketch matches and kept buckets only make candidate groups (their connected components). Inside a group every pair is then compared exactly
on the full sets, so the links are exact and nothing is capped: a group beyond ``BLOCK`` sets is compared in pairs of blocks. The result
has each document's class (connected component of the links; its smallest doc_id) and the number of documents linked to it.

Defined results: null and empty texts have no set; each is a class of its own without links. Copies, also rows of equal doc_id, are linked to each
other. A class whose doc_ids are all null has a null class_id. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .shared import shuffle_width, stage
from .words import U64, by_size, hash_strings, mix, ranges, release, span_hash, split_words

GRAM, THRESHOLD = 5, 0.8
SAMPLED, SMALL, BRANCH, BOOSTED, LEAP, DEEPEST, BLOCK = 18.0, 128, 1.6, 3, 3, 10, 256
SLICE = 1024
BINS, SKETCH_AT = 128, 0.55
LIKE, SAME = 0.45, 0.75
RUNS = 1
STEPS = [f"steps{k}" for k in range(RUNS)]
BROADCAST_ROWS = 500_000


def shingles(texts: pa.Array | pa.ChunkedArray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token hashes of each text, ascending in it, and the offsets of each text."""
    words = split_words(texts)
    values = hash_strings(words.vocab)[words.codes]
    n = words.counts
    many = np.where(n >= gram, n - gram + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), many)
    starts = np.repeat(words.offsets[:-1], many) + ranges(many)
    ends = np.minimum(starts + gram, words.offsets[doc + 1])
    h = span_hash(values, starts, ends)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.empty(0, dtype=bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def sketches(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One byte for each of BINS parts of the hash range: of the least token there; 0 if there is none."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    part = (h >> U64(57)).astype(np.int64)
    key = doc * BINS + part
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=bool)
    out = np.zeros((len(offsets) - 1) * BINS, dtype=np.uint8)
    out[key[first]] = 1 + (mix(h[first]) % U64(255)).astype(np.uint8)
    return out.reshape(-1, BINS)


def sampled(h: np.ndarray, offsets: np.ndarray, run: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that each set chooses in a run, and their offsets."""
    n = np.repeat(np.diff(offsets), np.diff(offsets))
    chance = mix(h ^ U64(0xA5A5A5A5A5A5A5A5 + 0x1F3D5B79 * run)) / 2.0**64
    keep = chance < SAMPLED / np.maximum(n, 1)
    total = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], total[offsets]


DESCRIBED = f"doc_id long, tie long, sid binary, n long, {', '.join(f'{c} array<long>' for c in STEPS)}, sketch binary"


def _describe(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, most=4 << 20):
                h, offsets = shingles(part["text"], gram)
                n = np.diff(offsets)
                sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(k)), dtype=U64)]) for k in (0x1234567, 0x89ABCDE)]
                halves = np.stack([s[offsets[1:]] - s[offsets[:-1]] for s in sums], axis=1)
                sid = [x.tobytes() if k else None for x, k in zip(halves, n.tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(steps.view(np.int64))) for steps, at in (sampled(h, offsets, k) for k in range(RUNS))]
                marks = [x.tobytes() for x in sketches(h, offsets)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), part["tie"].combine_chunks(), pa.array(sid, pa.binary()), pa.array(n.astype(np.int64)), *lists, pa.array(marks, pa.binary())], names=["doc_id", "tie", "sid", "n", *STEPS, "sketch"])

    return run


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _share(a, b) >= SKETCH_AT


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, vertex) for each vertex of the pairs but the roots: stars with the same components."""
    names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[x], label[y])
        moved = label.copy()
        np.minimum.at(moved, label[x], least)
        np.minimum.at(moved, label[y], least)
        moved = moved[moved]
        if (moved == label).all():
            break
        label = moved
    while (label[label] != label).any():
        label = label[label]
    others = np.flatnonzero(label != np.arange(len(names)))
    return names[label[others]], names[others]


def _brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, vid, sketch) ordered by path: the pairs of a bucket with like sketches, thinned to a forest with the same components."""

    def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        path, vid, marks = table["path"].to_numpy(), table["vid"].to_numpy(), _marks(table)
        for gap in range(1, min(SMALL, len(path))):
            at = np.flatnonzero(path[gap:] == path[:-gap])
            if not len(at):
                break
            for k in range(0, len(at), 1 << 15):
                some = at[k : k + (1 << 15)]
                some = some[_alike(marks[some], marks[some + gap])]
                yield vid[some], vid[some + gap]

    return _by_bucket(batches, pairs)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, vid, sketch, other) ordered by path: as ``_brute``, but only pairs of a row with ``other`` and any row."""

    def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        path, vid, marks = table["path"].to_numpy(), table["vid"].to_numpy(), _marks(table)
        for one in np.flatnonzero(table["other"].to_numpy()):
            a, b = np.searchsorted(path, [path[one]], "left")[0], np.searchsorted(path, [path[one]], "right")[0]
            like = a + np.flatnonzero(_alike(marks[a:b], marks[one]) & (vid[a:b] != vid[one]))
            yield vid[like], np.full(len(like), vid[one])

    return _by_bucket(batches, pairs)


def _marks(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)


def _by_bucket(batches: Iterator[pa.RecordBatch], found: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """The pairs that are ``found`` in whole buckets of rows ordered by path, as forests (a, b)."""
    held: pa.Table | None = None

    def pairs(table: pa.Table) -> pa.RecordBatch:
        both = [np.stack([np.minimum(a, b), np.maximum(a, b)]) for a, b in found(table)]
        both = np.concatenate(both, axis=1) if both else np.empty((2, 0), dtype=np.int64)
        least, most = forest(both[0], both[1])
        return pa.RecordBatch.from_arrays([pa.array(least), pa.array(most)], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        path = table["path"].to_numpy()
        cut = int(np.searchsorted(path, path[-1], "left")) if len(path) else 0  # the last bucket may go on
        yield pairs(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield pairs(held)
    release()


def candidate_edges(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of vids whose components hold every similar pair. sets: vid, the steps of each run, sketch."""
    edges, split = _one_run(sets.select("vid", F.col(STEPS[0]).alias("steps"), "sketch"), 0)
    if split is not None and RUNS > 1:
        # only pairs whose buckets were all split can be lost by it
        again = stage(sets.join(split.select("vid").distinct(), "vid"), "again")
        for run in range(1, RUNS):
            edges = edges.unionByName(_one_run(again.select("vid", F.col(STEPS[run]).alias("steps"), "sketch"), run)[0])
    return edges.distinct()


def _one_run(sets: DataFrame, run: int) -> tuple[DataFrame, DataFrame | None]:
    """The edges of one run, and the (path, vid) of the sets of first buckets that were split. sets: vid, steps, sketch."""
    paths = sets.select("vid", F.explode("steps").alias("path"))
    found, split, wide, depth = [], None, None, 1
    while True:
        # staged, so that the join stands on its own shuffles, which may be split where a path has many sets
        sizes = stage(paths.groupBy("path").count().where("count > 1"), "sizes")
        met = stage(paths.join(sizes, "path"), "paths")
        small = met.where(F.col("count") <= SMALL).select("path", "vid").join(sets.select("vid", "sketch"), "vid")
        # staged too: the plan of all steps together would be more than the driver should hold
        found.append(stage(small.select("path", "vid", "sketch").repartition("path").sortWithinPartitions("path").mapInArrow(_brute, "a long, b long"), "close"))
        large = met.where(F.col("count") > SMALL).select("path", "vid")
        if large.isEmpty():
            break
        if depth >= DEEPEST:
            least = large.groupBy("path").agg(F.min("vid").alias("b"))
            found.append(large.join(least, "path").where("vid <> b").select(F.col("vid").alias("a"), "b").distinct())
            break
        if depth < DEEPEST:
            chosen = F.array_distinct(F.array(F.min("vid"), F.max("vid"), F.min_by("vid", F.xxhash64("vid", "path"))))
            pivots = large.groupBy("path").agg(chosen.alias("pivot")).select("path", F.explode("pivot").alias("pivot"))
            pivots = pivots.join(sets.select(F.col("vid").alias("pivot"), F.col("sketch").alias("mark")), "pivot").groupBy("path").agg(F.collect_list("pivot").alias("pivots"), F.collect_list("mark").alias("marks"))
            one = lambda name, k: F.get(name, F.lit(k)).alias(f"{name}{k}")
            # dealt by set, as a hot path's sets are too many for one task
            held = large.join(pivots, "path").repartition("vid").join(sets.select("vid", "sketch"), "vid").select("path", "vid", "sketch", *[one(name, k) for name in ("pivots", "marks") for k in range(3)])
            held = stage(held.mapInArrow(_against_pivots, "path long, vid long, near long, a long, b long"), "pivots")
            large, beside = _but_one_group(held.where("path is not null").select("path", "vid", "near"), sets)
            found += [held.where("a is not null").select("a", "b"), beside]
            if large.isEmpty():
                break
            if depth == 1:
                split = large
                # a pair whose buckets were all split shares only tokens of split buckets: no others are worth a step
                wide = met.join(large.select("path").distinct(), "path").groupBy("vid").agg(F.collect_list("path").alias("wide"))
                wide = stage(wide.join(sets.select("vid", F.size("steps").alias("n")), "vid"), "wide")
        longer = large.repartition("vid").join(wide, "vid").withColumn("paths", F.array("path"))
        for step in range(depth, depth + LEAP):
            # a small sample extends more in the first steps, up to all its tokens, as it has few paths that could find a pair
            boost = F.greatest(F.lit(1.0), SAMPLED / F.col("n")) if step < BOOSTED else F.lit(1.0)
            # the order of the steps doesn't matter to who shares them
            chosen = lambda path: F.filter("wide", lambda t: (t != path) & (F.pmod(F.xxhash64(path, t, F.lit(run)), F.lit(1 << 20)) * F.col("n") < boost * BRANCH * (1 << 20)))  # noqa: E731, B023
            extended = lambda path: F.transform(chosen(path), lambda t: F.xxhash64(path, t, F.lit(step)))  # noqa: E731, B023
            longer = longer.withColumn("paths", F.flatten(F.transform("paths", extended)))
        depth += LEAP
        paths = longer.select("vid", F.explode_outer("paths").alias("path")).where("path is not null")
    edges = found[0]
    for part in found[1:]:
        edges = edges.unionByName(part)
    return edges, split


def _but_one_group(large: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (path, vid) of buckets that go on, and the pairs (a, b) of those that don't: whose sets, all but SMALL, are linked to the same pivot.

    large: path, vid, near (bit k: linked to the bucket's pivot k).
    """
    to = [F.struct(F.sum(F.shiftright("near", k) % 2).alias("count"), F.lit(1 << k).cast("long").alias("bit")) for k in range(3)]
    groups = large.groupBy("path").agg(F.greatest(*to).alias("most"), F.count("*").alias("n"))
    groups = stage(groups.withColumn("others", F.col("n") - F.col("most.count")).where(F.col("others") <= SMALL).select("path", F.col("most.bit").alias("bit"), "n", "others"), "alike")
    # a hot path's sets are too many for one task: they lie in slices, each with the few others
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    mixed = large.join(groups.where("others > 0"), "path").withColumn("other", F.col("near").bitwiseAND(F.col("bit")) == 0)
    mixed = mixed.withColumn("slice", F.explode(F.when(F.col("other"), F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.pmod(F.xxhash64("vid"), slices).cast("int")))))
    mixed = mixed.select(F.xxhash64("path", "slice").alias("path"), "vid", "other").repartition("vid").join(sets.select("vid", "sketch"), "vid").select("path", "vid", "sketch", "other")
    beside = stage(mixed.repartition("path").sortWithinPartitions("path").mapInArrow(_beside, "a long, b long"), "beside")
    return large.join(groups, "path", "left_anti").select("path", "vid"), beside


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row."""
    return ((a == b) & (a != 0)).sum(axis=1) / np.maximum(((a | b) != 0).sum(axis=1), 1)


def _against_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, vid of the sets that stay in their bucket, with the pivots they are linked to, and the links (a, b), thinned to a forest with the same components."""
    empty = bytes(BINS)
    rows = lambda column: np.frombuffer(b"".join(x or empty for x in column.to_pylist()), np.uint8).reshape(-1, BINS)
    for batch in batches:
        if not batch.num_rows:
            continue
        own, path, vid = rows(batch["sketch"]), batch["path"].to_numpy(), batch["vid"].to_numpy()
        shares = np.stack([_share(own, rows(batch[f"marks{k}"])) for k in range(3)], axis=1)
        names = np.stack([batch[f"pivots{k}"].fill_null(-1).to_numpy() for k in range(3)], axis=1)
        near = (shares >= LIKE) & (names >= 0)
        which, k = np.nonzero(near & (names != vid[:, None]))
        a, b = forest(vid[which], names[which, k]) if len(which) else (np.empty(0, np.int64),) * 2
        stays = ~(shares >= SAME).any(axis=1)
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(path[stays]), pa.array(vid[stays]), pa.array(near[stays] @ np.array([1, 2, 4])), none(int(stays.sum())), none(int(stays.sum()))], names=["path", "vid", "near", "a", "b"])
        yield pa.RecordBatch.from_arrays([none(len(a)), none(len(a)), none(len(a)), pa.array(a), pa.array(b)], names=["path", "vid", "near", "a", "b"])
    release()


def _sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, most=4 << 20):
                h, offsets = shingles(part["text"], gram)
                raw = memoryview(h.tobytes())
                packed = [bytes(raw[a * 8 : b * 8]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part[c].combine_chunks() for c in ("vid", "root", "block", "blocks", "copies")] + [pa.array(packed, pa.binary())], names=["vid", "root", "block", "blocks", "copies", "tokens"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[token] > 1
    number = np.cumsum(count > 1) - 1
    token, owner = number[token[shared]], owner[shared]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    width = max(1024, (8 << 20) // (4 * len(sets)))
    total = int(token[-1]) + 1 if len(token) else 0
    for first in range(0, total, width):
        a, b = np.searchsorted(token, [first, first + width])
        part = np.zeros((len(sets), min(width, total - first)), dtype=np.float32)
        part[owner[a:b], token[a:b] - first] = 1
        out += part @ part.T
    return out


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Exact links in a cell: (vid, other, links), other: a linked vid that keeps the component together, or null."""
        vid, root, block, copies = (table[c].to_numpy() for c in ("vid", "root", "block", "copies"))
        tokens = [np.frombuffer(x, U64) for x in table["tokens"].to_pylist()]
        order = np.lexsort((vid, root))
        bounds = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1], [True]]))
        out_vid, out_other, out_links = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = order[a:b]
            rows = rows[np.concatenate([[True], vid[rows][1:] != vid[rows][:-1]])]  # a repeated row is one set
            if len(rows) < 2:
                continue
            both = _overlaps([tokens[r] for r in rows])
            size = np.array([len(tokens[r]) for r in rows], dtype=np.float32)
            union = size[:, None] + size[None, :] - both
            linked = both >= threshold * union - 1e-3
            np.fill_diagonal(linked, False)
            parts = block[rows]
            if parts[0] != parts[-1] or (parts != parts[0]).any():
                linked &= parts[:, None] != parts[None, :]  # pairs inside a block belong to that block's own cell
            links = linked @ copies[rows].astype(np.float64)
            # a spanning forest: each new component is walked breadth first
            seen = np.zeros(len(rows), dtype=bool)
            for first in range(len(rows)):
                if seen[first] or not links[first]:
                    continue
                seen[first] = True
                front = [first]
                while front:
                    new = np.flatnonzero(linked[front].any(axis=0) & ~seen)
                    seen[new] = True
                    out_vid.append(vid[rows[new]])
                    out_other.append(np.full(len(new), vid[rows[first]]))
                    out_links.append(np.zeros(len(new)))
                    front = new.tolist()
            some = links > 0
            out_vid.append(vid[rows[some]])
            out_other.append(np.full(int(some.sum()), -1))
            out_links.append(links[some])
        del tokens
        release()
        cat = lambda x: np.concatenate(x) if x else np.empty(0)
        return pa.table({"vid": pa.array(cat(out_vid).astype(np.int64)), "other": pa.array(cat(out_other).astype(np.int64)), "links": pa.array(cat(out_links).astype(np.int64))})

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """doc_id, tie (a hash of the text), root (a number of the class; null without words), class_id, n_links and n_shingles of every document of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    described = stage(rows.mapInArrow(_describe(gram), DESCRIBED), "described")
    # equal sets are one vertex; copies of a document meet in the partial aggregate
    sets = described.where("n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in STEPS), F.first("sketch").alias("sketch"))
    sets = stage(sets.withColumn("vid", F.monotonically_increasing_id()), "sets")
    groups = stage(components(candidate_edges(sets)), "groups")

    large = groups.groupBy("root").count().where(F.col("count") > BLOCK).select("root", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    members = groups.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select(F.col("vertex").alias("vid"), "root", "blocks", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int").alias("block"))
    members = stage(members.join(sets.select("vid", "first", "copies"), "vid").select("vid", "root", "block", "blocks", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie")), "members")
    n_members = members.count()
    # (a few dozen bytes a row)
    own = F.broadcast(members) if n_members <= BROADCAST_ROWS else members
    texts = rows.join(own, rows["doc_id"].eqNullSafe(own["first_id"]) & (rows["tie"] == own["first_tie"])).select("vid", "root", "block", "blocks", "copies", "text")
    width = shuffle_width(spark)
    cells = max(2 * width, n_members // 2000)
    placed = texts.mapInArrow(_sets(gram), "vid long, root long, block int, blocks int, copies long, tokens binary").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # small groups share cells; a large group has a cell for each pair of its blocks
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(cells))).otherwise(F.xxhash64("root", F.least("block", "with"), F.greatest("block", "with")))
    found = stage(placed.withColumn("cell", cell).drop("with", "blocks").groupBy("cell").applyInArrow(_verify(threshold), "vid long, other long, links long"), "links")

    links = found.where("other < 0").groupBy("vid").agg(F.sum("links").alias("links"))
    roots = components(found.where("other >= 0").select(F.col("vid").alias("a"), F.col("other").alias("b")))
    classes = sets.select("vid", "sid", "least", "copies").join(roots.withColumnRenamed("vertex", "vid"), "vid", "left").join(links, "vid", "left")
    classes = stage(classes.select("sid", F.coalesce("root", "vid").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    names = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = classes.join(names, "root").select("sid", "root", "class_id", "n_links")
    out = described.select("doc_id", "tie", "sid", "n").join(classes, "sid", "left")
    return out.select("doc_id", "tie", "root", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n").alias("n_shingles"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: of its smallest doc_id (null ones last), then text hash; all without words stay."""
    key = F.xxhash64("text")
    tie = next(name for name in (f"tie{k}" for k in range(len(docs.columns) + 1)) if name not in docs.columns)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")).alias("first")
    # by root: two classes may share their smallest doc_id
    firsts = near_duplicates(docs).where("n_shingles > 0").groupBy("root").agg(first).select(F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie")).distinct()
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0d]"), F.lit(False))
    rows = docs.where(some).withColumn(tie, key)
    kept = rows.join(firsts, rows["doc_id"].cast("long").eqNullSafe(firsts["first_id"]) & (rows[tie] == firsts["first_tie"]), "left_semi").dropDuplicates(["doc_id", tie]).drop(tie)
    return kept.unionByName(docs.where(~some))


def sql(threshold: float = THRESHOLD, gram: int = GRAM) -> str:
    """The same in DuckDB's SQL: all pairs that share a shingle."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + {gram - 1}), ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - {gram - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
links AS (SELECT x.a, x.b FROM (SELECT a.r AS a, b.r AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2) x JOIN sizes p ON p.r = x.a JOIN sizes q ON q.r = x.b WHERE x.n >= {threshold} * (p.n + q.n - x.n)),
reach AS (SELECT r AS v, r AS s FROM d UNION SELECT l.b, reach.s FROM reach JOIN links l ON l.a = reach.v),
classes AS (SELECT reach.v, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.s GROUP BY reach.v),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, c.class_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_links, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles FROM d JOIN classes c ON c.v = d.r LEFT JOIN degree g ON g.a = d.r LEFT JOIN sizes s ON s.r = d.r"""


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("tie", "root")
