"""Token-id output as a content-addressed store.

``write_store`` encodes every whole text, appends the end id and cuts each
document's id stream where a rolling hash of the last 16 ids hits a fixed pattern
(on average every ``AVERAGE`` ids, at most ``LONGEST``), so equal passages give equal
chunks wherever they stand. It writes three Parquet tables:

* ``chunks``   chunk_id (BLAKE2b of the ids), n_ids, payload (little-endian ids, 16 or
  32 bits wide), each distinct chunk once;
* ``recipes``  in ascending doc_id order: doc_id, start, n_tokens, the chunk ids in
  order, and the root of their Merkle tree;
* ``manifest`` for each page of up to ``PAGE`` consecutive recipes: its first start, the number of
  documents and ids, and the Merkle root over its documents' ids, starts, sizes and roots.

``read_digests`` and ``read_ids`` work from these files alone. They first hold the recipes against the manifest, page by page,
so that missing, extra or altered recipes are found; they check every chunk against its id and every document
against its recipe and Merkle root, and fail on a missing or altered chunk.

Defined results: a null text counts as empty (the end id only). Null doc_ids come
first; rows of equal doc_id are ordered by a hash of their text, and equal rows (of which a range may
hold a part only) stay separate documents. An empty table gives an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from . import crc
from .shared import discard, new_path
from .subwords import append_id, encoder, vocabulary_path
from .words import by_size

WINDOW, AVERAGE, LONGEST = 16, 512, 8192
DIGEST = 16
PAGE = 4096


@dataclass(frozen=True)
class Store:
    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; a last odd node moves up unchanged, no leaf gives the hash of nothing."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=DIGEST).digest()
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=DIGEST).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def chunk_ends(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks, ascending; every document ends a chunk.

    A cut depends on the 16 ids before it only, so it is found again in any other
    document that holds them.
    """
    # gear hash of the last 16 ids: each id's own mark, shifted by its distance; spans of 2, 4, 8, 16 by doubling
    rolled, span = ids * np.uint32(0x9E3779B1), 1
    rolled ^= rolled >> np.uint32(15)
    while span < WINDOW:
        rolled = rolled[span:] + (rolled[:-span] << np.uint32(span))
        span *= 2
    ends = np.flatnonzero(rolled >> np.uint32(16) < (1 << 16) // AVERAGE) + WINDOW
    cuts = np.unique(np.concatenate([ends, offsets[1:]]))
    cuts = cuts[cuts > 0]
    starts = np.concatenate([[0], cuts[:-1]])
    if (cuts - starts).max(initial=0) > LONGEST:
        extra = [np.arange(a + LONGEST, b, LONGEST) for a, b in zip(starts, cuts, strict=True) if b - a > LONGEST]
        cuts = np.unique(np.concatenate([cuts, *extra]))
    return cuts


_STAGED = "doc_id long, tie long, copy long, n_tokens long, root binary, recipe array<struct<chunk_id:binary,n_ids:int>>, payload array<binary>"


def _encode(path: str, end_id: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, spaces=True)
        schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("copy", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("recipe", pa.list_(pa.struct([("chunk_id", pa.binary()), ("n_ids", pa.int32())]))), ("payload", pa.list_(pa.binary()))])
        for batch in batches:
            for part in by_size(batch, most=8 << 20):
                ids, offsets, _, _ = tool.encode(part["text"])
                ids, offsets = append_id(ids, offsets, end_id)
                ends = chunk_ends(ids, offsets)
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.astype("<u4" if wide else "<u2").tobytes())
                size = 4 if wide else 2
                payload = [bytes(raw[a * size : b * size]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                names = [hashlib.blake2b(x, digest_size=DIGEST).digest() for x in payload]
                bounds = np.searchsorted(ends, offsets[1:], side="left") + 1
                bounds = np.concatenate([[0], bounds]).astype(np.int32)
                seen: set[bytes] = set()
                once = [x if not (name in seen or seen.add(name)) else None for name, x in zip(names, payload, strict=True)]
                recipe = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array((ends - starts).astype(np.int32))], ["chunk_id", "n_ids"])
                roots = [merkle(names[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                where = pa.array(bounds)
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks().cast(pa.int64()), part["tie"].combine_chunks(), part["copy"].combine_chunks(), pa.array(np.diff(offsets)), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(where, recipe), pa.ListArray.from_arrays(where, pa.array(once, pa.binary()))], schema=schema)

    return run


def write_store(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> Store:
    """Encode ``docs`` (doc_id, text) and write the store under ``path``."""
    spark = docs.sparkSession
    wide = end_id >= 1 << 16 or _vocabulary_size(vocabulary) > 1 << 16
    staging = f"{path}/staging"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy"))
    rows.mapInArrow(_encode(vocabulary_path(vocabulary), end_id, wide), _STAGED).write.option("compression", "zstd").parquet(staging)
    staged = spark.read.schema(_STAGED).parquet(staging)

    # each distinct chunk once: a batch keeps one payload of a chunk, so a hot chunk has few rows in the shuffle
    (
        staged.select(F.explode(F.arrays_zip("recipe", "payload")).alias("c"))
        .select("c.recipe.chunk_id", "c.recipe.n_ids", "c.payload")
        .where("payload is not null")
        .groupBy("chunk_id")
        .agg(F.first("n_ids").alias("n_ids"), F.first("payload").alias("payload"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/chunks")
    )
    # recipes in ascending doc_id order; first by range, then with the ids before each range added
    (
        staged.select("doc_id", "tie", "copy", "n_tokens", "root", "recipe")
        .repartitionByRange("doc_id", "tie", "copy")
        .sortWithinPartitions("doc_id", "tie", "copy")
        .drop("copy")
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id())
        .write.option("compression", "zstd")
        .parquet(f"{path}/ranges")
    )
    ranges = spark.read.parquet(f"{path}/ranges")
    # one row for each shuffle partition: its number is set, and does not follow the input
    sums = ranges.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sums.withColumn("first", F.coalesce(before, F.lit(0)))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    (
        ranges.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(F.broadcast(firsts.select("part", "first")), "part")
        .select("part", "place", "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "root", "recipe")
        .write.option("compression", "zstd")
        .parquet(f"{path}/recipes")
    )
    _pages(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    discard(spark, staging)
    discard(spark, f"{path}/ranges")
    return Store(path)


def _vocabulary_size(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(vocabulary)).get_vocab_size()


def _pages(recipes: DataFrame) -> DataFrame:
    """The manifest of ``recipes``: part, page, first, n_docs, n_tokens, root."""
    page = F.floor((F.col("place") % (1 << 33)) / PAGE).alias("page")  # a row's number inside its range
    return recipes.select("part", page, "place", "doc_id", "start", "n_tokens", "root").groupBy("part", "page").applyInArrow(_page_root, "part int, page long, first long, n_docs long, n_tokens long, root binary")


def _page_root(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    leaves = [f"{i},{a},{n},".encode() + root for i, a, n, root in zip(*(table[c].to_pylist() for c in ("doc_id", "start", "n_tokens", "root")), strict=True)]
    return pa.table({
        "part": pa.array([key[0].as_py()], pa.int32()), "page": pa.array([key[1].as_py()], pa.int64()), "first": pa.array([pc.min(table["start"]).as_py()], pa.int64()), "n_docs": pa.array([table.num_rows], pa.int64()),
        "n_tokens": pa.array([pc.sum(table["n_tokens"]).as_py()], pa.int64()), "root": pa.array([merkle(leaves)], pa.binary()),
    })


def check_manifest(spark: SparkSession, store: Store) -> None:
    """Fails unless the recipes are the manifest's, page by page, and the pages' ids follow each other without a gap."""
    names = ["part", "page", "first", "n_docs", "n_tokens", "root"]
    have, want = _pages(store.table(spark, "recipes")).select(names), store.table(spark, "manifest").select(names)
    wrong = have.exceptAll(want).unionByName(want.exceptAll(have)).select("part", "page").first()
    if wrong is not None:
        raise ValueError(f"the recipes of range {wrong.part}, page {wrong.page}, are not the manifest's")
    sums = want.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.max(F.col("first") + F.col("n_tokens")), F.lit(0)).alias("end"), F.min("first").alias("first")).first()
    if sums.n != sums.end or sums.first not in (0, None):
        raise ValueError("the manifest lacks pages")


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chunk_id", pa.binary()), ("n_ids", pa.int32()), ("crc", pa.int64())])
    for batch in batches:
        names, payloads, counts = batch["chunk_id"].to_pylist(), batch["payload"].to_pylist(), batch["n_ids"].to_pylist()
        sums = []
        for name, raw, n in zip(names, payloads, counts, strict=True):
            if hashlib.blake2b(raw, digest_size=DIGEST).digest() != name:
                raise ValueError(f"chunk {name.hex()} doesn't match its id")
            sums.append(zlib.crc32(raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int32()), pa.array(sums, pa.int64())], schema=schema)


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        moved = crc.shift(batch["crc"].to_numpy(), batch["ids_after"].to_numpy())
        yield pa.RecordBatch.from_arrays([batch["start"], batch["n_ids"], pa.array(moved.astype(np.int64))], names=["start", "n_ids", "crc"])


def _check_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each recipe's chunks with the ids that follow them in the document, after its Merkle root was found right."""
    for batch in batches:
        recipe = batch["recipe"]
        chunks = recipe.flatten()
        names, sizes = chunks.field("chunk_id"), chunks.field("n_ids").to_numpy().astype(np.int64)
        counts = np.asarray(pc.list_value_length(recipe)).astype(np.int64)
        ends = np.cumsum(counts)
        plain = names.to_pylist()
        for a, b, root in zip((ends - counts).tolist(), ends.tolist(), batch["root"].to_pylist(), strict=True):
            if merkle(plain[a:b]) != root:
                raise ValueError("a recipe doesn't match its Merkle root")
        before = np.cumsum(sizes)
        firsts = np.concatenate([[0], before])[ends - counts]
        after = np.repeat(batch["n_tokens"].to_numpy() + firsts, counts) - before
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["start"].to_numpy(), counts)), names, pa.array(after)], names=["start", "chunk_id", "ids_after"])


def read_digests(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the store's files."""
    check_manifest(spark, store)
    chunks = store.table(spark, "chunks").mapInArrow(_check_chunks, "chunk_id binary, n_ids int, crc long")
    recipes = store.table(spark, "recipes")
    uses = recipes.select("start", "n_tokens", "root", "recipe").mapInArrow(_check_roots, "start long, chunk_id binary, ids_after long")
    found = uses.join(chunks, "chunk_id", "left")
    found = found.select("start", "ids_after", F.coalesce("crc", F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("crc"), "n_ids")
    sums = (
        found.mapInArrow(_shifted, "start long, n_ids int, crc long")
        .groupBy("start")
        .agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n_ids").alias("n_read"))
    )
    whole = recipes.select("doc_id", "start", "n_tokens").join(sums, "start", "left")
    agrees = F.when(F.col("n_read") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document is not whole")).cast("long"))
    return whole.select("doc_id", "start", F.col("n_tokens").cast("long"), agrees.alias("ids_crc32"))


def read_ids(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start and the ids (array of int) of every document, rebuilt from its recipe."""
    check_manifest(spark, store)
    chunks = store.table(spark, "chunks")
    uses = store.table(spark, "recipes").select("doc_id", "start", "root", F.posexplode("recipe").alias("seq", "c")).select("doc_id", "start", "root", "seq", "c.chunk_id")
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "n_ids", "payload"))).alias("parts")
    whole = uses.join(chunks, "chunk_id", "left").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("root").alias("root"), parts)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts, root in zip(batch["parts"].to_pylist(), batch["root"].to_pylist(), strict=True):
                for p in parts:
                    if p["payload"] is None:
                        raise ValueError(f"chunk {p['chunk_id'].hex()} is missing")
                    if hashlib.blake2b(p["payload"], digest_size=DIGEST).digest() != p["chunk_id"]:
                        raise ValueError(f"chunk {p['chunk_id'].hex()} doesn't match its id")
                if merkle([p["chunk_id"] for p in parts]) != root:
                    raise ValueError("a recipe doesn't match its Merkle root")
                ids.append(np.concatenate([np.frombuffer(p["payload"], "<u4" if len(p["payload"]) == 4 * p["n_ids"] else "<u2").astype(np.int32) for p in parts]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return whole.select("doc_id", "start", "root", "parts").mapInArrow(joined, "doc_id long, start long, ids array<int>")


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return read_digests(spark, write_store(docs, new_path(spark, "store")))
