"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are each word's letters (lower case) and its shape (runs of capitals, small letters, digits and
other characters), hashed to ``TERMS`` places, and runs of one repeated word by their length. From a bounded sample of labelled training rows (at most
``PER_CLASS`` of each label, chosen by a hash of the id) come the document frequencies, a truncated SVD of
the tf-idf matrix (``RANK`` directions) and the labelled vectors. These are broadcast; their size is fixed by
those parameters. Every document of the table is projected, its cosine to every labelled vector
is computed in blocks, and the ``NEIGHBOURS`` nearest vote with their label, weighted by similarity.

Only rows whose crc32(doc_id as text) mod 3 is not 1 are learnt from. Language, source and id are no inputs.

Defined results: a null text counts as empty. A text without terms, or a table without training labels, gets the
score 0.5 (predicted 1); with one class only, that class wins. Null labels and labels of unknown ids are ignored; several
labels of one id count as their mean, rounded. A null doc_id is never held out. Repeated rows are scored each; of several rows of a
labelled id the one whose text has the least hash is learnt from. Neighbours as near as the last one share the places that are left.
An empty table gives no rows; extra columns stay, but for held_out, score and predicted, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .shared import documents
from .words import U64, by_size, hash_strings, split_words

TERMS, RANK, PER_CLASS, NEIGHBOURS, SHARPNESS, BLOCK = 4096, 48, 1500, 25, 4.0, 128
SHAPES = 1024  # the first places hold shapes, the next eight runs of one word
REPEATS, RUN_WEIGHT = SHAPES, 4.0


def fold(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def term_counts(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of log-scaled term counts."""
    words = split_words(texts)
    vocab, n = words.vocab, len(words.offsets) - 1
    shape = vocab
    for pattern, sign in ((r"\p{Lu}{2,}", "B"), (r"\p{Lu}", "A"), (r"[\p{Ll}\p{Lo}]+", "a"), (r"[0-9]+", "9")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    letters = pc.replace_substring_regex(pc.utf8_lower(vocab), r"[^\p{L}]+", "")
    places = np.stack([hash_strings(shape) % U64(SHAPES), U64(SHAPES + 8) + hash_strings(letters, 1) % U64(TERMS - SHAPES - 8)]).astype(np.int64)
    row = words.doc_of_word() * TERMS
    counts = np.zeros(n * TERMS, dtype=np.float32)
    for kind in places:
        counts += np.bincount(row + kind[words.codes], minlength=n * TERMS).astype(np.float32)
    # a word that repeats the one before it counts again, as a term for the length of the run so far
    again = np.concatenate([[False], (words.codes[1:] == words.codes[:-1]) & (row[1:] == row[:-1])]) if len(row) else np.zeros(0, dtype=bool)
    at = np.arange(len(again))
    run = at - np.maximum.accumulate(np.where(again, 0, at)) if len(at) else at
    term = np.minimum(np.log2(np.maximum(run[again], 1)).astype(np.int64), 7)
    counts += RUN_WEIGHT * np.bincount(row[again] + REPEATS + term, minlength=n * TERMS).astype(np.float32)
    return np.log1p(counts).reshape(n, TERMS)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    directions: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # labelled rows x RANK, unit length
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        out = unit(counts * self.idf) @ self.directions
        return unit(out)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = np.maximum(self.project(counts) @ self.vectors.T, 0)
        n = near.shape[1]
        k = min(NEIGHBOURS, n)
        last = np.partition(near, n - k, axis=1)[:, n - k, None]  # similarity of the k-th neighbour
        closer = near > last
        # those as near as the k-th share the places that are left
        tied = near == last
        share = (k - closer.sum(axis=1)) / tied.sum(axis=1)
        weight = near.astype(np.float64) ** SHARPNESS
        votes = lambda w: (w * closer).sum(axis=1) + share * (w * tied).sum(axis=1)
        total = votes(weight)
        # no neighbour at all leaves the even prior
        return np.where(total > 0, votes(weight * self.labels) / np.where(total > 0, total, 1), 0.5)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """rows: packed (place uint16, value float16) pairs of each labelled document, and its label."""
    n = len(rows)
    counts = np.zeros((n, TERMS), dtype=np.float32)
    labels = np.array([y for _, y in rows], dtype=np.float64)
    for i, (raw, _) in enumerate(rows):
        pairs = np.frombuffer(raw, dtype=np.uint16).reshape(2, -1)
        counts[i, pairs[0]] = pairs[1].view(np.float16)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    tfidf = unit(counts * idf)
    rank = max(1, min(RANK, n, TERMS))
    basis = np.random.default_rng(0).standard_normal((TERMS, rank + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration for the leading right singular vectors
        basis = np.linalg.qr(tfidf.T @ (tfidf @ basis))[0] if n else basis
    _, _, right = np.linalg.svd(tfidf @ basis, full_matrices=False) if n else (0, 0, np.eye(rank + 8, dtype=np.float32))
    directions = (basis @ right[:rank].T).astype(np.float32)
    return Model(idf, directions, unit(tfidf @ directions) if n else np.zeros((0, rank), np.float32), labels)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_size(batch, most=1 << 20):
            for at in range(0, part.num_rows, BLOCK):
                block = part.slice(at, BLOCK)
                out = []
                for row in term_counts(block["text"]):
                    used = np.flatnonzero(row)
                    out.append(used.astype(np.uint16).tobytes() + row[used].astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), block["label"].combine_chunks()], names=["terms", "label"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most ``PER_CLASS`` training rows of each label."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(F.col("quality"))).cast("int").alias("label"))
    good = good.where(fold(F.col("doc_id"), 3) != 1)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    usable = good.join(known, "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("label") == label).orderBy(order).limit(PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 x PER_CLASS ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # of rows that share an id the one whose text has the least hash
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label")).select("text", "label")
    found = rows.mapInArrow(_features, "terms binary, label int").collect()  # bounded by PER_CLASS x TERMS
    return fit(sorted(((bytes(r.terms), r.label) for r in found), key=lambda r: (r[1], r[0])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with columns held_out, score and predicted added after its own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*names).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in by_size(batch, most=2 << 20):
                for at in range(0, part.num_rows, BLOCK):
                    block = part.slice(at, BLOCK)
                    found = model.scores(term_counts(block["text"]))
                    block = block.append_column("score", pa.array(found, pa.float64())).append_column("predicted", pa.array((found >= 0.5).astype(np.int32)))
                    yield from block.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in by_size(batch, most=2 << 20):
                good = [model.scores(term_counts(part.slice(at, BLOCK)["text"])) >= 0.5 for at in range(0, part.num_rows, BLOCK)]
                yield from part.filter(pa.array(np.concatenate(good))).combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).drop("text")
