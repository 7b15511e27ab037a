"""Language-model scores from a small causal self-attention model over subword ids.

A text's tokens are its words (A-Z made small) and one end. Every distinct word is cut into subword ids once. The model gives
P(word | words before) = P(class of its first subword | attention over the first subwords of the words before it)
x P(word | class), and the end is a class of its own. Inside a class, a word's share of the training tokens is mixed with the
chance of its subword ids, each given the class of the one before it, up to the word's close; so unseen words have a
proper probability too. All counts (words, first subwords, transitions) cover all training documents, and so do the attention weights,
trained here in numpy: the start is the best low-rank form of the counts of (subword, next class) over all training tokens, then every run
of about ``LOCAL`` windows goes on from there, one pass over all of its windows, and the runs' weights are averaged by their windows. Every
window of every whole training document takes part once; no task holds more than a run.

Scoring reads overlapping windows: each holds ``STRIDE`` tokens to score and the ``CONTEXT`` before the first of them, so each token is
scored once, in batches under a causal mask.

Distribution: texts are split once, in blocks of about ``BLOCK_BYTES`` as they are read. A block's documents become codes of its distinct
words, and these ask, by packed buckets of word hashes, for count, class and input, so a frequent word is one entry a block. Training and
scoring read the small integers that come back, never the texts.

Learning uses rows whose crc32(doc_id as text) mod 5 is not 1. Defined results: null texts count as empty (the end only); a null doc_id is
learnt from; repeated rows count each; without training rows every word has the subword chance alone (uniform); an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .quality_knn import fold
from .recompression import BLOCK_BYTES, bucket_of
from .shared import drop, shuffle_width, stage
from .subwords import Encoder, encoder, vocabulary_path
from .words import Words, by_size, hash_pairs, hash_strings, plain, ranges, split_words

VOCABULARY, IDS = "byte_bpe_50k.json", 50257
CLASSES, OWN_CLASSES, CHAIN_CLASSES, INPUTS = 192, 159, 128, 1024
END = CLASSES - 1
STRIDE, CONTEXT, WIDTH = 16, 15, 32
PAD, START = INPUTS + CLASSES, INPUTS + CLASSES + 1
LOCAL, BATCH, RATE, SUMMERS = 100_000, 96, 0.01, 32
SMOOTH, DOUBT = 0.1, 20.0


def small_words(texts: pa.Array | pa.ChunkedArray) -> Words:
    return split_words(pc.ascii_lower(plain(texts)))


# ---- counts -------------------------------------------------------------------------------------------------


def segment(tool: Encoder, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all words and the offsets of each."""
    ids, counts = tool._table(vocab, remember=False)
    return ids.astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def ladder(counts: np.ndarray, classes: int, own: int) -> np.ndarray:
    """Class of each id: the most frequent have their own, the rest are slices of equal mass by falling count."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    out = np.empty(len(counts), dtype=np.int64)
    out[order[:own]] = np.arange(own)
    rest = order[own:]
    mass = np.cumsum(counts[rest] + 1e-9)
    out[rest] = own + np.minimum((mass / mass[-1] * (classes - own)).astype(np.int64), classes - own - 1)
    return out


@dataclass(frozen=True)
class Chain:
    """How words are made of subword ids."""

    tokens: int  # N, ends included
    types: int  # V
    docs: int
    first_class: np.ndarray  # of each id as a word's first
    first_log: np.ndarray  # log P(first id | its class)
    class_tokens: np.ndarray
    class_types: np.ndarray
    input_id: np.ndarray  # what attention sees of a word that starts with this id
    chain_class: np.ndarray
    next_log: np.ndarray  # log P(next id or close | chain class)

    def words(self, tool: Encoder, vocab: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, attention input and log10 P(word | class) of each word."""
        return self.describe(*segment(tool, vocab), counts)

    def describe(self, ids: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of words given by their subword ids."""
        first = ids[at[:-1]]
        following = np.append(ids[1:], 0)
        following[at[1:] - 1] = IDS
        steps = np.concatenate([[0.0], np.cumsum(self.next_log[self.chain_class[ids], following].astype(np.float64))])
        kind = self.first_class[first]
        made = np.exp(self.first_log[first] + steps[at[1:]] - steps[at[:-1]])
        # what a class leaves to unseen words grows with the number of its distinct words
        tokens, types = self.class_tokens[kind], self.class_types[kind]
        share = np.where(tokens > 0, (counts + types * made) / np.maximum(tokens + types, 1), made)
        return kind, self.input_id[first], np.log10(np.maximum(share, 1e-300))


def _packed(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """``flat`` cut at ``offsets`` into binary values."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What ``_packed`` was given."""
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    sizes = pc.binary_length(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]) // flat.itemsize


def _chain_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, at = _unpacked(batch["ids"], "<u2")
        ids, n = ids.astype(np.int64), batch["n"].to_numpy().astype(np.float64)
        # kind 0: first ids; kind 4: words that start with them; kind 1: all ids; then pairs (id, next id or close)
        owner = np.repeat(n, np.diff(at))
        following = np.append(ids[1:], 0) if len(ids) else ids
        if len(at) > 1:
            following[at[1:] - 1] = IDS
        for kind, key, weight in ((0, ids[at[:-1]], n), (4, ids[at[:-1]], np.ones(len(n))), (1, ids * (IDS + 1) + following, owner)):
            used, where = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind), pa.int32()), pa.array(used), pa.array(np.bincount(where, weights=weight, minlength=len(used)).astype(np.int64))], names=["kind", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([2, 3], pa.int32()), pa.array([0, 0], pa.int64()), pa.array([int(n.sum()), len(n)], pa.int64())], names=["kind", "key", "n"])


def learn_chain(words: DataFrame, docs: int) -> Chain:
    """words: n and subword ids of each, over all training documents."""
    counted = stage(words.select("n", "ids").mapInArrow(_chain_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "chain")
    pick = lambda df: df.toArrow()
    firsts = pick(counted.where("kind = 0"))  # at most IDS rows
    first = np.zeros(IDS)
    first[firsts["key"].to_numpy()] = firsts["n"].to_numpy()
    kinds = ladder(first, CLASSES - 1, OWN_CLASSES)
    starts = pick(counted.where("kind = 4"))  # at most IDS rows
    types = np.bincount(kinds[starts["key"].to_numpy()], weights=starts["n"].to_numpy(), minlength=CLASSES)
    pairs = counted.where("kind = 1")
    each = pick(pairs.groupBy(F.floor(F.col("key") / (IDS + 1)).alias("id")).agg(F.sum("n").alias("n")))  # at most IDS rows
    total = np.zeros(IDS)
    total[each["id"].to_numpy()] = each["n"].to_numpy()
    chain_class = ladder(total, CHAIN_CLASSES, CHAIN_CLASSES * 3 // 4)
    # pairs by the class of the first id: at most CHAIN_CLASSES x (IDS + 1) rows
    spark = words.sparkSession
    classes = spark.sparkContext.broadcast(chain_class)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classes.value
        for batch in batches:
            key = batch["key"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(own[key // (IDS + 1)] * (IDS + 1) + key % (IDS + 1)), batch["n"]], names=["key", "n"])

    table = pick(pairs.select("key", "n").mapInArrow(by_class, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    follow = np.zeros(CHAIN_CLASSES * (IDS + 1), dtype=np.float32)
    follow[table["key"].to_numpy()] = table["n"].to_numpy()
    follow = follow.reshape(CHAIN_CLASSES, IDS + 1)
    rest = follow.sum(axis=0) + 1e-3
    rest /= rest.sum()
    strength = 5.0 + 0.5 * (follow > 0).sum(axis=1, keepdims=True)
    next_log = np.log((follow + strength * rest) / (follow.sum(axis=1, keepdims=True) + strength)).astype(np.float32)
    del follow
    sums = {r.kind: r.n for r in counted.where("kind in (2, 3)").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    by_kind = np.bincount(kinds, weights=first + SMOOTH, minlength=CLASSES)
    first_log = np.log((first + SMOOTH) / by_kind[kinds])
    rank = np.empty(IDS, dtype=np.int64)
    rank[np.lexsort((np.arange(IDS), -first))] = np.arange(IDS)
    inputs = np.where(rank < INPUTS, rank, INPUTS + kinds)
    n_words = int(sums.get(2, 0))
    return Chain(n_words + docs, int(sums.get(3, 0)) + (docs > 0), docs, kinds, first_log, np.bincount(kinds, weights=first, minlength=CLASSES), types, inputs, chain_class, next_log)


# ---- attention ----------------------------------------------------------------------------------------------


def windows(inputs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows of attention inputs of all texts, and for each window's scored places the target (-1: none).

    A text of n words has n + 1 targets, its words and its end; a target's query is the input before it.
    """
    counts = np.diff(offsets)
    per_text = -(-(counts + 1) // STRIDE)
    before = np.cumsum(per_text) - per_text
    # a text's stream: CONTEXT times nothing, the start, its words, and nothing up to the end of its last window
    begins = before * STRIDE + CONTEXT * np.arange(len(counts))
    stream = np.full(int(per_text.sum()) * STRIDE + CONTEXT * len(counts), PAD, dtype=np.int64)
    stream[begins + CONTEXT] = START
    stream[np.arange(offsets[-1]) + np.repeat(begins + CONTEXT + 1 - offsets[:-1], counts)] = inputs
    first = np.repeat(begins, per_text) + STRIDE * ranges(per_text)
    # targets of all texts stand one after another
    target = np.full(int(per_text.sum()) * STRIDE, -1, dtype=np.int64)
    own = np.arange(offsets[-1] + len(counts))
    target[own + np.repeat(before * STRIDE - offsets[:-1] - np.arange(len(counts)), counts + 1)] = own
    return stream[first[:, None] + np.arange(CONTEXT + STRIDE)], target.reshape(-1, STRIDE)


@dataclass
class Attention:
    embed: np.ndarray
    place: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[str]:
        return ["embed", "place", "query", "key", "value", "out", "bias"]

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self.parameters()])

    def with_flat(self, weights: np.ndarray) -> "Attention":
        own = [getattr(self, p) for p in self.parameters()]
        cuts = np.split(weights, np.cumsum([x.size for x in own])[:-1])
        return Attention(*(w.reshape(x.shape).astype(np.float32, copy=False) for w, x in zip(cuts, own, strict=True)))

    def hidden(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """What stands before the classes at each scored place, with a 1 for the bias; rows: windows x (CONTEXT + STRIDE)."""
        x = self.embed.take(rows, axis=0)
        x += self.place
        asks = x[:, CONTEXT:]
        q, k, v = asks @ (self.query * np.float32(WIDTH**-0.5)), x @ self.key, x @ self.value
        a = _exp(q @ k.transpose(0, 2, 1))
        a *= _SEEN
        a *= (rows != PAD).astype(np.float32)[:, None, :]
        total = a.reshape(-1, CONTEXT + STRIDE) @ _SUM
        a *= (1 / np.maximum(total, np.float32(1e-30))).reshape(len(rows), STRIDE, 1)
        mixed = a @ v
        h = np.ones((len(rows), STRIDE, WIDTH + 1), dtype=np.float32)
        np.add(mixed, asks, out=h[:, :, :WIDTH])
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "mixed": mixed, "h": h.reshape(-1, WIDTH + 1)}

    def logits(self, h: np.ndarray) -> np.ndarray:
        """Places x classes; no place's are all far from 0. The next call writes over them."""
        z = _ROOM[: len(h)] if len(h) <= len(_ROOM) else np.empty((len(h), CLASSES), dtype=np.float32)
        np.matmul(_stacks(h), np.vstack([self.out, self.bias]), out=_stacks(z))
        return _near(z)

    def forward(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Log chances of the next class after each scored place; rows: windows x (CONTEXT + STRIDE)."""
        f = self.hidden(rows)
        z = self.logits(f["h"])
        z = z - np.log(np.exp(z) @ _ONES)[:, None]
        return f | {"z": z.reshape(len(rows), STRIDE, CLASSES)}


def _stacks(x: np.ndarray) -> np.ndarray:
    """STRIDE matrices of the rows of ``x`` in turn: the library is faster on small ones."""
    return x.reshape(STRIDE, len(x) // STRIDE, x.shape[1])


def _near(z: np.ndarray) -> np.ndarray:
    """Moved row by row below 0 where exp could leave the range of numbers."""
    if z.size and max(z.max(), -z.min()) > 60:
        z -= z.max(axis=-1, keepdims=True)
    return z


def _exp(z: np.ndarray) -> np.ndarray:
    z = _near(z)
    return np.exp(z, out=z)


_SEEN = (np.arange(CONTEXT + STRIDE)[None, :] <= CONTEXT + np.arange(STRIDE)[:, None]).astype(np.float32)
_ONES, _SUM = np.ones(CLASSES, dtype=np.float32), np.ones(CONTEXT + STRIDE, dtype=np.float32)
_ROOM = np.empty((128 * STRIDE, CLASSES), dtype=np.float32)


def new_attention(prior: np.ndarray) -> Attention:
    rng = np.random.default_rng(0)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return Attention(draw(START + 1, WIDTH), draw(CONTEXT + STRIDE, WIDTH), draw(WIDTH, WIDTH), draw(WIDTH, WIDTH), draw(WIDTH, WIDTH), draw(WIDTH, CLASSES), np.log(prior).astype(np.float32))


def gradients(model: Attention, row: np.ndarray, want: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy of the next class. want: windows x STRIDE, -1 where there is no target."""
    f = model.hidden(row)
    h, x = f["h"], f["x"].transpose(0, 2, 1)
    goal = want.ravel()
    here = goal >= 0
    e = model.logits(h)
    np.exp(e, out=e)
    total = e @ _ONES
    at = np.flatnonzero(here)
    e[at, goal[at]] -= total[at]
    share = (here / (total * np.float32(max(len(at), 1)))).astype(np.float32)[:, None]
    dh = np.matmul(_stacks(e), model.out.T.copy()).reshape(-1, WIDTH)
    dh *= share
    dout = (_stacks(h * share).transpose(0, 2, 1) @ _stacks(e)).sum(axis=0)
    dh = dh.reshape(f["mixed"].shape)
    da = dh @ f["v"].transpose(0, 2, 1)
    da -= np.einsum("wij,wij->wi", dh, f["mixed"])[:, :, None]
    da *= f["a"]
    dq = da @ f["k"]
    dq *= np.float32(WIDTH**-0.5)
    # q is scaled already
    dk, dv = da.transpose(0, 2, 1) @ f["q"], f["a"].transpose(0, 2, 1) @ dh
    dx = dk @ model.key.T.copy()
    dx += dv @ model.value.T.copy()
    dh += dq @ model.query.T.copy()
    dx[:, CONTEXT:] += dh
    embed = np.zeros_like(model.embed)
    ids = row.ravel().astype(np.int16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    embed[ids[heads]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, axis=0), heads, axis=0)
    return {"embed": embed, "place": dx.sum(axis=0), "query": (x[:, :, CONTEXT:] @ dq).sum(axis=0), "key": (x @ dk).sum(axis=0), "value": (x @ dv).sum(axis=0), "out": dout[:-1], "bias": dout[-1]}


def train(model: Attention, rows: np.ndarray, wanted: np.ndarray, picks: list[np.ndarray], rate: float) -> Attention:
    """Adam, one step for each pick of windows, the rate falling to a tenth."""
    weights = model.flat().astype(np.float32)
    first, second, room = np.zeros_like(weights), np.zeros_like(weights), np.empty_like(weights)
    for step, pick in enumerate(picks, 1):
        grads = gradients(model.with_flat(weights), rows[pick], wanted[pick])
        g = np.concatenate([grads[p].ravel() for p in model.parameters()])
        own = rate * min(1.0, step / 20) * (1 - 0.9 * step / len(picks))
        first += np.multiply(np.subtract(g, first, out=room), np.float32(0.1), out=room)
        g *= g
        second += np.multiply(np.subtract(g, second, out=room), np.float32(0.01), out=room)
        np.sqrt(np.multiply(second, np.float32(1 / (1 - 0.99**step)), out=room), out=room)
        room += np.float32(1e-8)
        np.divide(first, room, out=room)
        room *= np.float32(own / (1 - 0.9**step))
        weights -= room
    return model.with_flat(weights)


def start(pairs: np.ndarray, prior: np.ndarray) -> Attention:
    """A new model whose subwords and classes are the best forms of ``WIDTH`` dimensions of what each subword tells of the next class.

    pairs: inputs x classes, counts of all training tokens.
    """
    model = new_attention(prior)
    each = pairs.sum(axis=1, keepdims=True)
    tells = np.log((pairs + DOUBT * prior) / (each + DOUBT)) - np.log(prior)
    weight, likely = np.sqrt(each + 1), np.sqrt(prior)
    left, size, right = np.linalg.svd(weight * tells * likely, full_matrices=False)
    size = np.sqrt(size[:WIDTH])
    embed, out = left[:, :WIDTH] * size / weight, size[:, None] * right[:WIDTH] / likely
    # a token's numbers are as large as a class's, on average over the corpus
    large = lambda x, by: np.sqrt(np.average((x**2).sum(axis=1), weights=by))
    scale = np.sqrt(max(large(out.T, prior), 1e-9) / max(large(embed, each[:, 0] + 1e-9), 1e-9))
    small = Attention(*(getattr(model, p) * np.float32(0.1) for p in model.parameters()))
    return Attention((small.embed + embed * scale).astype(np.float32), small.place, model.query, model.key, small.value, (small.out + out / scale).astype(np.float32), model.bias)


def _texts(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and classes of all words of all coded documents, one after another, and the offsets of each document."""
    kinds, offsets = _unpacked(batch["kinds"], "u1")
    return _unpacked(batch["inputs"], "<u2")[0].astype(np.int64), kinds.astype(np.int64), offsets


def with_ends(kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of every target: each text's words, then its end."""
    return np.insert(kinds, offsets[1:], END)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (input, next class) over all targets."""
    total, n = np.zeros((START + 1) * CLASSES), 0
    for batch in batches:
        for part in by_size(batch, "inputs"):
            inputs, kinds, offsets = _texts(part)
            seen = np.insert(inputs, offsets[:-1], START)
            total += np.bincount(seen * CLASSES + with_ends(kinds, offsets), minlength=len(total))
            n += len(seen)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of all coded documents and their classes, in runs of about LOCAL windows, at least half of it where there are that many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for part in by_size(batch, "inputs", most=LOCAL * STRIDE):
            inputs, kinds, offsets = _texts(part)
            rows, target = windows(inputs, offsets)
            wanted = np.append(with_ends(kinds, offsets), -1)[target]
            # a long text's windows, too, go on in runs
            for at in range(0, len(rows), LOCAL):
                held.append((rows[at : at + LOCAL].astype(np.int16), wanted[at : at + LOCAL].astype(np.int16)))
                size += len(held[-1][0])
                if size >= 3 * LOCAL // 2:
                    rest = size - LOCAL
                    together = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield together[0][:LOCAL], together[1][:LOCAL]
                    held, size = [(together[0][LOCAL:], together[1][LOCAL:])], rest
    if size:
        together = [np.concatenate(x) for x in zip(*held, strict=True)]
        yield together[0], together[1]


def _refine(shared_model):
    """The weights after one pass over each run's windows, times their number; summed over the runs of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for rows, wanted in _runs(batches):
            order = np.random.default_rng(2).permutation(len(rows))
            model = train(shared_model.value, rows, wanted, [order[k : k + BATCH] for k in range(0, len(order), BATCH)], RATE)
            n, total = n + len(rows), total + model.flat().astype(np.float64) * len(rows)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for k, raw in zip(batch["n"].to_pylist(), batch["weights"].to_pylist(), strict=True):
            own = np.frombuffer(raw, np.float64)
            n, total = n + k, own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"])


def _total(parts: DataFrame, name: str) -> tuple[int, np.ndarray | None]:
    """Sum of the tasks' rows (n, weights): by streaming, one row a task, then over those, so that one comes to the driver."""
    shape = "n long, weights binary"
    sums = stage(parts, name).repartition(SUMMERS).mapInArrow(_summed, shape).repartition(1).mapInArrow(_summed, shape).toArrow()
    return (sums["n"][0].as_py(), np.frombuffer(sums["weights"][0].as_py(), np.float64)) if len(sums) else (0, None)


def learn_attention(coded: DataFrame, prior: np.ndarray) -> Attention:
    """The attention weights, from all windows of all training documents. coded: inputs, kinds of each."""
    spark, shape = coded.sparkSession, "n long, weights binary"
    n, pairs = _total(coded.mapInArrow(_pairs, shape), "pairs")
    if not n:
        return new_attention(prior)
    model = start(pairs.reshape(START + 1, CLASSES), prior)
    shared = spark.sparkContext.broadcast(model)
    # dealt anew, so that a run doesn't hold neighbours of the input alone
    parts = max(1, min(n // (LOCAL * STRIDE), max(shuffle_width(spark), n // (32 * LOCAL * STRIDE))))
    n, total = _total(coded.repartition(parts, F.xxhash64("inputs", F.rand(3))).mapInArrow(_refine(shared), shape), "weights")
    return model.with_flat(total / n)


def class_logs(model: Attention, inputs: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 P(class | before) of every word and end of all texts, one after another. kinds: class of each word."""
    want = with_ends(kinds, offsets)
    out = np.zeros(len(want))
    rows, target = windows(inputs, offsets)
    for at in range(0, len(rows), 128):
        z = model.logits(model.hidden(rows[at : at + 128])["h"])
        where = target[at : at + 128].ravel()
        here = np.flatnonzero(where >= 0)
        place = where[here]
        own = z[here, want[place]]
        out[place] = own - np.log(np.exp(z, out=z) @ _ONES)[here]
    return out / np.log(10)


# ---- scoring ------------------------------------------------------------------------------------------------


def _order(vocab: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the distinct words that doesn't follow the order of the texts, and the bounds of the buckets."""
    a, b = hash_pairs(vocab).T.copy()
    order = np.lexsort((b, a))
    return order, np.searchsorted(bucket_of(a[order], buckets), np.arange(buckets + 1))


SPLIT = "blk long, bucket long, words string, n binary, doc_id long, held_out boolean, codes binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows together up to about BLOCK_BYTES of text, one row at least."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        for part in by_size(batch, most=BLOCK_BYTES):
            own = pc.sum(pc.binary_length(part["text"])).as_py() or 0
            if held and size + own > BLOCK_BYTES:
                yield pa.concat_tables(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.concat_tables(held)


def _split(buckets: int):
    """Of each block of documents: its distinct words by bucket with their training counts; and each document as codes of these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [x.split(" ")[0] for x in SPLIT.split(", ")]
        for number, table in enumerate(_blocks(batches)):
            blk = (part << 32) + number
            words = small_words(table["text"])
            order, bounds = _order(words.vocab, buckets)
            sorted_words = words.vocab.cast(pa.string()).take(pa.array(order))
            learnt = ~table["held_out"].to_numpy().astype(bool)
            n = np.bincount(words.codes[np.repeat(learnt, words.counts)], minlength=len(words.vocab))[order].astype("<u4")
            used = np.flatnonzero(np.diff(bounds))
            k = len(used)
            # no word has a space, so a bucket's words are one string
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(bounds[used], bounds[-1]).astype(np.int32)), sorted_words), " ") if k else pa.array([], pa.string())
            packed = _packed(n, np.append(bounds[used], bounds[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, blk), pa.int64()), pa.array(used, pa.int64()), joined, packed, pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary())], names=names)
            place = np.empty(len(order), dtype="<u4" if len(order) > 1 << 16 else "<u2")
            place[order] = np.arange(len(order))
            codes = place[words.codes]
            d = table.num_rows
            one = lambda name: table[name].combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, blk), pa.int64()), pa.nulls(d, pa.int64()), pa.nulls(d, pa.string()), pa.nulls(d, pa.binary()), one("doc_id"), one("held_out"), _packed(codes, words.offsets)], names=names)

    return run


def _asked_words(column: pa.ChunkedArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all rows of ``_split``, and the offsets of each row."""
    lists = pc.split_pattern(column.combine_chunks(), " ")
    return lists.flatten().dictionary_encode(), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)).astype(np.int64))])


def _word_counts(path: str):
    """A bucket's words with their training counts and subword ids, as 16-bit integers: each word of the corpus is cut once."""

    def run(table: pa.Table) -> pa.Table:
        words, _ = _asked_words(table["words"])
        n = np.bincount(words.indices.to_numpy(zero_copy_only=False), weights=_unpacked(table["n"], "<u4")[0], minlength=len(words.dictionary)).astype(np.int64)
        learnt = np.flatnonzero(n)
        vocab = words.dictionary.take(pa.array(learnt))
        parts = [segment(encoder(path, spaces=True), vocab[at : at + 20_000].cast(pa.large_string())) for at in range(0, len(vocab), 20_000)]
        ids = np.concatenate([p[0] for p in parts] or [np.zeros(0)]).astype("<u2")
        sizes = np.concatenate([np.diff(p[1]) for p in parts] or [np.zeros(0, np.int64)])
        return pa.table({"word": vocab, "n": pa.array(n[learnt]), "ids": _packed(ids, np.concatenate([[0], np.cumsum(sizes)]))})

    return run


def _answer(asked: pa.Table, known: pa.Table, describe) -> pa.Table:
    """For each row of asked words: count, class, input and log share of each, packed. describe: of words that no training text has."""
    distinct, offsets = _asked_words(asked["words"])
    found = pc.index_in(distinct.dictionary, value_set=known["word"].combine_chunks())
    new = pc.is_null(found).to_numpy(zero_copy_only=False)
    at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    made = dict(zip(("kind", "input", "share"), describe(distinct.dictionary.filter(pa.array(new)).cast(pa.large_string())), strict=True)) if new.any() else {}
    codes = distinct.indices.to_numpy(zero_copy_only=False)

    def packed(name: str, kind: str) -> pa.Array:
        own = known[name].to_numpy()[at].astype(kind) if len(known) else np.zeros(len(at), kind)
        own[new] = made[name].astype(kind) if name in made else 0
        return _packed(own[codes], offsets)

    return pa.table({"blk": asked["blk"], "bucket": asked["bucket"], "n": packed("n", "<i8"), "kind": packed("kind", "u1"), "input": packed("input", "<u2"), "share": packed("share", "<f4")})


ANSWER = "blk long, bucket long, n binary, kind binary, input binary, share binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, share double, inputs binary, kinds binary"


@dataclass(frozen=True)
class Fitted:
    counts: DataFrame  # word, n, ids: of all training tokens but the ends
    chain: Chain
    attention: Attention


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", fold(F.col("doc_id"), 5) == 1)


def _per_text(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[offsets[1:]] - total[offsets[:-1]]


def split(rows: DataFrame) -> tuple[DataFrame, int]:
    """All documents in blocks of codes with what each block asks, and the number of buckets of words."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(rows.sparkSession), size // (64 << 20))
    return stage(rows.mapInArrow(_split(buckets), SPLIT), "split"), buckets


def code(parts: DataFrame, buckets: int, counts: DataFrame, chain: Chain) -> DataFrame:
    """Each document with its counts, its base score, its words' shares of their classes, and its words' inputs and classes."""
    spark, path = parts.sparkSession, vocabulary_path(VOCABULARY)
    shared_chain = spark.sparkContext.broadcast(chain)
    tokens, n_docs = chain.tokens, chain.docs
    base_low = np.log10(tokens + 0.5 * (chain.types + 1))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_chain.value
        for batch in batches:
            ids, at = _unpacked(batch["ids"], "<u2")
            kind, inputs, share = own.describe(ids.astype(np.int64), at, batch["n"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(kind.astype(np.int32)), pa.array(inputs.astype(np.int32)), pa.array(share), pa.array(bucket_of(hash_strings(batch["word"], 0), buckets))], names=["word", "n", "kind", "input", "share", "bucket"])

    def describe_new(asked: pa.Table, known: pa.Table) -> pa.Table:
        return _answer(asked, known, lambda new: shared_chain.value.words(encoder(path, spaces=True), new, np.zeros(len(new))))

    def result(table: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        column = lambda name, kind: np.frombuffer(b"".join(answers[name].to_pylist()), kind)
        n, kind, inputs, share = column("n", "<i8"), column("kind", "u1"), column("input", "<u2"), column("share", "<f4")
        wide = "<u4" if len(n) > 1 << 16 else "<u2"
        codes, offsets = _unpacked(table["codes"], wide)
        sizes = np.diff(offsets)
        base = _per_text(np.log10(n + 0.5)[codes], offsets) + np.log10(n_docs + 0.5) - (sizes + 1) * base_low
        known = _per_text((n > 0)[codes].astype(np.float64), offsets) + (n_docs > 0)
        return pa.table({
            "doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": pa.array(sizes + 1), "n_known": pa.array(known.round().astype(np.int64)), "train_tokens": pa.array(np.full(len(sizes), tokens)),
            "base_score": pa.array(base), "share": pa.array(_per_text(share.astype(np.float64)[codes], offsets)), "inputs": _packed(inputs[codes], offsets), "kinds": _packed(kind[codes], offsets),
        })

    known = counts.mapInArrow(describe, "word string, n long, kind int, input int, share double, bucket long")
    asked = parts.where("bucket is not null").select("blk", "bucket", "words")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(describe_new, ANSWER)
    documents = parts.where("bucket is null").select("blk", "doc_id", "held_out", "codes")
    return stage(documents.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(result, CODED), "coded")


def _learnt(docs: DataFrame) -> tuple[Fitted, DataFrame]:
    """The model of the rows of ``docs`` that are not held out, and all rows coded."""
    parts, buckets = split(_rows(docs))
    n_docs = parts.where("bucket is null and not held_out").count()
    counts = stage(parts.where("bucket is not null").select("bucket", "words", "n").groupBy("bucket").applyInArrow(_word_counts(vocabulary_path(VOCABULARY)), "word string, n long, ids binary"), "words")
    chain = learn_chain(counts, n_docs)
    coded = code(parts, buckets, counts, chain)
    drop(parts)
    # shuffle files of what is staged by now go when the driver's JVM collects; training deals the coded documents again
    docs.sparkSession.sparkContext._jvm.System.gc()
    prior = np.append(chain.class_tokens[:-1], n_docs) + 1.0
    return Fitted(counts, chain, learn_attention(coded.where("not held_out").select("inputs", "kinds"), prior / prior.sum())), coded


def learn(docs: DataFrame) -> Fitted:
    """The model of the rows of ``docs`` that are not held out."""
    return _learnt(docs)[0]


def score(docs: DataFrame, fitted: Fitted | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document of ``docs``."""
    if fitted is None:
        fitted, coded = _learnt(docs)
    else:
        coded = code(*split(_rows(docs)), fitted.counts, fitted.chain)
    shared_model = docs.sparkSession.sparkContext.broadcast(fitted.attention)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "inputs", most=1 << 20):
                inputs, kinds, offsets = _texts(part)
                logs = class_logs(shared_model.value, inputs, kinds, offsets)
                whole = pc.add(part["share"], pa.array(_per_text(logs, offsets + np.arange(len(offsets)))))
                yield from part.drop_columns(["share", "inputs", "kinds"]).append_column("score", whole).to_batches()

    return coded.mapInArrow(run, SCORED)


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score(docs)
