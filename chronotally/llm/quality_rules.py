"""Quality rules whose thresholds carry a guarantee on labelled holdouts.

Every document gets plain measures of its whole text. A rule is a measure, the direction that is bad, and a fixed ladder of cutoffs. The
labelled documents of a stratum (language) that pass the base rule are halved by a hash of the id. The first half designs: cutoffs that
reject ``PRECISION`` times as many bad as good documents are put in order of the good ones they reject, which makes a sequence of sets of rules,
each stricter than the one before. The second half, of which the design knows nothing, certifies: along that sequence, the exact
(Clopper-Pearson) upper bound of the share of good documents that all rules so far reject together must be at most ``ALPHA``, at
level ``DELTA`` divided by the number of strata; the first set that fails ends the sequence. Testing in a fixed order
that stops at the first failure needs no further correction inside a stratum, and Bonferroni's covers the strata. So with
probability 1 - DELTA, in every stratum all chosen rules together reject at most ALPHA of the good documents. A stratum with too few labels
gets no cutoff, so nothing is rejected there on no evidence.

Defined results: a null text has no words and fails the base rule. Null languages are one stratum. Null labels and labels of
unknown ids are ignored; several labels of an id count as their rounded mean; each row of a repeated id counts as a document.
Without labels only the base rule rejects. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import documents, stage
from .words import U64, by_size, encode_split, hash_strings, mix, plain, span_hash, split_words

ALPHA, DELTA, PRECISION = 0.05, 0.05, 4
#: Measures in which a high value is bad, and their ladders of cutoffs (reject above).
LADDERS = {
    "symbol_share": [0.01 * 1.35**k for k in range(12)],
    "repeat_share": [0.02 * 1.4**k for k in range(11)],
    "dup_line_share": [0.05 * 1.3**k for k in range(11)],
    "capital_share": [0.1 * 1.25**k for k in range(10)],
    "mark_share": [0.005 * 1.5**k for k in range(11)],
    "mean_word": [7.0 * 1.12**k for k in range(9)],
    "again_share": [0.05 * 1.35**k for k in range(10)],
}
#: Strata whose few numbers each are broadcast; more are joined by a shuffle.
BROADCAST_STRATA = 100_000
MEASURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_marks long, n_again long"
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_CAPITAL = np.isin(np.arange(256), list(range(65, 91)))
_MARK = np.isin(np.arange(256), list(b"!?"))


def _per_text(raw: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _earlier(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Is this (doc, code) met before?"""
    order = np.lexsort((code, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (code[order][1:] == code[order][:-1])
    out = np.zeros(len(doc), dtype=bool)
    out[order[1:]] = same
    return out


def measures(texts: pa.Array | pa.ChunkedArray) -> dict[str, np.ndarray]:
    texts = plain(texts)
    places = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]] if data is not None else np.empty(0, np.uint8)
    at = places - places[0]
    words = split_words(texts)
    n = len(texts)
    doc = words.doc_of_word()
    points = _per_text(raw, np.arange(256) & 0xC0 != 0x80, at) - _per_text(raw, _BLANK, at)
    # lines with a word that stood before in the same text
    lines = encode_split(pc.split_pattern(texts, "\n"), drop_empty=False)
    some = pc.match_substring_regex(lines.vocab, r"[^\x20\x09-\x0d]").to_numpy(zero_copy_only=False).astype(bool)[lines.codes]
    line_doc = lines.doc_of_word()[some]
    dup = _earlier(line_doc, lines.codes[some])
    # words in five-word windows that stand twice in the text
    values = hash_strings(words.vocab)[words.codes]
    size = len(values)
    covered = np.zeros(size, dtype=bool)
    if size >= 5:
        starts = np.flatnonzero(doc[: size - 4] == doc[4:])
        key = mix(span_hash(values, starts, starts + 5) ^ mix(doc[starts].astype(U64) + U64(1)))
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = starts[count[where] > 1]
        covered = np.cumsum(np.bincount(hit, minlength=size + 1) - np.bincount(hit + 5, minlength=size + 1))[:size] > 0
    again = np.concatenate([[False], (words.codes[1:] == words.codes[:-1]) & (doc[1:] == doc[:-1])]) if size else np.zeros(0, dtype=bool)
    return {
        "n_words": words.counts, "word_chars": points, "n_symbols": _per_text(raw, _SYMBOLS, at), "n_dup_lines": np.bincount(line_doc[dup], minlength=n), "n_repeat_words": np.bincount(doc[covered], minlength=n),
        "n_lines": np.bincount(line_doc, minlength=n), "n_capitals": _per_text(raw, _CAPITAL, at), "n_marks": _per_text(raw, _MARK, at), "n_again": np.bincount(doc[again], minlength=n),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_size(batch):
            found = measures(part["text"])
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), part["stratum"].combine_chunks(), *(pa.array(v.astype(np.int64)) for v in found.values())], names=["doc_id", "stratum", *found])


def measured(docs: DataFrame) -> DataFrame:
    """The measures of each document, and whether the base rule fails it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measure, MEASURES).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def shares(rows: DataFrame) -> DataFrame:
    some = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(
        "*",
        some("n_symbols", "word_chars").alias("symbol_share"), some("n_repeat_words", "n_words").alias("repeat_share"), some("n_dup_lines", "n_lines").alias("dup_line_share"),
        some("n_capitals", "word_chars").alias("capital_share"), some("n_marks", "word_chars").alias("mark_share"), some("word_chars", "n_words").alias("mean_word"), some("n_again", "n_words").alias("again_share"),
    )


def upper_bound(wrong: int, n: int, level: float) -> float:
    """Exact upper bound of a rate of which ``wrong`` of ``n`` were seen: the largest p with P(X <= wrong) >= level."""
    if wrong >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(wrong + 1)]
    low, high = wrong / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if sum(math.exp(c + k * math.log(p) + (n - k) * math.log1p(-p)) for k, c in enumerate(logs)) > level:
            low = p
        else:
            high = p
    return high


CUTS = "stratum string, " + ", ".join(f"cut_{rule} double" for rule in LADDERS)
_PATH = pa.list_(pa.struct([("rule", pa.int32()), ("cutoff", pa.float64())]))


def sequence(counts: dict) -> list[tuple[int, float]]:
    """The steps (rule, cutoff) of a stratum in the order in which they are certified. counts: n_good, g_ and b_ of each rule and cutoff."""
    steps = []
    for rule, (name, ladder) in enumerate(LADDERS.items()):
        for k, cutoff in enumerate(ladder):
            good, bad = counts[f"g_{name}_{k}"], counts[f"b_{name}_{k}"]
            if bad and bad >= PRECISION * good and good <= ALPHA * counts["n_good"]:
                steps.append((good, -bad, rule, cutoff))
    path, strictest = [], {}
    for _, _, rule, cutoff in sorted(steps):
        if cutoff < strictest.get(rule, float("inf")):
            strictest[rule] = cutoff
            path.append((rule, cutoff))
    return path


def certified(rejected: list[int], n: int, level: float) -> int:
    """How many steps pass in order; rejected: good documents that each step's set of rules rejects, of ``n``."""
    for k, wrong in enumerate(rejected):
        if wrong > ALPHA * n or upper_bound(wrong, n, level) > ALPHA:
            return k
    return len(rejected)


def thresholds(labelled: DataFrame) -> DataFrame:
    """One row for each stratum: its chosen cutoff of each rule (null: none). labelled: doc_id, shares, stratum, label."""
    good, bad = F.col("label") == 1, F.col("label") == 0
    labelled = labelled.withColumn("design", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    sums = [F.count_if(good & F.col("design")).alias("n_good"), F.count_if(good & ~F.col("design")).alias("n")]
    for rule, ladder in LADDERS.items():
        for k, cutoff in enumerate(ladder):
            over = F.col("design") & (F.col(rule) > cutoff)
            sums += [F.count_if(good & over).alias(f"g_{rule}_{k}"), F.count_if(bad & over).alias(f"b_{rule}_{k}")]
    counts = stage(labelled.groupBy("stratum").agg(*sums), "rule_counts")
    strata = max(1, counts.count())

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            paths = [[{"rule": rule, "cutoff": cutoff} for rule, cutoff in sequence(r)] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["stratum"] for r in rows], pa.string()), pa.array([r["n"] for r in rows], pa.int64()), pa.array(paths, _PATH)], names=["stratum", "n", "path"])

    paths = stage(counts.mapInArrow(design, "stratum string, n long, path array<struct<rule:int,cutoff:double>>"), "rule_paths")
    small = F.broadcast(paths) if strata <= BROADCAST_STRATA else paths
    values = F.array(*LADDERS)
    # the first step that rejects each certifying document: at most one count for each step
    hit = F.array_position(F.transform("path", lambda p: F.element_at(values, p["rule"] + 1) > p["cutoff"]), True)
    first = labelled.where(good & ~F.col("design")).join(small, "stratum").select("stratum", hit.alias("step")).where("step > 0").groupBy("stratum", "step").agg(F.count("*").alias("n_hit"))
    hits = first.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("step", "n_hit"))).alias("hits"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                seen = dict(r["hits"] or [])
                rejected = np.cumsum([seen.get(k + 1, 0) for k in range(len(r["path"]))], dtype=np.int64).tolist()
                chosen = {"stratum": r["stratum"]}
                for p in r["path"][: certified(rejected, r["n"], DELTA / strata)]:
                    name = f"cut_{list(LADDERS)[p['rule']]}"
                    chosen[name] = min(chosen.get(name, float("inf")), p["cutoff"])
                rows.append(chosen)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("stratum", pa.string()), *((f"cut_{rule}", pa.float64()) for rule in LADDERS)]))

    return paths.join(hits, "stratum", "left").mapInArrow(choose, CUTS)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The measures of each document with base_failed, the cutoffs of its stratum and kept."""
    rows = shares(stage(measured(docs), "measures"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("label"))
    cuts = stage(thresholds(rows.where("not base_failed").join(marks, "doc_id")), "rule_cuts")
    rejected = F.lit(False)
    for rule in LADDERS:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False))
    # one row for each language
    small = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    return rows.join(small, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
