"""Trained operators: held-out accuracy, guarantees, planted cases, awkward tables; and the pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotally.llm import decontaminate, quality_knn, quality_rules
from chronotally.llm.components import components

from .conftest import make, prose


def junk(rng, n):
    return " ".join(rng.choice([w.upper() + "!!", w + "$$$", "| " + w]) for w in prose(rng, n).split())


@pytest.fixture(scope="module")
def labelled(spark, awkward):
    rng = random.Random(4)
    pairs = [(1000 + k, prose(rng, rng.randint(20, 120)) if k % 3 else junk(rng, rng.randint(20, 120))) for k in range(450)]
    docs = make(spark, pairs + awkward)
    labels = spark.createDataFrame([(i, int((i - 1000) % 3 > 0), 0) for i, _ in pairs] + [(1000, 0, 1), (None, 1, 0), (1001, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_classifier(spark, labelled):
    docs, labels = labelled
    rows = quality_knn.score(docs.select("doc_id", "text"), quality_knn.learn(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and (r.doc_id or 0) >= 1000 and r.doc_id < 2000]
    assert len(held) > 50 and np.mean([r.predicted == int((r.doc_id - 1000) % 3 > 0) for r in held]) > 0.95
    assert all(r.score == 0.5 for r in rows if not (r.text or "").strip() and r.text is not None and r.text == "")
    kept = quality_knn.keep_good(docs, quality_knn.learn(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_classifier_without_labels(spark, labelled):
    docs, labels = labelled
    model = quality_knn.learn(docs, labels.limit(0))
    assert {r.score for r in quality_knn.score(docs.select("doc_id", "text"), model).collect()} == {0.5}
    assert quality_knn.score(docs.limit(0), model).count() == 0


def test_rules_keep_good_documents(spark, labelled):
    docs, labels = labelled
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    good = [r for r in rows if r.doc_id and 1000 <= r.doc_id < 2000 and (r.doc_id - 1000) % 3]
    assert np.mean([r.kept for r in good if not r.base_failed]) > 0.97
    assert all(not r.kept for r in rows if r.base_failed)
    assert all(r.kept == (not r.base_failed) for r in quality_rules.judge(docs, labels.limit(0)).collect())
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_rules_against_a_plain_loop(spark, monkeypatch):
    """Cutoffs and verdicts equal those of a loop over all documents, on a table where some cutoffs are certified and some are not."""
    rng = random.Random(21)
    pairs = [(k, prose(rng, rng.randint(15, 60)) if k % 4 else junk(rng, rng.randint(15, 60))) for k in range(1200)]
    pairs += [(k, prose(rng, 30) + " $$$$ ||||") for k in range(1200, 1230)]
    docs = make(spark, pairs)
    labels = spark.createDataFrame([(k, int(k % 4 > 0) if k < 1200 else 1) for k, _ in pairs], "doc_id long, quality int")
    rows = [r.asDict() for r in quality_rules.shares(quality_rules.measured(docs)).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2))).collect()]
    label = {k: int(k % 4 > 0) if k < 1200 else 1 for k, _ in pairs}
    strata = {r["stratum"] for r in rows}
    want = {}
    for stratum in strata:
        own = [r for r in rows if r["stratum"] == stratum and not r["base_failed"]]
        first, second = [r for r in own if r["half"] == 0], [r for r in own if r["half"] == 1 and label[r["doc_id"]] == 1]
        n = sum(label[r["doc_id"]] for r in first)
        steps = []
        for number, (rule, ladder) in enumerate(quality_rules.LADDERS.items()):
            for cutoff in ladder:
                good = sum(r[rule] > cutoff and label[r["doc_id"]] == 1 for r in first)
                bad = sum(r[rule] > cutoff and label[r["doc_id"]] == 0 for r in first)
                if bad and bad >= 4 * good and good <= 0.05 * n:
                    steps.append((good, -bad, number, cutoff, rule))
        cuts = {}
        for _, _, _, cutoff, rule in sorted(steps):
            trial = cuts | {rule: min(cutoff, cuts.get(rule, 1e9))}
            wrong = sum(any(r[x] > c for x, c in trial.items()) for r in second)
            # the chance of so few rejections, were the rate 5 %, must be at most the level
            if not second or sum(math.comb(len(second), k) * 0.05**k * 0.95 ** (len(second) - k) for k in range(wrong + 1)) > 0.05 / len(strata):
                break
            cuts = trial
        want |= {r["doc_id"]: not r["base_failed"] and not any(r[x] > c for x, c in cuts.items()) for r in rows if r["stratum"] == stratum}
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert got == want
    base = {r["doc_id"]: not r["base_failed"] for r in rows}
    assert got != base  # some cutoff was certified
    good = [k for k in label if label[k] == 1 and base[k]]
    assert sum(not got[k] for k in good) <= 0.05 * len(good)


def test_classifier_against_plain_loops(spark, labelled):
    """Every document's score from plain cosines to all labelled vectors, ties at the last place shared."""
    docs, labels = labelled
    model = quality_knn.learn(docs, labels)
    rows = quality_knn.score(docs.select("doc_id", "text"), model).collect()
    import pyarrow as pa

    for r in rows[::7]:
        vector = quality_knn.term_counts(pa.array([r.text], pa.string()))[0] * model.idf
        vector = vector / (np.sqrt((vector**2).sum()) or 1) @ model.directions
        vector = vector / (np.sqrt((vector**2).sum()) or 1)
        near = sorted(((max(float(sum(a * b for a, b in zip(vector.tolist(), v, strict=True))), 0.0), y) for v, y in zip(model.vectors.tolist(), model.labels.tolist(), strict=True)), reverse=True)
        last = near[quality_knn.NEIGHBOURS - 1][0]
        closer, tied = [x for x in near if x[0] > last + 1e-6], [x for x in near if abs(x[0] - last) <= 1e-6]
        share = (quality_knn.NEIGHBOURS - len(closer)) / len(tied)
        total = sum(s**4 for s, _ in closer) + share * sum(s**4 for s, _ in tied)
        want = (sum(s**4 * y for s, y in closer) + share * sum(s**4 * y for s, y in tied)) / total if total else 0.5
        assert abs(r.score - want) < 1e-3


def test_ties_share_the_last_places():
    vectors = np.tile(np.array([[1.0, 0.0]], np.float32), (60, 1))
    model = quality_knn.Model(np.ones(quality_knn.TERMS, np.float32), np.eye(quality_knn.TERMS, 2, dtype=np.float32), vectors, np.array([1.0] * 15 + [0.0] * 45))
    counts = np.zeros((1, quality_knn.TERMS), np.float32)
    counts[0, 0] = 1
    assert abs(model.scores(counts)[0] - 0.25) < 1e-9


@pytest.mark.parametrize("wrong,n,level", [(0, 10, 0.05), (3, 50, 0.01), (10, 10, 0.05), (1, 1000, 1e-4)])
def test_upper_bound_is_exact(wrong, n, level):
    from math import comb

    p = quality_rules.upper_bound(wrong, n, level)
    if wrong >= n:
        assert p == 1
    else:
        assert abs(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(wrong + 1)) - level) < 1e-6


@pytest.fixture(scope="module")
def leaky(spark, awkward):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(25, 45))) for k in range(12)] + [(50, None), (51, ""), (None, prose(rng, 30)), (0, None)]
    clean = [(2000 + k, prose(rng, rng.randint(5, 200))) for k in range(60)]
    planted = []
    for k in range(12):
        words = items[k][1].split(" ")
        edited = [w if j % 6 else "other" for j, w in enumerate(words)]
        dropped = [w for j, w in enumerate(words) if j % 7 != 3]
        for n, copy in enumerate((words, [w.upper() for w in words], edited, dropped)):
            planted.append((3000 + 10 * k + n, f"{prose(rng, 30)} {' '.join(copy)} {prose(rng, 30)}"))
    docs = make(spark, clean + planted + awkward)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return docs, bench


def test_leaks(spark, leaky):
    docs, bench = leaky
    rows = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(3000 + 10 * k + n, k) for k in range(12) for n in range(4)}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 48
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_against_whole_alignments(spark, leaky):
    """(doc, item) pairs equal those of aligning every item with every whole text; so does each best score."""
    import pyarrow as pa

    docs, bench = leaky
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    hashed = lambda t: (lambda x: x[3][x[0]])(decontaminate.normal_words(pa.array([t or ""], pa.string())))
    texts, wanted = [hashed(t) for _, t in rows], {}
    for item, t in items:
        own = hashed(t)
        if not len(own):
            continue
        for (doc, _), text in zip(rows, texts, strict=True):
            if len(text):
                best = decontaminate.align(own[None, :], np.array([len(own)]), text[None, :])[0][0] / (2 * len(own))
                if best >= decontaminate.THRESHOLD:
                    wanted[doc, item] = max(best, wanted.get((doc, item), 0))
    got = {}
    for r in decontaminate.leaks(docs, bench).collect():
        got[r.doc_id, r.item_id] = max(r.score, got.get((r.doc_id, r.item_id), 0))
    assert got == wanted


def test_every_copy_in_a_text_is_a_row(spark):
    rng = random.Random(3)
    item = prose(rng, 25)
    gaps = {1: 0, 2: 25, 3: 100, 4: 7}
    docs = make(spark, [(k, f"{prose(rng, 12)} {item} {prose(rng, gap)} {item} {prose(rng, 9)}") for k, gap in gaps.items()] + [(5, " ".join([item] * 400))])
    rows = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, 2: 2, 3: 2, 4: 2, 5: 400}
    for r in rows:
        assert r.score > 0.95


@pytest.mark.parametrize("every,least", [(7, 1.0), (5, 1.0), (4, 1.0), (3, 0.95)])
def test_recall_by_edit_rate(spark, every, least):
    """Copies of which every so-many-th word is another one; at every third the score is just over the threshold."""
    rng = random.Random(every)
    items = [(k, prose(rng, 36)) for k in range(40)]
    edited = [(k, f"{prose(rng, 40)} {' '.join('changed%d' % j if j % every == every - 1 else w for j, w in enumerate(t.split(' ')))} {prose(rng, 40)}") for k, t in items]
    rows = decontaminate.leaks(make(spark, edited), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({r.doc_id for r in rows if r.doc_id == r.item_id}) >= least * len(items)


def test_items_of_one_template(spark, monkeypatch):
    """What many items share is no seed, unless nothing else is there; the items' own words find their copies."""
    monkeypatch.setattr(decontaminate, "SHARED", 3)
    rng = random.Random(5)
    items = [(k, f"which of the following is the right answer to this question {prose(rng, 12)}") for k in range(30)]
    docs = make(spark, [(k, f"{prose(rng, 30)} {t} {prose(rng, 30)}") for k, t in items] + [(100 + k, f"{prose(rng, 30)} which of the following is the right answer to this question {prose(rng, 30)}") for k in range(20)])
    rows = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.score > 0.9} == {(k, k) for k in range(30)}


def test_items_in_blocks_give_the_same(spark, leaky, monkeypatch):
    docs, bench = leaky
    want = {tuple(r) for r in decontaminate.leaks(docs, bench).select("doc_id", "item_id").collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 2000)
    assert {tuple(r) for r in decontaminate.leaks(docs, bench).select("doc_id", "item_id").collect()} == want


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(6)
    for _ in range(30):
        a, b = rng.integers(1, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(1, 4, rng.integers(1, 14)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        best, _ = decontaminate.align(a[None, :], np.array([len(a)]), b[None, :])
        assert best[0] == h.max()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1120)] + [(5000, 5000 + k) for k in range(60)] + [(7, 7)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path, labelled, leaky):
    import corpus_pipeline as pipeline

    docs = labelled[0].unionByName(leaky[0]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labelled[1].write.parquet(str(tmp_path / "labels.parquet"))
    leaky[1].write.parquet(str(tmp_path / "benchmark.parquet"))
    now, sizes = docs, [docs.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        sizes.append(now.count())
        assert k == len(pipeline.STAGES) - 1 or now.columns == docs.columns
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    assert pipeline.run(spark, str(tmp_path)).count() == sizes[5]
