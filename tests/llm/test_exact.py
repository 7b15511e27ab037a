"""Operators held against brute force, on ordinary, awkward and empty tables with extra columns of clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronotally.llm import attention_lm, content_store, jaccard_join, licences, packing, personal_data, quality_rules, recompression
from chronotally.llm.shared import new_path
from chronotally.llm.subwords import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def same(got, want):
    key = lambda r: [(x is None, str(type(x)), x) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_substring_dedup(spark, corpus):
    pairs, docs = corpus
    n = 35
    all_words = [words(t) for _, t in pairs]
    seen = Counter(tuple(w[k : k + n]) for w in all_words for k in range(len(w) - n + 1))
    want = []
    for (i, _), w in zip(pairs, all_words, strict=True):
        covered = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                covered[k : k + n] = True
        kept = " ".join(x for x, c in zip(w, covered, strict=True) if not c)
        want.append((i, len(w), int(covered.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = recompression.remove_repeats(docs).collect()
    same(got, want)


@pytest.mark.parametrize("rounds", ["RPP", "RPRPP", "PPPPPPP"])
def test_recompression_is_consistent(rounds):
    """A symbol whose span of dependence lies in a window stands in every equal window."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 5, 400).astype(np.uint64)
    other = np.concatenate([rng.integers(0, 5, 57).astype(np.uint64), base[100:200], rng.integers(0, 5, 50).astype(np.uint64)])
    from chronotally.llm.words import mix

    found = []
    for values, shift in ((base, 100), (other, 57)):
        s = recompression.compress(np.stack([mix(values + np.uint64(k)) for k in (1, 99)], axis=1), np.zeros(len(values), dtype=int), rounds)
        inside = (s.low >= shift) & (s.high <= shift + 100)
        found.append(set(zip(s.names[inside, 0].tolist(), s.names[inside, 1].tolist(), *((x[inside] - shift).tolist() for x in (s.start, s.end, s.low, s.high)), strict=True)))
    assert found[0] == found[1] and found[0]


def test_store_round_trip(spark, corpus):
    pairs, docs = corpus
    tool = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    store = content_store.write_store(docs, new_path(spark, "store"))
    got = content_store.read_digests(spark, store).collect()
    ids = {r.start: r.ids for r in content_store.read_ids(spark, store).collect()}
    by_start = sorted(got, key=lambda r: r.start)
    assert len(got) == len(pairs)
    at = 0
    encoded = defaultdict(list)
    for i, t in pairs:
        encoded[i].append(tool.encode(t or "", add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in by_start] == sorted((i for i, _ in pairs), key=lambda i: (i is not None, i or 0))
    for r in by_start:
        own = list(ids[r.start])
        assert r.start == at and r.n_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        encoded[r.doc_id].remove(own)
        at += r.n_tokens
    assert not any(encoded.values())


def test_store_finds_damage(spark, ordinary):
    from .conftest import make

    store = content_store.write_store(make(spark, ordinary[:20]), new_path(spark, "store"))
    chunks = store.table(spark, "chunks").collect()
    bad = [(r.chunk_id, r.n_ids, bytes(r.payload[:-1]) + bytes([r.payload[-1] ^ 1])) if k == 0 else (r.chunk_id, r.n_ids, bytes(r.payload)) for k, r in enumerate(chunks)]
    for damaged in (bad, bad[1:]):
        path = new_path(spark, "damaged")
        spark.createDataFrame(damaged, "chunk_id binary, n_ids int, payload binary").write.parquet(f"{path}/chunks")
        for name in ("recipes", "manifest"):
            store.table(spark, name).write.parquet(f"{path}/{name}")
        for read in (content_store.read_digests, content_store.read_ids):
            with pytest.raises(Exception, match="chunk"):
                read(spark, content_store.Store(path)).collect()


def test_manifest_finds_lost_and_altered_recipes(spark, ordinary, monkeypatch):
    from .conftest import make

    monkeypatch.setattr(content_store, "PAGE", 8)
    store = content_store.write_store(make(spark, ordinary[:40]), new_path(spark, "store"))
    content_store.check_manifest(spark, store)
    recipes, manifest = store.table(spark, "recipes"), store.table(spark, "manifest")
    assert manifest.count() >= 5
    last = recipes.agg(F.max("start")).first()[0]
    cases = [
        (recipes.where(F.col("start") != last), manifest), (recipes.where("start > 0"), manifest), (recipes.unionByName(recipes.where("start = 0")), manifest), (recipes.withColumn("n_tokens", F.col("n_tokens") + (F.col("start") == 0).cast("int")), manifest), (recipes.withColumn("doc_id", F.col("doc_id") + (F.col("start") == 0).cast("int")), manifest),
        (recipes.limit(0), manifest), (recipes, manifest.where("first > 0")),
    ]
    for rows, pages in cases:
        path = new_path(spark, "damaged")
        rows.write.parquet(f"{path}/recipes")
        pages.write.parquet(f"{path}/manifest")
        store.table(spark, "chunks").write.parquet(f"{path}/chunks")
        with pytest.raises(ValueError, match="manifest"):
            content_store.read_digests(spark, content_store.Store(path))


def test_packing(spark, corpus):
    pairs, docs = corpus
    tool = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    tool.encode_special_tokens = True
    pieces = packing.pack(docs).collect()
    encoded = defaultdict(list)
    for i, t in pairs:
        encoded[i].append(tool.encode(t or "", add_special_tokens=False).ids + [1])
    size = defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == size[r.sequence_id]
        size[r.sequence_id] += r.length
    assert sorted(size) == list(range(len(size))) and all(s <= 2048 for s in size.values())
    # each document is the chain of its pieces in sequence order
    open_docs = defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        whole = [ids for ids in encoded[r.doc_id] if len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert whole
        open_docs[r.doc_id].append((r.start, r.length))
    for i, own in encoded.items():
        assert sum(n for _, n in open_docs[i]) == sum(map(len, own))
    if size:
        assert sum(packing.padding(s, 2048) for s in size.values()) < 0.03 * sum(size.values()) + 2048 * 4


def test_best_cuts_are_best():
    rng = np.random.default_rng(1)
    for _ in range(60):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 14))])
        penalty = rng.integers(0, 5, len(places)).astype(float)
        penalty[-1] = 0
        length = 16
        cost = [0.0] + [math.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                n = int(places[j] - places[i])
                if n <= length:
                    cost[j] = min(cost[j], cost[i] + packing.padding(n, length) + penalty[j])
        ends = packing.best_cuts(places, penalty, length)
        starts = np.concatenate([[0], ends[:-1]])
        got = sum(packing.padding(int(b - a), length) + penalty[list(places).index(b)] for a, b in zip(starts, ends, strict=True))
        assert got == cost[-1]


def test_language_model(spark, corpus):
    pairs, docs = corpus
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in pairs]
    tokens = [words((t or "").translate(small)) + [None] for _, t in pairs]
    counts = Counter(x for h, w in zip(held, tokens, strict=True) if not h for x in w)
    n, v = sum(counts.values()), len(counts)
    rows = attention_lm.score(docs).collect()
    want = [(i is not None, i, h, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for (i, _), h, w in zip(pairs, held, tokens, strict=True)]
    same([(r.doc_id is not None, r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows], want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_every_token_is_scored_once():
    rng = np.random.default_rng(2)
    lengths = np.array([0, 1, 15, 16, 17, 31, 32, 33, 100])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    rows, target = attention_lm.windows(rng.integers(0, 9, offsets[-1]), offsets)
    used = target[target >= 0]
    assert sorted(used.tolist()) == list(range(int(offsets[-1]) + len(lengths)))
    assert rows.shape[1] == attention_lm.CONTEXT + attention_lm.STRIDE


def test_attention_is_a_causal_distribution():
    rng = np.random.default_rng(2)
    model = attention_lm.new_attention(np.full(attention_lm.CLASSES, 1 / attention_lm.CLASSES))
    rows = rng.integers(0, attention_lm.INPUTS, (4, attention_lm.CONTEXT + attention_lm.STRIDE))
    z = model.forward(rows)["z"]
    assert np.allclose(np.exp(z).sum(axis=2), 1, atol=1e-4)
    changed = rows.copy()
    changed[:, attention_lm.CONTEXT + 5 :] = 7
    again = model.forward(changed)["z"]
    assert np.allclose(z[:, :5], again[:, :5], atol=1e-5) and not np.allclose(z[:, 6:], again[:, 6:], atol=1e-5)


def test_quality_measures(spark, corpus):
    pairs, docs = corpus
    want = []
    for i, t in pairs:
        t = t or ""
        w = words(t)
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    rows = quality_rules.measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(rows, want)


def test_near_duplicates(spark, corpus):
    pairs, docs = corpus
    sets = []
    for _, t in pairs:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent, links = list(range(len(pairs))), [0] * len(pairs)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for k, (i, _) in enumerate(pairs):
        least[root(k)].append(i)
    want = [(i, min((x for x in least[root(k)] if x is not None), default=None), links[k], len(sets[k])) for k, (i, _) in enumerate(pairs)]
    same(jaccard_join.op9(spark, docs).select("doc_id", "class_id", "n_links", "n_shingles").collect(), want)


def test_one_of_each_class(spark, corpus):
    pairs, docs = corpus
    rows = jaccard_join.one_of_each(docs)
    assert rows.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in rows.collect()]
    assert all(k in pairs for k in kept)
    # one for each class, also where two classes share their smallest doc_id or have none; it is the first by id, then text hash
    members = defaultdict(list)
    for r in jaccard_join.near_duplicates(docs).where("n_shingles > 0").collect():
        members[r.root].append((r.doc_id is None, r.doc_id or 0, r.tie))
    want = sorted(min(m)[:2] for m in members.values())
    assert sorted((i is None, i or 0) for i, t in kept if words(t)) == want
    assert sum(not words(t) for _, t in kept) == sum(not words(t) for _, t in pairs)


def exact_links(texts):
    """Numbers of links and least members of the classes, by brute force over pairs that share a shingle."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in map(words, texts)]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    links, label = [set() for _ in sets], list(range(len(sets)))
    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g] if j > k)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                links[k].add(j)
                links[j].add(k)
    for k in range(len(sets)):
        if label[k] == k:
            stack = [k]
            while stack:
                for j in links[stack.pop()]:
                    if label[j] > k:
                        label[j] = k
                        stack.append(j)
    return {k: (label[k], len(links[k])) for k in range(len(sets))}


def linked(spark, texts):
    from .conftest import make

    return {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.op9(spark, make(spark, list(enumerate(texts)))).collect()}


def test_templates_keep_all_their_links(spark):
    """Buckets of over 128 short sets whose links are all of similarity 0.8: 60 templates of 8 words, 140 texts with one more word each."""
    texts = []
    for k in range(60):
        base = " ".join(f"t{k}w{j}" for j in range(8))
        texts += [base, *(f"{base} own{k}x{j}" for j in range(140))]
    got = linked(spark, texts)
    assert got == exact_links(texts) and sum(n for _, n in got.values()) == 2 * 60 * 140


def test_common_passage_and_near_copies(spark, monkeypatch):
    """Texts that share a passage only part in the deeper steps; near copies among them stay linked, and so do those of other similarities."""
    monkeypatch.setattr(jaccard_join, "SMALL", 12)
    monkeypatch.setattr(jaccard_join, "BLOCK", 60)
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{j}" for j in range(60))
    texts = [passage + " " + " ".join(f"d{k}x{j}" for j in range(int(rng.integers(40, 160)))) for k in range(150)]
    for k in range(60):
        own = texts[k % 3].split(" ")
        for at in rng.integers(0, len(own), k % 4):
            own[at] = f"edit{k}x{at}"
        texts.append(" ".join(own))
    assert linked(spark, texts) == exact_links(texts)


def test_buckets_of_one_group_and_a_few_others_are_not_split(spark, monkeypatch):
    """120 edited copies of a text, too unlike to leave their buckets, with pairs of others that quote it: all links, and no bucket is split."""
    monkeypatch.setattr(jaccard_join, "SMALL", 12)
    monkeypatch.setattr(jaccard_join, "SLICE", 20)
    rows = []

    def counted(df, name):
        out = staged(df, name)
        rows.append((name, out.count()))
        return out

    staged = jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", counted)
    rng = np.random.default_rng(5)
    base, texts = [f"b{j}" for j in range(200)], []
    for k in range(120):
        own = list(base)
        for at in rng.integers(0, 200, 6):
            own[at] = f"edit{k}x{at}"
        texts.append(" ".join(own))
    for k in range(4):
        own = base[20 * k : 20 * k + 60] + [f"o{k}x{j}" for j in range(100)]
        texts += [" ".join(own), " ".join([*own[:-1], "last"])]
    want = exact_links(texts)
    assert linked(spark, texts) == want and all(want[k][1] for k in range(120, 128))
    assert sum(n for name, n in rows if name == "beside") and [name for name, _ in rows].count("paths") == 1


def test_recall_on_random_texts(spark, ordinary):
    """Recall against brute force on edited copies of all rates; every link above the threshold is found."""
    rng = np.random.default_rng(8)
    texts = [t for _, t in ordinary]
    for t in list(texts[:110]):
        own = t.split(" ")
        for _ in range(int(rng.integers(1, 6))):
            own[int(rng.integers(0, len(own)))] = "other"
        texts.append(" ".join(own))
    want = exact_links(texts)
    got = linked(spark, texts)
    assert sum(n for _, n in got.values()) == sum(n for _, n in want.values()) and got == want


def test_large_near_copy_group(spark, monkeypatch):
    """A group beyond one block is compared in pairs of blocks; buckets are split and star-linked."""
    from .conftest import make

    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    monkeypatch.setattr(jaccard_join, "SMALL", 16)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(130):
        own = list(base)
        own[k % 115] = f"edit{k}"
        texts.append(" ".join(own))
    docs = make(spark, list(enumerate(texts)) + [(500, " ".join(f"u{k}" for k in range(100)))])
    rows = {r.doc_id: r for r in jaccard_join.op9(spark, docs).collect()}
    assert all(rows[k].class_id == 0 for k in range(130)) and rows[500].class_id == 500 and rows[500].n_links == 0
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    for k in (0, 7, 64, 129):
        assert rows[k].n_links == sum(len(sets[k] & o) >= 0.8 * len(sets[k] | o) for j, o in enumerate(sets) if j != k)


def test_split_buckets_lose_no_pair(spark, monkeypatch):
    """Every bucket is split: pairs of similarity 0.8 are all linked, of short and of long texts."""
    from .conftest import make

    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    texts = []
    for k in range(600):
        size = 9 if k % 2 else 94
        own = [f"w{k}x{j}" for j in range(size)]
        texts += [" ".join(own), " ".join(own[: 4 + (size - 4) * 4 // 5])]
    rows = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.op9(spark, make(spark, list(enumerate(texts)))).collect()}
    assert rows == {k: (k - k % 2, 1) for k in range(len(texts))}


BASE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "x@y", "@a.b", "a@b.c@d.e", "..@-.-", "mail me at a.b+c@d-e.co.uk, or z@q", "a@b..c", "é@b.c", "a@b.c.", "@@a@b.c"])
def test_email_finder_equals_the_pattern(text):
    assert personal_data.emails(text) == [m.span() for m in BASE_EMAIL.finditer(text)]


def test_personal_data(spark, awkward):
    from .conftest import make

    extra = [(100, "Call +1 (377) 555-0271, mail a.b@c.example.com from 10.0.0.255 or 10.0.0.256; card 4111 1111 1111 1111 not 4111 1111 1111 1112."), (101, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'), (102, "a clean text about tokens and keys, 42 of them")]
    docs = make(spark, awkward + extra)
    rows = {r.doc_id: r for r in personal_data.op10(spark, docs).collect() if r.doc_id in (100, 101, 102)}
    r = rows[100]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    at = lambda kind, part: f"{kind}:{extra[0][1].index(part)}:{extra[0][1].index(part) + len(part)}"
    base = ",".join([at("email", "a.b@c.example.com"), at("ip", "10.0.0.255"), at("card", "4111 1111 1111 1111"), at("phone", "+1 (377) 555-0271")])
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == base
    assert rows[101].spans == "secret:9:49" and rows[102].spans == ""
    masked = personal_data.redact(docs, personal_data.learn(docs))
    assert masked.columns == docs.columns and masked.count() == docs.count()
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[101] == 'token = "<secret>" end' and texts[102] == extra[2][1]
    assert personal_data.op10(spark, docs.limit(0)).count() == 0


def test_em_learns_reliability():
    counts = {"secret,5,2,1,1,1,1": 90, "secret,3,0,-1,-1,0,-1": 60, "secret,4,1,1,-1,0,1": 5, "contact,1,3,1,1,0,0": 20}
    model = personal_data.train(counts)
    assert model.accepts("secret,5,2,1,1,1,1") and not model.accepts("secret,3,0,-1,-1,0,-1")


def test_licences(spark, corpus):
    import duckdb

    pairs, docs = corpus
    lines = [(200, "Intro. Licensed under the Apache License, Version 2.0. More."), (201, "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"), (202, "Released under the MIT License.\nAll rights reserved."), (203, "This work is licensed under the GNU General Public License, version 3.")]
    from .conftest import make

    docs = docs.unionByName(make(spark, lines)) if pairs else docs
    table = docs.select("doc_id", "text").toPandas().drop_duplicates()  # noqa: F841
    if pairs:
        found = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
        assert (found[200], found[201], found[202], found[203]) == ("Apache-2.0", "", "MIT,all-rights-reserved", "GPL-3.0")
        con = duckdb.connect()
        con.register("documents", table[table.doc_id.between(13, 203)])
        want = con.sql(licences.sql()).fetchall()
        same([tuple(r) for r in licences.scan(docs.where("doc_id between 13 and 203").dropDuplicates(["doc_id"])).select("doc_id", "sentences", "licences", "n_sentences", "n_licences").collect()], [tuple(r) for r in {w[0]: w for w in want}.values()])
    else:
        assert licences.scan(docs).count() == 0


def test_ordered_licence_rule(spark):
    text = ".\n".join(licences.SENTENCES[k][0] for k in ("mit-title", "mit-grant", "mit-condition", "mit-warranty"))
    wrong = ".\n".join(licences.SENTENCES[k][0] for k in ("mit-warranty", "mit-condition", "mit-grant"))
    rows = licences.scan(spark.createDataFrame([(1, text), (2, wrong)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].licences == "MIT-text" and rows[1].licences == ""


WRAPPED = {
    "Apache-2.0,Apache-2.0-header": """# Copyright 2020 A. Person
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
""",
    "MIT-text": """MIT License

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
""",
    "GPL-3.0-header": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "BSD-3-Clause-text,BSD-2-Clause-text,all-rights-reserved": """Copyright (c) 2020, A Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
}


def test_wrapped_licence_texts(spark):
    rows = licences.scan(spark.createDataFrame(list(enumerate(WRAPPED.values())), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == list(WRAPPED)


@pytest.mark.parametrize("name", ["token", "AWS_S3_SECRET_KEY", "the_very_long_name_of_a_service_token"])
def test_a_secret_is_one_whole_span(name):
    value = "aB3xK9" * 40
    text = f"set {name}={value} here"
    assert [text[a:b] for _, a, b, _ in personal_data.proposals(text)] == [value]
    key = "0123456789abcdef" * 12
    assert [s[1:3] for s in personal_data.proposals(f"x {key} y")] == [(2, 2 + len(key))]


def test_word_hashes_keep_patterned_words_apart():
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 under every odd base."""
    import pyarrow as pa

    from chronotally.llm.words import hash_pairs

    w = "a"
    for _ in range(13):
        w += w.translate(str.maketrans("ab", "ba"))
    pair = hash_pairs(pa.array([w, w.translate(str.maketrans("ab", "ba")), w], pa.large_string()))
    assert (pair[0] != pair[1]).all() and (pair[0] == pair[2]).all()


def test_patterned_words_are_no_repeats(spark):
    from .conftest import make

    w = "a"
    for _ in range(11):
        w += w.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(36))
    docs = make(spark, [(1, f"{w} " + " ".join(["x"] * 20)), (2, w.translate(str.maketrans("ab", "ba")) + " " + " ".join(["x"] * 20)), (3, f"{w} {tail}"), (4, w.translate(str.maketrans("ab", "ba")) + f" {tail}")])
    assert {r.doc_id: r.n_removed for r in recompression.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 36, 4: 36}


def test_runs_of_signs_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "+1" * 500_000, "a@" * 500_000, "a-" * 500_000, "=" * 1_000_000, "tel 12 " * 150_000):
        personal_data.found_in(text)
    assert time.perf_counter() - began < 15


def plain_spans(text):
    """The base spans by the patterns as they are given."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_personal_data_against_plain_rules(spark):
    """Random texts of the patterns' signs: base spans by the given patterns, further spans by a plain loop over the proposals."""
    from .conftest import make

    rng = np.random.default_rng(11)
    signs = ["1", "2", "255", "256", "4111 1111 1111 1111", "+1 (555) 010-9999", "a.b@c.de", "@", ".", "-", " ", "+", "(", ")", "x", "tel ", "555-123-4567", "token=abcd1234efgh5678ijkl", "key: 'Zx81hd92ks01mv83'", "00ff" * 10, "joe [at] host [dot] org", "GB82 WEST 1234 5698 7654 32", "10.0.0.1", "é🙂"]
    pairs = [(k, "".join(rng.choice(signs, rng.integers(1, 25)))) for k in range(400)] + [(900, None), (901, "")]
    docs = make(spark, pairs)
    model = personal_data.learn(docs)
    rows = {r.doc_id: r for r in personal_data.detect(docs, model).collect()}
    for i, text in pairs:
        text = text or ""
        base = plain_spans(text)
        order = {k: n for n, k in enumerate((*personal_data.BASE, *personal_data.EXTRA))}
        spans, last = list(base), -1
        for kind, a, b, votes in sorted(personal_data.proposals(text), key=lambda p: (p[1], -p[2])):
            if a >= last and not any(x < b and a < y for _, x, y in base):
                last = b
                if model.accepts(personal_data.features(kind, b - a, sum(c.isdigit() for c in text[a:b]), votes)):
                    spans.append((kind, a, b))
        join = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(xs, key=lambda s: (order[s[0]], s[1])))
        r = rows[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in personal_data.BASE)
        assert r.base_sha256 == hashlib.sha256(join(base).encode()).hexdigest() and r.spans == join(spans) and r.n_spans == len(spans)
    assert any(r.n_spans > r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows.values())


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""


def commented(text, first, each, last):
    return first + "\n".join(each + line for line in text.split("\n")) + last


@pytest.mark.parametrize("first,each,last", [("", "", ""), ("/*\n", " * ", "\n */\nint main() {}"), ("", "// ", "\ncode();"), ("#!/bin/sh\n", "# ", "\nset -e"), ("", ";; ", ""), ("", "\t", "")])
def test_licence_texts_in_comments(spark, first, each, last):
    docs = spark.createDataFrame([(k, commented(t, first, each, last)) for k, t in enumerate((MIT, ISC, LGPL))], "doc_id long, text string")
    got = {r.doc_id: r.licences.split(",") for r in licences.scan(docs).collect()}
    assert "MIT-text" in got[0] and got[1] == ["ISC-text"] and got[2] == ["LGPL-2.1-header"]


def test_licences_equal_the_sql(spark, awkward):
    """On texts put together from sentences, wraps, list marks, versions, odd white space; with null and repeated ids."""
    import duckdb

    rng = np.random.default_rng(2)
    parts = [MIT, ISC, LGPL, "All rights  reserved.", "All Rights-Reserved", "Released under the MIT License.", "licensed under the\nMIT license.", "under the Mozilla Public License, v. 2.0.", "\n\n", "\n", " ", "\n1. ", "\n (a) ", "\nv. ", ": \n", "! ", "v.\n2", " * ", "page\n12? Foo", "Copyright 2020 X\n", "# Heading\n# ", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: MIT", "\x0b", "\t", "a. b", "?\n"]
    pairs = [(k % 170 if k % 11 else None, "".join(rng.choice(parts, rng.integers(1, 12)))) for k in range(400)] + awkward + [(7, None), (7, "MIT License")]
    docs = spark.createDataFrame([(i, t) for i, t in pairs], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    same(licences.scan(docs).collect(), con.execute(licences.sql()).fetchall())


def test_score_against_a_plain_loop(spark, ordinary):
    """Every document's score from one token at a time: softmax over the visible window, class by class, and the word's share of its class."""
    from .conftest import make

    import pyarrow as pa

    from chronotally.llm.subwords import encoder

    docs = make(spark, ordinary[:60] + [(1000, None), (1001, ""), (1002, "unseen wörd \u65e5\u672c")])
    fitted = attention_lm.learn(docs)
    counts = {r.word: r.n for r in fitted.counts.collect()}
    rows = {r.doc_id: r for r in attention_lm.score(docs, fitted).collect()}
    m, tool = fitted.attention, encoder(vocabulary_path(attention_lm.VOCABULARY), spaces=True)
    context, stride, end = attention_lm.CONTEXT, attention_lm.STRIDE, attention_lm.END
    for i, text in [*ordinary[:4], (1000, ""), (1002, "unseen wörd \u65e5\u672c")]:
        own = words(text.lower())
        kind, entry, share = fitted.chain.words(tool, pa.array(own, pa.large_string()), np.array([counts.get(w, 0) for w in own])) if own else ([], [], [])
        stream = [attention_lm.START, *entry]
        total = float(sum(share))
        for k in range(len(own) + 1):
            # the window that scores this token: the inputs that it sees, each at its own place
            first = k // stride * stride - context
            seen = [(j - first, stream[j]) for j in range(max(first, 0), k + 1)]
            x = [m.embed[c] + m.place[p] for p, c in seen]
            q = x[-1] @ m.query
            s = np.array([q @ (v @ m.key) / math.sqrt(attention_lm.WIDTH) for v in x], dtype=np.float64)
            a = np.exp(s - s.max())
            h = sum(w * (v @ m.value) for w, v in zip(a / a.sum(), x, strict=True)) + x[-1]
            z = (h @ m.out + m.bias).astype(np.float64)
            total += (z[kind[k] if k < len(own) else end] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
        assert abs(rows[i].score - total) < 1e-3 * (1 + abs(total))


def test_chances_sum_to_one(spark, ordinary):
    """Inside each class the shares of all training words and of the unseen rest are at most one, and the classes sum to one."""
    from .conftest import make

    import pyarrow as pa

    from chronotally.llm.subwords import encoder

    fitted = attention_lm.learn(make(spark, ordinary[:60]))
    rows = fitted.counts.collect()
    kind, _, share = fitted.chain.words(encoder(vocabulary_path(attention_lm.VOCABULARY), spaces=True), pa.array([r.word for r in rows], pa.large_string()), np.array([r.n for r in rows]))
    assert (np.bincount(kind, weights=10**share) <= 1 + 1e-6).all()
    z = fitted.attention.forward(np.full((1, attention_lm.CONTEXT + attention_lm.STRIDE), attention_lm.START))["z"]
    assert np.allclose(np.exp(z).sum(axis=2), 1, atol=1e-5)


def test_gradients_are_differences(spark):
    rng = np.random.default_rng(0)
    model = attention_lm.new_attention(np.full(attention_lm.CLASSES, 1 / attention_lm.CLASSES))
    rows = rng.integers(0, attention_lm.INPUTS, (3, attention_lm.CONTEXT + attention_lm.STRIDE))
    rows[0, :5] = attention_lm.PAD
    wanted = rng.integers(-1, attention_lm.CLASSES, (3, attention_lm.STRIDE))

    def loss(m):
        z = m.forward(rows)["z"]
        w, t = np.nonzero(wanted >= 0)
        return -z[w, t, wanted[w, t]].astype(np.float64).mean()

    grads = attention_lm.gradients(model, rows, wanted)
    for p in model.parameters():
        direction = rng.standard_normal(getattr(model, p).shape)
        moved = [attention_lm.Attention(**{n: getattr(model, n) + (s * 1e-2 * direction).astype(np.float32) if n == p else getattr(model, n) for n in model.parameters()}) for s in (1, -1)]
        slope = (loss(moved[0]) - loss(moved[1])) / 2e-2
        assert abs(slope - (grads[p] * direction).sum()) < 0.03 * max(abs(slope), 0.05)


def test_all_windows_are_learnt_from(monkeypatch):
    """Counts for the start and the runs of training hold every target of every text once, whatever the runs' length."""
    import pyarrow as pa

    monkeypatch.setattr(attention_lm, "LOCAL", 10)
    rng = np.random.default_rng(3)
    lengths = [0, 1, 15, 16, 17, 500, 40, 0, 3000, 31]
    kinds = [rng.integers(0, attention_lm.END, n) for n in lengths]
    inputs = [rng.integers(0, attention_lm.INPUTS, n) for n in lengths]
    batch = pa.RecordBatch.from_arrays([pa.array([x.astype("<u2").tobytes() for x in inputs], pa.binary()), pa.array([x.astype("u1").tobytes() for x in kinds], pa.binary())], names=["inputs", "kinds"])
    want = Counter()
    for entry, kind in zip(inputs, kinds, strict=True):
        want.update(zip([attention_lm.START, *entry.tolist()], [*kind.tolist(), attention_lm.END], strict=True))
    batches = [batch.slice(0, 4), batch.slice(4, 4), batch.slice(8)]
    (counted,) = attention_lm._pairs(iter(batches))
    table = np.frombuffer(counted["weights"][0].as_py(), np.float64).reshape(-1, attention_lm.CLASSES)
    assert counted["n"][0].as_py() == sum(want.values()) and {(a, b): table[a, b] for a, b in zip(*(x.tolist() for x in np.nonzero(table)), strict=True)} == want
    got, sizes = Counter(), []
    for rows, wanted in attention_lm._runs(iter(batches)):
        sizes.append(len(rows))
        w, t = np.nonzero(wanted >= 0)
        got.update(zip(rows[w, attention_lm.CONTEXT + t].tolist(), wanted[w, t].tolist(), strict=True))
    assert got == want and all(5 <= n <= 15 for n in sizes)


def test_scoring_reads_codes_not_texts(spark, ordinary):
    """The last step of the scores reads the staged codes of the words, and no texts to be split and asked for again."""
    from .conftest import make

    scored = attention_lm.score(make(spark, ordinary[:30]))
    plan = scored._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and plan.count("MapInArrow") and all("/coded-" in f for f in scored.inputFiles())
