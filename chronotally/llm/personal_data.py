"""Personal data by weak supervision.

Fixed patterns find e-mail, IP, card and phone spans; these base spans always stay. Wider patterns propose further
spans (secrets after a name and a sign, long hexadecimal keys, spelled-out addresses, numbers after a contact word, account
numbers). Labelers vote on every proposed span, 1 for, -1 against or 0: patterns (checksum, digits, entropy), gazetteers (names of
secrets, contact words) and context (signs before, quotes around). Expectation-maximisation over the
counts of vote patterns in the whole corpus estimates each labeler's reliability and each pattern's posterior; a logistic
span classifier is trained on these posteriors with the votes and the span's kind, length and digit share, and keeps
spans of probability ``ACCEPT`` or more that do not touch a base span.

Only pattern counts (bounded by kinds x votes x length classes) reach the driver; texts never do.

Defined results: null texts count as empty and have no spans; offsets are code points, ends exclusive. Repeated rows are each
searched. Null doc_ids stay null. An empty table gives no rows; extra columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import by_size

BASE = ("email", "ip", "card", "phone")
EXTRA = ("account", "address", "contact", "secret")
ACCEPT = 0.7
# fixed values: the patterns of the base kinds
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # leftmost matches never start inside digits
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# fixed values: the gazetteers
SECRET_NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "auth", "bearer", "credential")
CONTACT_WORDS = ("phone", "tel", "telephone", "mobile", "call", "fax", "contact", "whatsapp", "ssn", "passport")

_SECRET = re.compile(r"\b(?P<name>[A-Za-z0-9_]{2,})(?P<sign>\s?[=:]\s?)(?P<quote>[\"']?)(?P<value>[A-Za-z0-9_/+.-]{16,})")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])")
_ADDRESS = re.compile(r"\b[A-Za-z0-9._-]{2,40} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{2,40} ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,10}\b")
_CONTACT = re.compile(r"\b(?P<name>[A-Za-z]{2,12})(?:\.|:| no\.?| number)? ?(?P<value>[(]?[0-9]{2,4}[)]?[ .-][0-9]{2,4}[ .-][0-9]{3,4})(?![ .-]?[0-9])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each holds one @, so every @ is tried once with the run of local characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of four numbers, each at most 255."""
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]


def _only(chars: str) -> str:
    return "".join(c for c in chars if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if "." in text:
        out["ip"] = ips(text)
    out["card"] = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _only(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_only(m[0])) <= 15]
    return out


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def proposals(text: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """Further spans: kind, start, end and the labelers' votes."""
    out = []

    def add(kind: str, start: int, end: int, name: str, sign: bool, quoted: bool) -> None:
        value = text[start:end]
        digits = sum(c.isdigit() for c in value)
        before = name.lower().strip(" _")
        check = {"account": lambda: 1 if _iban(value) else -1, "secret": lambda: 1 if digits >= 4 and entropy(value) > 3 else -1, "contact": lambda: 1 if 7 <= digits <= 12 else -1, "address": lambda: 1}[kind]()
        known = SECRET_NAMES if kind == "secret" else CONTACT_WORDS
        gazetteer = 1 if any(before == w or before.endswith("_" + w) for w in known) else (-1 if kind in ("contact", "secret") and name else 0)
        context = 1 if sign or quoted else 0
        mixed = 1 if kind != "contact" and digits and digits < len(value) else (-1 if kind == "secret" else 0)
        out.append((kind, start, end, (check, gazetteer, context, mixed)))

    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            add("secret", *m.span("value"), m["name"], True, bool(m["quote"]))
    for m in _HEX.finditer(text):
        add("secret", *m.span(), "", False, text[m.start() - 1 : m.start()] in ("'", '"') and m.start() > 0)
    if "(" in text or "[" in text:
        for m in _ADDRESS.finditer(text):
            add("address", *m.span(), "", False, False)
    for m in _CONTACT.finditer(text):
        add("contact", *m.span("value"), m["name"], False, False)
    for m in _ACCOUNT.finditer(text):
        add("account", *m.span(), "", False, False)
    return out


def features(kind: str, length: int, digits: int, votes: tuple[int, ...]) -> str:
    """The pattern that EM and the classifier see."""
    return ",".join([kind, str(min(length // 8, 6)), str(int(4 * digits / max(length, 1))), *map(str, votes)])


def found_in(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int, str]]]:
    """Base spans, and the proposals that touch none of them, with their patterns; of overlapping ones the first."""
    base = base_spans(text)
    taken = sorted(s for spans in base.values() for s in spans)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # the furthest end of the spans so far
    further, last = [], -1
    for kind, start, end, votes in sorted(proposals(text), key=lambda p: (p[1], -p[2])):
        before = bisect_left(starts, end)  # base spans that start before this one ends
        if start < last or (before and reach[before - 1] > start):
            continue
        last = end
        further.append((kind, start, end, features(kind, end - start, sum(c.isdigit() for c in text[start:end]), votes)))
    return base, further


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, float]
    reliability: tuple[float, ...] = ()

    def accepts(self, pattern: str) -> bool:
        return 1 / (1 + math.exp(-max(-50, min(50, sum(self.weights.get(t, 0.0) for t in terms(pattern)))))) >= ACCEPT


def terms(pattern: str) -> list[str]:
    kind, length, digits, *votes = pattern.split(",")
    return ["bias", f"kind={kind}", f"length={kind}{length}", f"digits={kind}{digits}", *(f"vote{k}={v}" for k, v in enumerate(votes) if v != "0")]


def train(counts: dict[str, int]) -> Classifier:
    """EM over vote patterns (two classes, independent labelers), then logistic regression on the posteriors."""
    patterns = sorted(counts)
    if not patterns:
        return Classifier({})
    n = np.array([counts[p] for p in patterns], dtype=np.float64)
    votes = np.array([[int(v) for v in p.split(",")[3:]] for p in patterns])
    right = np.full(votes.shape[1], 0.8)  # chance that a labeler's vote is right, given that it votes
    prior = 0.5
    post = np.full(len(n), 0.5)
    for _ in range(50):
        yes = np.where(votes == 1, np.log(right), np.where(votes == -1, np.log(1 - right), 0)).sum(axis=1) + math.log(prior)
        no = np.where(votes == -1, np.log(right), np.where(votes == 1, np.log(1 - right), 0)).sum(axis=1) + math.log(1 - prior)
        post = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        agree = np.where(votes == 1, post[:, None], np.where(votes == -1, 1 - post[:, None], 0))
        # smoothed, and a labeler stays better than chance, so that the classes keep their meaning
        right = np.clip((n @ agree + 8) / (n @ (votes != 0) + 10), 0.55, 0.99)
        prior = float(np.clip((n @ post + 1) / (n.sum() + 2), 0.05, 0.95))
    names = sorted({t for p in patterns for t in terms(p)})
    x = np.array([[t in own for t in names] for own in (set(terms(p)) for p in patterns)], dtype=np.float64)
    w = np.zeros(len(names))
    share = n / n.sum()
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= 2.0 * (x.T @ (share * (p - post)) + 1e-4 * w)
    return Classifier(dict(zip(names, w.tolist(), strict=True)), tuple(right.tolist()))


def _worth_a_look(texts: pa.ChunkedArray) -> np.ndarray:
    """Texts that can hold a span: all patterns need a digit, an @ or a bracketed word, or a name, a sign and a long value."""
    texts = pc.fill_null(texts, "")
    return pc.match_substring_regex(texts, r"[0-9@]|[\[(](?:at|AT)[\])]|[A-Za-z_]\s?[=:]\s?[\"']?[A-Za-z0-9_/+.-]{16}").to_numpy(zero_copy_only=False).astype(bool)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_size(batch):
            texts = part["text"].filter(pa.array(_worth_a_look(part["text"]))).to_pylist()
            found = Counter(p for t in texts for *_, p in found_in(t)[1])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])


def learn(docs: DataFrame) -> Classifier:
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_patterns, "pattern string, n long")
    return train({r.pattern: r.n for r in rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})  # bounded: see above


def spans_of(text: str, classifier: Classifier) -> list[tuple[str, int, int]]:
    base, further = found_in(text)
    kept: dict[str, list[tuple[int, int]]] = dict(base)
    for kind in EXTRA:
        kept[kind] = [(a, b) for k, a, b, p in further if k == kind and classifier.accepts(p)]
    return [(kind, a, b) for kind in (*BASE, *EXTRA) for a, b in sorted(kept[kind])]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in by_size(batch):
                look = _worth_a_look(part["text"])
                counts, sums, joined = np.zeros((5, part.num_rows), dtype=np.int64), [nothing] * part.num_rows, [""] * part.num_rows
                at = np.flatnonzero(look)
                for k, text in zip(at.tolist(), part["text"].filter(pa.array(look)).to_pylist(), strict=True):
                    spans = spans_of(text, own)
                    counts[4, k] = len(spans)
                    if spans:
                        base = [s for s in spans if s[0] in BASE]
                        for kind, _, _ in base:
                            counts[BASE.index(kind), k] += 1
                        sums[k], joined[k] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), *map(pa.array, counts[:4]), pa.array(sums, pa.string()), pa.array(joined, pa.string()), pa.array(counts[4])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; touching spans are masked as the earlier one."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = b
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``docs`` with the spans in ``text`` masked; all columns and rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at_column = batch.schema.get_field_index("text")
            for part in by_size(batch):
                look = _worth_a_look(part["text"])
                texts = [masked(t, spans_of(t, own)) if x else t for t, x in zip(part["text"].to_pylist(), look.tolist(), strict=True)]
                part = part.set_column(at_column, "text", pa.array(texts, part.schema.field("text").type))
                yield from part.combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.schema)


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return detect(docs, learn(docs))
