"""Identifiers: version-5 UUIDs in Column expressions, readable prefixes, short forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

SEPARATOR = "\x1f"


def uuid5(namespace: uuid.UUID, *parts: Column | str) -> Column:
    """The UUID that uuid.uuid5 gives for the parts joined by U+001F."""
    name = F.concat_ws(SEPARATOR, *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    digest = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), name.cast("binary")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), F.lower(F.conv(variant.cast("string"), 10, 16)), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def resolve(df: DataFrame, column: str, short: str, least: int = 4) -> str:
    """The one id of ``column`` that is ``short`` or begins with it (after its prefix)."""
    own = F.col(column)
    if not df.where(own == short).isEmpty():
        return short
    if len(short.split("_", 1)[-1]) < least:
        raise ValueError(f"{short!r} is unknown, and too short to begin an id: {least} characters at least")
    found = [r[0] for r in df.where(own.startswith(short) | F.substring_index(own, "_", -1).startswith(short)).select(own).distinct().orderBy(own).limit(6).collect()]
    if len(found) != 1:
        raise LookupError(f"no id begins with {short!r}" if not found else f"{short!r} is ambiguous: {', '.join(found[:5])}")
    return found[0]


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def did_you_mean(word: str, known) -> str | None:
    best = min(known, key=lambda k: (edit_distance(word.lower(), k.lower()), k), default=None)
    return best if best is not None and edit_distance(word.lower(), best.lower()) <= 2 else None
