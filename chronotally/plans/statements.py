"""The statement language: SHOW, WHY, TRACE, STATE, DIFF, WHAT IS, EXPLAIN. Text in, a small tree out."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.ids import did_you_mean


class StatementError(ValueError):
    def __init__(self, message: str, text: str = "", at: int | None = None):
        super().__init__(message if at is None else f"{message}\n{text}\n{' ' * at}^")
        self.at = at


#: Words after SHOW, and the table they mean.
TARGETS = {"ATTEMPTS": "attempts", "FAILED ATTEMPTS": "attempts", "SUPERSEDED ATTEMPTS": "attempts", "SESSIONS": "sessions", "TURNS": "turns", "TOOL CALLS": "tool_calls", "TOOL_CALLS": "tool_calls", "HANDOFFS": "handoffs", "WORK UNITS": "work_units", "WORK_UNITS": "work_units", "DECISIONS": "decisions", "COMMITS": "commits", "EDGES": "edges", "SIGNALS": "signals", "CORRECTIONS": "corrections", "RETRACTIONS": "retractions", "CONFLICTS": "conflicts", "EVENTS": "events", "EVIDENCE": "evidence"}
KEYS = ("project", "session", "provider", "agent", "turn", "path", "outcome", "status", "phase", "tool", "since", "until")
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*'|\"[^\"]*\")|(?P<word>[A-Za-z0-9_.:/*%@+\-|]+)|(?P<sign>[=,;()<>!]))")


@dataclass
class Statement:
    verb: str
    target: str = ""
    kind: str = ""  # failed, superseded, blocked
    subject: tuple[str, str] | None = None
    filters: list[tuple[str, str]] = field(default_factory=list)
    between: tuple[str, str] | None = None
    where: str | None = None
    order: tuple[str, bool] | None = None
    limit: int | None = 100  # None: LIMIT ALL
    retracted: bool = False
    times: list[str] = field(default_factory=list)
    depth: int = 10
    direction: str = "both"
    inner: str = ""


def is_statement(text: str) -> bool:
    """Does the text belong to this language rather than to SQL? Leading comments are skipped."""
    plain = re.sub(r"\A(?:\s+|--[^\n]*\n|/\*.*?\*/)*", "", text, flags=re.S)
    words = plain.upper().split()
    if not words:
        return False
    if words[0] == "SHOW":
        return words[1:2] != ["COLUMNS"] and words[1:2] != ["TABLES"]
    if words[0] == "EXPLAIN":
        return is_statement(plain.split(None, 1)[1]) if len(words) > 1 else False
    return words[0] in ("WHY", "TRACE", "STATE", "DIFF", "WHAT")


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise StatementError("unreadable text", text, at + len(text[at:]) - len(text[at:].lstrip()))
            kind = m.lastgroup
            value = m[kind]
            if kind == "text":
                value = value[1:-1].replace("''", "'")
            self.tokens.append((kind, value, m.start(kind), m.end()))
            at = m.end()
        self.i = 0

    def peek(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.tokens[k][1].upper() if k < len(self.tokens) and self.tokens[k][0] != "text" else ""

    def take(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def value(self, what: str) -> str:
        if self.i >= len(self.tokens) or self.tokens[self.i][0] == "sign":
            self.fail(f"{what} expected")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def need(self, word: str) -> None:
        if not self.take(word):
            self.fail(f"{word} expected")

    def fail(self, message: str):
        at = self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)
        raise StatementError(message, self.text, at)


def parse(text: str) -> Statement:
    text = text.strip().rstrip(";").strip()
    r = _Reader(text)
    if r.take("EXPLAIN"):
        return Statement("explain", inner=text[r.tokens[0][3] :].strip())
    if r.take("SHOW"):
        return _show(r)
    if r.take("STATE"):
        s = Statement("state", subject=_subject(r))
        r.need("AT")
        s.times.append(r.value("a time"))
    elif r.take("DIFF", "STATE"):
        s = Statement("diff", subject=_subject(r) if r.peek() in ("PROJECT", "SESSION", "WORK_UNIT", "ATTEMPT") else None)
        r.take("BETWEEN")
        s.times.append(r.value("a time"))
        r.take("AND")
        s.times.append(r.value("a time"))
    elif r.take("WHAT", "IS"):
        s = Statement("what_is", subject=_subject(r))
        r.need("DOING")
        r.need("NOW")
    elif r.take("WHY"):
        s = Statement("why", subject=_subject(r))
        if r.take("STATUS", "BLOCKED") or r.take("BLOCKED"):
            s.kind = "blocked"
        else:
            r.need("FAILED")
            s.kind = "failed"
    elif r.take("TRACE"):
        s = Statement("trace", subject=("id", r.value("an id")))
        r.need("CAUSES")
        while r.i < len(r.tokens):
            if r.take("DEPTH"):
                s.depth = _number(r)
            elif r.take("DIRECTION"):
                s.direction = r.value("a direction").lower()
                if s.direction not in ("up", "down", "both"):
                    r.fail("UP, DOWN or BOTH expected")
            else:
                break
    else:
        r.fail("SHOW, WHY, TRACE, STATE, DIFF, WHAT IS or EXPLAIN expected")
    if r.take("AS", "KNOWN", "AT"):
        raise StatementError("AS KNOWN AT is not supported yet")
    if r.i < len(r.tokens):
        r.fail("end of statement expected")
    return s


def _number(r: _Reader) -> int:
    value = r.value("a number")
    if not value.isdigit():
        r.i -= 1
        r.fail("a number expected")
    return int(value)


def _subject(r: _Reader) -> tuple[str, str]:
    kind = r.value("a subject").lower()
    if kind not in ("project", "session", "work_unit", "attempt"):
        r.i -= 1
        r.fail("project, session, work_unit or attempt expected")
    r.take("=")
    return kind, r.value("an id")


def _show(r: _Reader) -> Statement:
    two, one = f"{r.peek()} {r.peek(1)}", r.peek()
    name = two if two in TARGETS else one
    if name not in TARGETS:
        hint = did_you_mean(one, TARGETS)
        r.fail(f"unknown target {one or 'nothing'}" + (f"; did you mean {hint}?" if hint else ""))
    r.i += len(name.split())
    s = Statement("show", TARGETS[name], kind=name.split()[0].lower() if name.endswith(" ATTEMPTS") else "")
    if s.target == "evidence":
        r.need("FOR")
        s.subject = ("id", r.value("an id"))
    while r.i < len(r.tokens):
        if r.take("BETWEEN"):
            ends = []
            for _ in range(2):
                r.need("AGENT")
                r.need("=")
                ends.append(r.value("an agent"))
                r.take("AND")
            if ends[0] == ends[1]:
                r.fail("two different agents expected")
            s.between = (ends[0], ends[1])
        elif r.take("FOR"):
            while True:
                key = r.value("a filter").lower()
                if key not in KEYS:
                    r.i -= 1
                    hint = did_you_mean(key, KEYS)
                    r.fail(f"unknown filter {key}" + (f"; did you mean {hint}?" if hint else ""))
                r.need("=")
                s.filters.append((key, r.value("a value")))
                if not (r.take("AND") or r.take(",")):
                    break
        elif r.take("SINCE"):
            s.filters.append(("since", r.value("a time")))
        elif r.take("UNTIL"):
            s.filters.append(("until", r.value("a time")))
        elif r.take("WHERE"):
            start = r.tokens[r.i][2] if r.i < len(r.tokens) else len(r.text)
            depth = 0
            while r.i < len(r.tokens) and not (depth == 0 and (r.peek() in ("LIMIT", "INCLUDING") or (r.peek() == "ORDER" and r.peek(1) == "BY"))):
                depth += {"(": 1, ")": -1}.get(r.tokens[r.i][1], 0) if r.tokens[r.i][0] == "sign" else 0
                r.i += 1
            s.where = r.text[start : r.tokens[r.i][2] if r.i < len(r.tokens) else len(r.text)].strip()
        elif r.take("ORDER", "BY"):
            column = r.value("a column")
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", column):
                r.fail("a column expected")
            s.order = (column, not r.take("DESC"))
            r.take("ASC")
        elif r.take("LIMIT"):
            s.limit = None if r.take("ALL") else _number(r)
        elif r.take("INCLUDING", "RETRACTED"):
            s.retracted = True
        else:
            r.fail("FOR, WHERE, SINCE, UNTIL, ORDER BY, LIMIT or INCLUDING RETRACTED expected")
    return s
