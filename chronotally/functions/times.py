"""Time expressions of the statement language."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def parse_time(text: str, now: datetime) -> datetime:
    """RFC 3339, a date (its midnight UTC), epoch seconds, now, today, yesterday, or an offset such as -15m; always UTC."""
    text = text.strip().strip("'\"")
    now = now.astimezone(timezone.utc) if now.tzinfo else now.replace(tzinfo=timezone.utc)
    if text == "now":
        return now
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if text in ("today", "yesterday"):
        return midnight - timedelta(days=text == "yesterday")
    if m := re.fullmatch(r"-(\d+)([smhdw])", text):
        return now - timedelta(**{UNITS[m[2]]: int(m[1])})
    if re.fullmatch(r"\d{9,}", text):
        number = int(text)
        while number > 10**11:  # milliseconds or microseconds
            number /= 1000
        return datetime.fromtimestamp(number, timezone.utc)
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"not a time: {text!r}") from None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
