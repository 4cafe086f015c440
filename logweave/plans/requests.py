"""Request parameters, range edges and page cursors: small driver-side helpers."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import hmac
import json
import re
import struct
from collections.abc import Mapping
from dataclasses import dataclass, field

from logweave.errors import EngineError
from logweave.schema import LEVELS

BUCKETS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}
INSTANT = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)")
MINUTE_US = 60_000_000

#: What a caller is told of a request that can't be answered.
NO_INSTANT = "{name} must be a valid ISO 8601 timestamp"
NOT_ONCE = "{name} must be specified once"
NULL_CHARACTER = "{name} contains an unsupported null character"
NO_LEVEL = "unsupported log level"
BACKWARDS = "until must not be earlier than since"
NO_KEY = "attribute filter key is invalid"
NO_VALUE = "attr.{key} requires a value"
LIMIT_TEXT = "limit must be an integer"
LIMIT_RANGE = "limit must be between 1 and 1000"
NO_RANGE = "since and until are required"
NO_BUCKET = "bucket must be one of 1m, 5m, 1h, or 1d"
NO_GROUP = "group_by must be service or level"
NO_CURSOR = "invalid cursor"
NO_SIGNATURE = "invalid cursor signature"
BAD_CURSOR = "malformed cursor"
OTHER_CURSOR = "cursor does not match the active filters"


@dataclass(frozen=True)
class Filters:
    service: str | None = None
    level: str | None = None
    since: str | None = None
    until: str | None = None
    q: str | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)


def nanoseconds(text: str, name: str) -> int:
    """Nanoseconds since 1970 of an ISO 8601 instant with an offset."""
    bad = EngineError(400, NO_INSTANT.format(name=name))
    m = INSTANT.fullmatch(text)
    if not m:
        raise bad
    try:
        at = dt.datetime(*map(int, m.groups()[:6]), tzinfo=dt.timezone.utc)
        zone = m[8]
        shift = 0 if zone == "Z" else (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 3600 + int(zone[4:]) * 60)
        if zone != "Z" and (int(zone[1:3]) > 23 or int(zone[4:]) > 59):
            raise bad
    except ValueError:
        raise bad from None
    seconds = (at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(seconds=1) - shift
    return seconds * 10**9 + int((m[7] or "").ljust(9, "0"))


def microseconds(text: str, name: str = "timestamp") -> int:
    """Microseconds, half to even: one rounding rule for rows, ranges and cursors."""
    whole, part = divmod(nanoseconds(text, name), 1000)
    return whole + (part > 500 or part == 500 and whole % 2)


def one(query: Mapping[str, object], name: str) -> str | None:
    value = query.get(name)
    if value is not None and not isinstance(value, str):
        raise EngineError(400, NOT_ONCE.format(name=name))
    if value is not None and "\0" in value:
        raise EngineError(400, NULL_CHARACTER.format(name=name))
    return value


def parse_filters(query: Mapping[str, object]) -> Filters:
    """Known parameters only; others are ignored."""
    level = one(query, "level")
    if level is not None and level not in LEVELS:
        raise EngineError(400, NO_LEVEL)
    since, until = one(query, "since"), one(query, "until")
    bounds = [nanoseconds(v, n) if v is not None else None for v, n in ((since, "since"), (until, "until"))]
    if None not in bounds and bounds[1] < bounds[0]:
        raise EngineError(400, BACKWARDS)
    attributes = {}
    for name in query:
        if name.startswith("attr."):
            key = name[5:]
            if not key or "\0" in key:
                raise EngineError(400, NO_KEY)
            attributes[key] = one(query, name)
            if attributes[key] is None:
                raise EngineError(400, NO_VALUE.format(key=key))
    return Filters(one(query, "service"), level, since, until, one(query, "q"), attributes)


def parse_limit(query: Mapping[str, object]) -> int:
    text = one(query, "limit")
    if text is None:
        return 100
    if not re.fullmatch(r"[0-9]+", text):
        raise EngineError(400, LIMIT_TEXT)
    if not 1 <= int(text) <= 1000:
        raise EngineError(400, LIMIT_RANGE)
    return int(text)


def parse_aggregate(query: Mapping[str, object]) -> tuple[Filters, str, str | None]:
    """(filters, bucket, group)."""
    filters = parse_filters(query)
    if filters.since is None or filters.until is None:
        raise EngineError(400, NO_RANGE)
    bucket, group = one(query, "bucket"), one(query, "group_by")
    if bucket not in BUCKETS:
        raise EngineError(400, NO_BUCKET)
    if group not in (None, "service", "level"):
        raise EngineError(400, NO_GROUP)
    return filters, bucket, group


def edge_slices(since_us: int, until_us: int, unit_us: int = MINUTE_US) -> tuple[int, int, bool, bool]:
    """(first whole unit, end of the last whole unit, is there a left edge, a right edge)."""
    first, last = -(-since_us // unit_us) * unit_us, until_us // unit_us * unit_us
    return first, last, since_us < first, last < until_us


def whole_cells(since_us: int, until_us: int, bucket: str, units: tuple[str, ...]) -> list[tuple[str | None, list[tuple[int, int]]]]:
    """A half-open range as ranges of whole cells, largest unit first, then (None) the ranges that only rows can answer.

    A unit is used if the bucket consists of whole cells of it; larger cells fill the middle, smaller ones what is left at both ends.
    """
    usable = sorted((BUCKETS[u], u) for u in units if BUCKETS[bucket] % BUCKETS[u] == 0)
    left, out = [(since_us, until_us)] if since_us < until_us else [], []
    for seconds, unit in reversed(usable):
        whole, rest = [], []
        for low, high in left:
            first, last, *_ = edge_slices(low, high, seconds * 1_000_000)
            if first < last:
                whole.append((first, last))
                rest += [(a, b) for a, b in ((low, first), (last, high)) if a < b]
            else:
                rest.append((low, high))
        left = rest
        if whole:
            out.append((unit, whole))
    return out + ([(None, left)] if left else [])


def filter_hash(filters: Filters) -> str:
    """What a cursor is bound to: all filters, not the page size."""
    names = ("service", "level", "since", "until", "q")
    canonical = json.dumps([[n, getattr(filters, n)] for n in names] + sorted(filters.attributes.items()), ensure_ascii=False)
    return base64.urlsafe_b64encode(hashlib.sha256(canonical.encode()).digest()).decode()[:22]


#: A cursor's place: its form, microseconds and id; the filters that it is bound to follow.
PLACE, FORM = struct.Struct(">Bqq"), 2


class CursorCodec:
    """Signed page cursors."""

    def __init__(self, secret: bytes):
        self.secret = secret

    def sign(self, body: str) -> str:
        return base64.urlsafe_b64encode(hmac.new(self.secret, body.encode(), hashlib.sha256).digest()).decode()[:22]

    def encode(self, timestamp_us: int, row_id: int, filters: str) -> str:
        body = base64.urlsafe_b64encode(PLACE.pack(FORM, timestamp_us, row_id) + filters.encode()).decode().rstrip("=")
        return f"{body}.{self.sign(body)}"

    def decode(self, cursor: str, filters: str) -> tuple[int, int]:
        parts = cursor.split(".")
        if len(parts) != 2 or not all(parts) or not cursor.isascii():
            raise EngineError(400, NO_CURSOR)
        if not hmac.compare_digest(parts[1], self.sign(parts[0])):
            raise EngineError(400, NO_SIGNATURE)
        try:
            found = base64.urlsafe_b64decode(parts[0] + "=" * (-len(parts[0]) % 4))
            form, at, row_id = PLACE.unpack(found[: PLACE.size])
            own = found[PLACE.size :].decode()
            if form != FORM:
                raise ValueError
        except (ValueError, struct.error):
            raise EngineError(400, BAD_CURSOR) from None
        if own != filters:
            raise EngineError(400, OTHER_CURSOR)
        return at, row_id
