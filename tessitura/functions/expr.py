"""Scalar functions and predicates as Column expressions."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_id(full_id: Col) -> Column:
    """The track id of ``track`` or ``track:album``."""
    return F.split_part(col(full_id), F.lit(":"), F.lit(1))


def nonempty(value: Col, default: str | Column = "") -> Column:
    """``value`` unless it is null or empty."""
    other = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(col(value), F.lit("")), other)


def clamp(value: Col, low: float, high: float) -> Column:
    return F.least(F.greatest(col(value), F.lit(low)), F.lit(high))


def fold(text: Col) -> Column:
    """Case folding by upper then lower case; unlike a full fold it keeps final sigma and ligatures apart."""
    return F.lower(F.upper(col(text)))


def contains_folded(title: Col, query: str) -> Column:
    """Case-folded substring test; a blank query matches everything."""
    wanted = query.strip()
    return F.contains(fold(title), fold(F.lit(wanted))) if wanted else F.lit(True)


def noise(seed: int | str, key: Col) -> Column:
    """A reproducible number in [0, 1) for a seed and a key; depends on nothing else."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col(key))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(2.0**32)


def clock(seconds: Col) -> Column:
    """``m:ss`` of a number of seconds, rounded down; negative and null are zero."""
    n = F.greatest(F.coalesce(F.floor(col(seconds)), F.lit(0)), F.lit(0)).cast("long")
    return F.concat(F.floor(n / 60).cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"))


def microseconds(seconds: Col) -> Column:
    return (col(seconds) * F.lit(1_000_000)).cast("long")


def round_2(value: Col) -> Column:
    """A number rounded to two digits as its exact binary value demands, ties to even: 2.675 is 2.67, 0.125 is 0.12.

    ``value * 100`` is split in what a double holds and the rest, so that no digit decides wrongly.
    """
    x = col(value)
    wide = x * F.lit(134_217_729.0)
    high = wide - (wide - x)
    low = x - high
    product = x * F.lit(100.0)
    rest = (high * F.lit(100.0) - product) + low * F.lit(100.0)
    whole = F.floor(product).cast("double")
    part = product - whole
    over = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (F.pmod(whole, F.lit(2.0)) == 1.0))))
    return (whole + F.when(over, 1.0).otherwise(0.0)) / F.lit(100.0)


def iso_utc(at: Col) -> Column:
    """A time as ISO-8601 in UTC with microseconds, ``2024-01-01T00:00:00.000000+00:00``; the session's zone has no say."""
    us = F.unix_micros(col(at))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int")), "yyyy-MM-dd")
    rest = F.pmod(us, F.lit(86_400_000_000))
    two = lambda n: F.lpad(n.cast("long").cast("string"), 2, "0")
    clock_ = F.concat_ws(":", two(F.floor(rest / 3_600_000_000)), two(F.floor(rest / 60_000_000) % 60), two(F.floor(rest / 1_000_000) % 60))
    return F.concat(day, F.lit("T"), clock_, F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("+00:00"))


def play_id() -> Column:
    """A new random UUID (version 4) per row."""
    return F.uuid()


def volume_fraction(volume: Col, muted: Col) -> Column:
    return F.when(col(muted), F.lit(0.0)).otherwise(col(volume) / F.lit(100.0))


def account_key(uid: Col) -> Column:
    """Name of an account's partition: the first 32 hex digits of SHA-256."""
    return F.substring(F.sha2(col(uid).cast("string"), 256), 1, 32)


def is_track_id(full_id: Col) -> Column:
    """``digits`` or ``digits:digits``, ASCII digits only."""
    return F.coalesce(col(full_id).rlike("^[0-9]+(:[0-9]+)?$"), F.lit(False))


def _digits() -> str:
    """The ranges of all Unicode digits, by the rule of ``str.isdigit``, as a regular expression takes them."""
    found = [c for c in range(sys.maxunicode + 1) if chr(c).isdigit()]
    first = [c for c in found if not chr(c - 1).isdigit()]
    last = [c for c in found if not chr(c + 1).isdigit()]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first, last, strict=True))


DIGITS = _digits()


def is_entity_id(entity_id: Col) -> Column:
    """Unicode digits of any script, superscripts and the like too."""
    return F.coalesce(col(entity_id).rlike(f"^[{DIGITS}]+\\z"), F.lit(False))


def is_commit_id(text: Col) -> Column:
    return F.coalesce(col(text).rlike("^[0-9a-f]{40}$"), F.lit(False))


class InvalidQuery(ValueError):
    """A search text or type that is not allowed."""


def check_query(text: str, kind: str, kinds: tuple[str, ...] = ("all", "track", "artist", "album")) -> str:
    """The trimmed search text, if it has 1 to 300 characters and the type is known."""
    wanted = text.strip()
    if not wanted or len(wanted) > 300 or kind not in kinds:
        raise InvalidQuery(kind if wanted else "empty")
    return wanted


def allowed_url(uri: Col, hosts: list[str], size: str = "300x300") -> Column:
    """The https form of an address on one of ``hosts``, else an empty text.

    A missing scheme is added and ``%%`` becomes the size. User names, queries, fragments and ports
    other than 443 are refused.
    """
    raw = col(uri)
    full = F.when(F.startswith(raw, F.lit("https://")), raw).otherwise(F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", "")))
    full = F.replace(full, F.lit("%%"), F.lit(size))
    part = lambda name: F.try_parse_url(full, F.lit(name))
    authority = F.regexp_extract(full, "^https://([^/?#]*)", 1)
    port = F.regexp_extract(authority, ":([0-9]*)$", 1)
    good = (
        F.lower(part("HOST")).isin(hosts)
        & ~F.contains(authority, F.lit("@"))
        & ~F.contains(full, F.lit("?"))
        & ~F.contains(full, F.lit("#"))
        & port.isin("", "443")
    )
    return F.when((F.length(raw) > 0) & good, full).otherwise(F.lit(""))


def http_error_class(status: Col, kind: Col) -> Column:
    """Class of a failure from its HTTP status (null if none) and its kind."""
    s, k = col(status), col(kind)
    return (
        F.when(s == 401, "INVALID_ACCOUNT")
        .when(s == 403, "FORBIDDEN")
        .when(k == "bad_request", "REJECTED")
        .when(k == "not_found", "NOT_FOUND")
        .when(s == 429, "RATE_LIMITED")
        .when(s.between(500, 599), "SERVER")
        .when(s.between(400, 499), "CLIENT")
        .when(k == "timeout", "TIMEOUT")
        .when(k == "network", "NETWORK")
        .otherwise("OTHER")
    )


def is_transient(status: Col, kind: Col) -> Column:
    """Failures that one retry may mend: timeouts, some statuses, lost connections that are not about TLS."""
    s, k = col(status), col(kind)
    return F.coalesce((k == "timeout") | s.isin(408, 500, 502, 503, 504) | ((k == "network") & s.isNull()), F.lit(False))


def is_truncated(got: Col, expected: Col) -> Column:
    """Both lengths known, the medium under 95 % of what was expected and over five seconds short."""
    v, e = col(got), col(expected)
    return F.coalesce((v != 0) & (e != 0) & (v < 0.95 * e) & (e - v > 5), F.lit(False))


def playback_status(error: Col, loading: Col, current: Col, stopped: Col, paused: Col, buffering: Col) -> Column:
    """The first that holds: error, loading, empty, stopped, paused, buffering; else playing."""
    return (
        F.when(col(error), "error").when(col(loading), "loading").when(col(current).isNull(), "empty")
        .when(col(stopped), "stopped").when(col(paused), "paused").when(col(buffering), "buffering").otherwise("playing")
    )


def label(value: Col, names: dict[str, str]) -> Column:
    """A text for a code, empty for an unknown one."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(value)), F.lit(""))


def present(pairs: dict[str, Column]) -> Column:
    """A map of the values that are not null."""
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
