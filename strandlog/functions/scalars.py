"""Column expressions: bytes, checksums, type ids, timestamps in text, JSON look-ups, classification and rendering."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A record's time is the first of these fields that is there and can be read.
CANDIDATES = ("ts", "time", "timestamp", "created_at")
LABELS = {"lines": "lines_v1", "ndjson": "ndjson_v1", "lines+json": "ndjson_v1", "json": "json_v1", "csv": "csv_v1", "len4": "bytes_v1", "raw": "bytes_v1"}
CONTROL_TYPE, SNIPPET = 0xFFFFFF00, 4096
_BLANK = r"[ \t\n\x0B\f\r]"


def little(x: Column, size: int) -> Column:
    """The low `size` bytes of a long, least first."""
    h = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * k, 2) for k in range(size))))


def from_little(b: Column, size: int) -> Column:
    """A long from `size` bytes, least first."""
    h = F.hex(b)
    return F.conv(F.concat(*(F.substring(h, 2 * size - 1 - 2 * k, 2) for k in range(size))), 16, -10).cast("long")


def frame_crc(type_id: Column, ts_ns: Column, payload: Column) -> Column:
    """The checksum that a frame carries: of its type, time and payload."""
    return F.crc32(F.concat(little(type_id, 4), little(ts_ns, 8), payload.cast("binary")))


def fnv1a(label: Column) -> Column:
    """FNV-1a, 32 bits, over the label's UTF-8 bytes."""
    h = F.hex(F.encode(label, "UTF-8"))
    at = F.sequence(F.lit(1), F.length(h) - 1, F.lit(2))
    byte = lambda k: F.conv(F.substr(h, k, F.lit(2)), 16, 10).cast("long")
    step = lambda a, k: (a.bitwiseXOR(byte(k)) * 16777619).bitwiseAND(F.lit(4294967295))
    return F.when(F.length(h) == 0, F.lit(2166136261)).otherwise(F.aggregate(at, F.lit(2166136261).cast("long"), step))


def fnv1a_of(label: str) -> int:
    h = 2166136261
    for b in label.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def trimmed(s: Column) -> Column:
    """Without white space of any ASCII kind at either end."""
    return F.regexp_replace(s, f"^{_BLANK}+|{_BLANK}+$", "")


def unix_numeric(s: Column) -> Column:
    """Nanoseconds from a leading integer: one of 19 characters or more is in nanoseconds, any other in milliseconds."""
    n = F.regexp_extract(s, rf"^{_BLANK}*([+-]?[0-9]+)", 1)
    v = n.try_cast("long")
    return F.when(F.length(n) >= 19, v).otherwise(v * 1000000)


def rfc3339(s: Column) -> Column:
    """Nanoseconds from YYYY-MM-DDTHH:MM:SS[.fraction][Z or offset]; without an offset it is UTC; null if it isn't one."""
    whole = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]+))?([Zz]|[+-][0-9]{2}:[0-9]{2})?$"
    part = lambda k: F.regexp_extract(s, whole, k)
    second = F.unix_seconds(F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    fraction = F.rpad(F.substring(part(3), 1, 9), 9, "0").cast("long")
    zone = part(4)
    minutes = F.substring(zone, 2, 2).cast("long") * 60 + F.substring(zone, 5, 2).cast("long")
    shift = F.when(zone.startswith("+"), minutes).when(zone.startswith("-"), -minutes).otherwise(F.lit(0))
    return F.when(s.rlike(whole), (second - shift * 60) * 1000000000 + F.coalesce(fraction, F.lit(0)))


def timestamp_field(v: Column) -> Column:
    """A JSON value's time: a quoted one as RFC 3339 only, else as a number."""
    t = trimmed(v)
    return F.when(t.startswith('"'), rfc3339(F.regexp_extract(t, '^"([^"]*)"$', 1))).otherwise(unix_numeric(t))


def json_value(json: Column, field: str) -> Column:
    """The text of a field's value, quotes included, where the field first stands, nested or not; null if it isn't there or its string doesn't end."""
    pattern = rf'"{re.escape(field)}"{_BLANK}*:{_BLANK}*("(?:[^"\\]|\\.)*"|(?!")[^,}}\] \t\n\r]+)'
    v = F.regexp_extract(json, pattern, 1)
    return F.when(F.length(v) > 0, v)


def first_time(json: Column, candidates: tuple[str, ...] = CANDIDATES) -> Column:
    return F.coalesce(*(timestamp_field(json_value(json, c)) for c in candidates))


def or_now(ts_ns: Column, now_ns: int) -> Column:
    """The time of arrival, given, where none was read or it is 0."""
    return F.when(ts_ns.isNull() | (ts_ns == 0), F.lit(now_ns)).otherwise(ts_ns)


def whole(a: Column, n: int) -> Column:
    """a divided by n without a remainder; a double would round nanoseconds."""
    return F.call_function("div", a, F.lit(n))


def human(ts_ns: Column) -> Column:
    """UTC with milliseconds, whatever the session's zone; NONE for 0."""
    ms = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(whole(ts_ns, 1000000).cast("decimal(18,0)") / 1000).cast("decimal(18,6)"))
    return F.when(ts_ns == 0, F.lit("NONE")).otherwise(F.date_format(ms, "yyyy-MM-dd HH:mm:ss.SSS"))


def parse_time(text: str | int) -> int:
    """A time given to replay: integer nanoseconds, or ISO 8601 of at least 19 characters; nothing before 1970."""
    s = str(text).strip()
    if re.fullmatch(r"[+-]?[0-9]+", s):
        return int(s)
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)?", s)
    if not m:
        raise ValueError(f"not a time: {text!r}")
    at = datetime.fromisoformat(f"{m[1]}T{m[2]}").replace(tzinfo=timezone.utc)
    if m[4] and m[4] != "Z":
        shift = timedelta(hours=int(m[4][1:3]), minutes=int(m[4][4:6]))
        at -= shift if m[4][0] == "+" else -shift
    ns = int(at.timestamp()) * 10**9 + int((m[3] or "0")[:9].ljust(9, "0"))
    if ns < 0:
        raise ValueError(f"before 1970: {text!r}")
    return ns


def contains_any(s: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(s, F.lit(p))
    return out


def is_control(payload: Column) -> Column:
    """Whether a payload looks like a control record: blank, or a JSON object with the keys of one. The type isn't looked at."""
    keys = lambda *names: contains_any(payload, tuple(f'"{n}"' for n in names))
    schema = keys("schema_version") & keys("format", "type_label", "fallback_mode", "run_id", "status")
    run = keys("run_id") & keys("start_ts", "end_ts", "status")
    return payload.rlike(rf"^{_BLANK}*\z") | (payload.rlike(rf"^{_BLANK}*\{{") & (schema | run))


def kind(payload: Column) -> Column:
    return F.when(is_control(payload), F.lit("CONTROL")).otherwise(F.lit("DATA"))


def kind_by_type(type_id: Column) -> Column:
    return F.when(type_id >= CONTROL_TYPE, F.lit("CONTROL")).otherwise(F.lit("DATA"))


def snippet(payload: Column, cap: int | None = SNIPPET) -> Column:
    """One line of text: line ends as spaces, other control characters as \\xNN, cut at `cap` characters."""
    s = F.translate(payload, "\n\r", "  ")
    for c in [*range(9), 11, 12, *range(14, 32), 127]:
        s = F.replace(s, F.lit(chr(c)), F.lit(f"\\x{c:02x}")) if c else F.regexp_replace(s, "\\x00", r"\\x00")
    return F.substring(s, 1, cap) if cap else s


def json_text(s: Column) -> Column:
    """A JSON string literal."""
    s = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(c), F.lit(e))
    for c in [*range(1, 8), 11, *range(14, 32)]:
        s = F.replace(s, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.concat(F.lit('"'), s, F.lit('"'))


_UNITS = {"size": {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}, "time": {"s": 1, "m": 60, "h": 3600}, "records": {"k": 1000, "m": 1000000}}


def literal(text: str, unit: str) -> int:
    """A size, time or record count with an optional suffix; off and 0 are 0."""
    s = text.strip().lower()
    if s in ("off", "0"):
        return 0
    m = re.fullmatch(r"([0-9]+)([a-z]?)", s)
    if not m or (m[2] and m[2] not in _UNITS[unit]):
        raise ValueError(f"not a {unit}: {text!r}")
    n = int(m[1]) * _UNITS[unit].get(m[2], 1)
    if n >= 1 << 63:
        raise ValueError(f"too large: {text!r}")
    return n


def rotate_clause(text: str) -> dict[str, int]:
    """size=, time=, records= or recs=, by commas; a bare value is records; off and none switch rotation off."""
    out = {"size": 0, "time": 0, "records": 0}
    if text.strip().lower() in ("off", "none"):
        return out
    for part in text.split(","):
        name, eq, value = part.partition("=")
        name = {"recs": "records"}.get(name.strip().lower(), name.strip().lower()) if eq else "records"
        if name not in out:
            raise ValueError(f"unknown rotation: {part!r}")
        out[name] = literal(value if eq else part, name)
    return out
