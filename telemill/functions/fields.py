"""Row-level column functions for the three signals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------------------------
# Codes and their names.
STATUS_UNSET, STATUS_OK, STATUS_ERROR = 0, 1, 2
STATUS_NAMES = {1: "ok", 2: "error"}
KIND_NAMES = {0: "unspecified", 1: "internal", 2: "server", 3: "client", 4: "producer", 5: "consumer"}
METRIC_TYPE_NAMES = {1: "gauge", 2: "counter", 3: "histogram", 4: "summary"}
SEVERITY_FLOORS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}
SEVERITY_ALIASES = {"WARNING": 13}

# What is looked for in a log body, as (field, pattern, group).  Word boundaries and
# white space are spelled out in ASCII because Java's shorthands differ there.
BODY_PATTERNS = (
    ("http_method", r"(?iu)(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)[\t\n\f\r ]+/", 1),
    ("http_status", r"(?<![0-9A-Za-z_])HTTP[/ ][0-9.]+[\t\n\f\r ]+([0-9]{3})(?![0-9A-Za-z_])", 1),
    ("error_type", r"([A-Z][a-zA-Z]+Error|[A-Z][a-zA-Z]+Exception):", 1),
    ("duration_ms", r"duration[=:\t\n\f\r ]+([0-9.]+)[\t\n\f\r ]*ms", 1),
    ("user_id", r"user[_\t\n\f\r ]?id[=:\t\n\f\r ]+([0-9]+)", 1),
)

# 64-bit FNV-1a.  The prime is 2**40 + 435.
FNV_BASIS_HIGH, FNV_BASIS_LOW = 0xCBF29CE4, 0x84222325
FNV_PRIME_LOW = 435
# ---------------------------------------------------------------------------------------------

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_LOWER = _ASCII_UPPER.lower()
_LOW32 = 0xFFFFFFFF


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _named(code: Column, names: Mapping[int, str], default: str) -> Column:
    out = None
    for value, name in names.items():
        out = (F if out is None else out).when(code == value, F.lit(name))
    return out.otherwise(F.lit(default))


def status_name(code: Column | str) -> Column:
    return _named(_col(code), STATUS_NAMES, "unset")


def kind_name(code: Column | str) -> Column:
    return _named(_col(code), KIND_NAMES, "unspecified")


def metric_type_name(code: Column | str) -> Column:
    return _named(_col(code), METRIC_TYPE_NAMES, "unspecified")


def severity_name(code: Column | str) -> Column:
    """Name of the band a severity number falls into."""
    code = _col(code)
    out = None
    for name, floor in sorted(SEVERITY_FLOORS.items(), key=lambda kv: -kv[1]):
        out = (F if out is None else out).when(code >= floor, F.lit(name))
    return out.otherwise(F.lit("UNSPECIFIED"))


def parse_severity(level: Column | str) -> Column:
    """Severity number of a level name written all upper or all lower case; 0 for anything else."""
    level = _col(level)
    out = None
    for name, code in {**SEVERITY_FLOORS, **SEVERITY_ALIASES}.items():
        out = (F if out is None else out).when(level.isin(name, name.lower()), F.lit(code))
    return out.otherwise(F.lit(0))


def is_missing(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("")) == ""


def is_root(parent_span_id: Column | str = "parent_span_id") -> Column:
    return is_missing(parent_span_id)


def has_error(status: Column | str = "status") -> Column:
    return F.coalesce(_col(status) == STATUS_ERROR, F.lit(False))


def is_error_log(severity: Column | str = "severity") -> Column:
    return F.coalesce(_col(severity) >= SEVERITY_FLOORS["ERROR"], F.lit(False))


def has_trace(trace_id: Column | str = "trace_id") -> Column:
    return ~is_missing(trace_id)


def safe_div(num: Column, den: Column) -> Column:
    """0 where the denominator is 0; a plain ``/`` raises there under ANSI mode."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def ascii_lower(c: Column | str) -> Column:
    return F.translate(_col(c), _ASCII_UPPER, _ASCII_LOWER)


def normalize_service_name(name: Column | str) -> Column:
    return F.translate(F.lower(_col(name)), "/ _", "---")


def add_attribute(attrs: Column, key: str, value: str) -> Column:
    """Add ``key`` unless it is there; a null map stays null."""
    return F.when(F.map_contains_key(attrs, key), attrs).otherwise(
        F.map_concat(attrs, F.create_map(F.lit(key), F.lit(value)))
    )


def remove_attribute(attrs: Column, key: str) -> Column:
    return F.map_filter(attrs, lambda k, _: k != key)


def rename_attribute(attrs: Column, key: str, new_key: str) -> Column:
    """Move a value to ``new_key``, replacing what was there; renaming a key to itself changes nothing."""
    if key == new_key:
        return attrs
    moved = F.map_concat(
        F.map_filter(attrs, lambda k, _: ~k.isin(key, new_key)),
        F.create_map(F.lit(new_key), F.element_at(attrs, key)),
    )
    return F.when(F.map_contains_key(attrs, key), moved).otherwise(attrs)


def hash_attribute(attrs: Column, key: str) -> Column:
    """Replace the value of ``key`` by its 64-bit FNV-1a hash in hex, not padded."""
    return F.when(
        F.map_contains_key(attrs, key),
        F.transform_values(attrs, lambda k, v: F.when(k == key, fnv1a_hex(v)).otherwise(v)),
    ).otherwise(attrs)


def fnv1a_hex(text: Column | str) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, lower-case hex without padding.

    The hash is kept as two 32-bit halves in longs, so no step overflows: with prime 2**40 + 435 and
    h = high * 2**32 + low, the product modulo 2**64 has low half ``low * 435`` and high half
    ``high * 435 + carry + (low << 8)``.
    """
    text = _col(text)
    # Read as ISO-8859-1 the UTF-8 bytes become characters of the same code, split once in linear time.
    chars = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    chars = F.when(F.octet_length(text) > 0, chars).otherwise(F.array().cast("array<string>"))

    def step(state: Column, char: Column) -> Column:
        mixed = state["low"].bitwiseXOR(F.ascii(char).cast("bigint"))
        low = mixed * FNV_PRIME_LOW
        high = state["high"] * FNV_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(mixed, 8)
        return F.struct(
            high.bitwiseAND(F.lit(_LOW32)).alias("high"),
            low.bitwiseAND(F.lit(_LOW32)).alias("low"),
        )

    basis = F.struct(F.lit(FNV_BASIS_HIGH).alias("high"), F.lit(FNV_BASIS_LOW).alias("low"))
    basis = basis.cast("struct<high: bigint, low: bigint>")

    def finish(state: Column) -> Column:
        low_hex = F.lower(F.hex(state["low"]))
        return F.when(
            state["high"] > 0, F.concat(F.lower(F.hex(state["high"])), F.lpad(low_hex, 8, "0"))
        ).otherwise(low_hex)

    return F.when(text.isNotNull(), F.aggregate(chars, basis, step, finish))


def extract_body_fields(body: Column | str) -> Column:
    """Structured fields found in a log body; keys without a match are left out."""
    body = _col(body)
    pairs = []
    for field, pattern, group in BODY_PATTERNS:
        pairs += [F.lit(field), F.regexp_extract(body, pattern, group)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "")


def label(labels: Column | str, key: str) -> Column:
    """Label value; a missing key reads as the empty string."""
    return F.coalesce(_col(labels)[key], F.lit(""))


def sorted_labels(labels: Column | str = "labels") -> Column:
    """Label entries sorted by key: equal for equal label sets, and unlike a map it can be ordered,
    joined and windowed on.  No labels and null labels are the same empty set."""
    none = F.array().cast("array<struct<key: string, value: string>>")
    return F.coalesce(F.sort_array(F.map_entries(_col(labels))), none)


#: Label under which a vector's series carries the service.
SERVICE_LABEL = "__service__"


def service_series(labels: Column | str = "labels", service: str = "service_name") -> Column:
    """Label entries sorted by key, then the service, as one series key."""
    own = F.struct(F.lit(SERVICE_LABEL).alias("key"), F.coalesce(service, F.lit("")).alias("value"))
    return F.array_append(sorted_labels(labels), own)


def series_key(labels: Column | str = "labels") -> Column:
    """Canonical text of a label set: JSON with sorted keys."""
    return F.to_json(F.map_from_entries(sorted_labels(labels)))


MATCH_OPERATORS = ("=", "!=", "=~", "!~")


def matches_label(labels: Column | str, key: str, op: str, value: str) -> Column:
    """One label matcher; regular expressions must match the whole value."""
    got = label(labels, key)
    if op == "=":
        return got == value
    if op == "!=":
        return got != value
    whole = rf"\A(?:{value})\z"
    if op == "=~":
        return got.rlike(whole)
    if op == "!~":
        return ~got.rlike(whole)
    raise ValueError(f"unknown matcher operator {op!r}; use one of {MATCH_OPERATORS}")


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """``value <operator> threshold`` with the operator in a column; unknown operators are false."""
    return (
        F.when(operator == ">", value > threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<", value < threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator.isin("==", "="), value == threshold)
        .when(operator == "!=", value != threshold)
        .otherwise(F.lit(False))
    )


def contains_ignoring_ascii_case(body: Column | str, keyword: str) -> Column:
    """Literal substring, folding A-Z only (``lower()`` would also fold accented letters)."""
    body = _col(body)
    if not any(ch.isascii() and ch.isalpha() for ch in keyword):
        return body.contains(keyword)
    # Java folds ASCII only unless asked otherwise; every other ASCII character is taken literally.
    literal = "".join(ch if ch.isalnum() or not ch.isascii() else "\\" + ch for ch in keyword)
    return body.rlike(f"(?i){literal}")
