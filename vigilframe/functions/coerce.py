"""Alias-tolerant field access on raw JSON events, and validity tests.

A raw event is parsed into a struct of two views of the same fields: ``t`` holds every field
as text, ``n`` only those that are JSON numbers. Two typed parses that Spark prunes to the
fields in use are several times cheaper than asking a VARIANT for the type of each field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The field aliases producers use, in order of preference.
TS_FIELDS = ("timestamp", "ts", "time", "@timestamp")
IP_FIELDS = ("src_ip", "source_ip", "ip_src", "attacker_ip")
PORT_FIELDS = ("dst_port", "destination_port", "port", "dest_port")
PROTO_FIELDS = ("proto", "protocol", "protocol_name")
LABEL_FIELDS = ("label", "category", "status", "level")
ATTACK_SEVERITIES = ("ALERT", "CRITICAL", "HIGH")
MILLISECOND_EPOCH = 1_000_000_000_000
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799

_ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}([.]{_OCTET}){{3}}"
_HEX = r"[0-9a-fA-F]{1,4}"


def _v6_pattern() -> str:
    """Every place one ``::`` may stand among eight groups, the last two maybe dotted."""
    full = [rf"({_HEX}:){{7}}{_HEX}", rf"({_HEX}:){{6}}{_V4}"]
    gaps = []
    for left in range(8):
        head = rf"({_HEX}(:{_HEX}){{{left - 1}}})" if left else ""
        most = 7 - left
        gaps.append(rf"{head}::({_HEX}(:{_HEX}){{0,{most - 1}}})?" if most else rf"{head}::")
        if most >= 2:
            gaps.append(rf"{head}::({_HEX}:){{0,{most - 2}}}{_V4}")
    return "^(" + "|".join(full + gaps) + r")(%[^%/]+)?$"


V4_PATTERN = rf"^{_V4}$"
V6_PATTERN = _v6_pattern()


_NUMERIC = (*TS_FIELDS, *IP_FIELDS, *PORT_FIELDS, *PROTO_FIELDS)
_TEXTS = (*dict.fromkeys((*_NUMERIC, *LABEL_FIELDS, "severity", "is_attack", "source", "destination")),)
BROKEN = "_broken"
TEXT_SCHEMA = ", ".join(f"`{name}` string" for name in (*_TEXTS, BROKEN))
NUMBER_SCHEMA = ", ".join(f"`{name}` double" for name in _NUMERIC)


def parsed(raw: Column) -> Column:
    """The event struct; NULL when the text is not a JSON object."""
    text_view = F.from_json(raw, TEXT_SCHEMA, {"columnNameOfCorruptRecord": BROKEN})
    both = F.struct(text_view.alias("t"), F.from_json(raw, NUMBER_SCHEMA).alias("n"))
    return F.when(F.ltrim(raw).startswith("{") & text_view[BROKEN].isNull(), both)


def _text(event: Column, name: str) -> Column:
    return event["t"][name]


def _number(event: Column, name: str) -> Column:
    return event["n"][name]


def text(event: Column, name: str) -> Column:
    """The field when it is a non-empty JSON string."""
    value = _text(event, name)
    return F.when((value != "") & _number(event, name).isNull(), value)


def truthy_text(event: Column, name: str) -> Column:
    """Any field value as text, NULL when missing, null or empty."""
    value = _text(event, name)
    return F.when(value != "", value)


def _nested(event: Column, name: str, inner: str) -> Column:
    whole = _text(event, name)
    value = F.when(whole.startswith("{"), F.get_json_object(whole, f"$.{inner}"))
    return F.when(value != "", value)


def parse_time(value: Column) -> Column:
    """ISO-8601 or ``Y-m-d H:M:S`` text as a UTC time without zone; NULL otherwise."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(_ISO), trimmed.try_cast("timestamp")).cast("timestamp_ntz")


def epoch_time(seconds: Column) -> Column:
    """Epoch seconds or milliseconds as a UTC time; NULL beyond the years 1 to 9999."""
    scaled = F.when(seconds > MILLISECOND_EPOCH, seconds / 1000).otherwise(seconds)
    inside = F.when((scaled >= FIRST_SECOND) & (scaled <= LAST_SECOND), scaled)
    return F.timestamp_micros((inside * 1_000_000).try_cast("bigint")).cast("timestamp_ntz")


def event_time(event: Column, default: Column) -> Column:
    """First usable time field; numbers are epoch seconds or milliseconds."""
    usable = [
        F.coalesce(epoch_time(_number(event, n)), parse_time(text(event, n))) for n in TS_FIELDS
    ]
    return F.coalesce(*usable, default)


def source_ip(event: Column) -> Column:
    return F.coalesce(*[text(event, n) for n in IP_FIELDS], _nested(event, "source", "ip"))


def destination_port(event: Column) -> Column:
    """Whole JSON numbers, or text of digits."""
    def port(name: str) -> Column:
        value = _text(event, name)
        whole = _number(event, name).isNotNull() & value.rlike("^-?[0-9]+$")
        return F.when(whole | value.rlike("^[0-9]+$"), value)

    return F.coalesce(*[port(n) for n in PORT_FIELDS], _nested(event, "destination", "port"))


def protocol(event: Column) -> Column:
    return F.coalesce(*[F.upper(text(event, n)) for n in PROTO_FIELDS], F.lit("UNKNOWN"))


def attack_words(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return low.contains("attack") | low.contains("malicious")


def is_attack(flag: Column, label: Column, severity: Column) -> Column:
    """Truthy flag, a label that names an attack, or an alarming severity."""
    loud = F.upper(F.coalesce(severity, F.lit(""))).isin(*ATTACK_SEVERITIES)
    return F.coalesce(flag, F.lit(False)) | attack_words(label) | loud


def raw_is_attack(event: Column) -> Column:
    label = F.coalesce(*[truthy_text(event, n) for n in LABEL_FIELDS])
    flag = _text(event, "is_attack").try_cast("boolean")
    return is_attack(flag, label, truthy_text(event, "severity"))


def is_valid_ip(ip: Column) -> Column:
    """NULL is allowed; otherwise a v4 or v6 address."""
    return ip.isNull() | F.when(ip.contains(":"), ip.rlike(V6_PATTERN)).otherwise(ip.rlike(V4_PATTERN))


def severity_weight(*candidates: Column) -> Column:
    """Weight of the first non-empty level: INFO 1, WARNING 3, ALERT 5, others 1."""
    level = F.upper(F.trim(first_text(*candidates)))
    return F.when(level == "ALERT", 5).when(level == "WARNING", 3).otherwise(1)


def first_text(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in candidates])
