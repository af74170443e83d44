"""Detection-log lines: parsing both known layouts and writing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.functions.coerce import parse_time

# Fixed pattern: the line layout with addresses (case-insensitive).
FULL_LINE = (
    r"(?i)^\[([^\]]+)\]\s*(.+?)\|\s*Src\s+IP:\s*([^\s|]+)?\s*\|\s*Src\s+Port:\s*(\d+)"
    r"\s*\|\s*Dst\s+IP:\s*([^\s|]+)?\s*\|\s*Dst\s+Port:\s*(\d+)"
)


_MARK = "\x01"


def matches_full(line: Column) -> Column:
    return line.rlike(FULL_LINE)


def full_parts(line: Column) -> Column:
    """The six groups of a line that carries addresses, from one pattern match; else NULL."""
    joined = F.regexp_replace(line, "(?s)" + FULL_LINE + ".*$", _MARK.join(f"${i}" for i in range(1, 7)) + _MARK)
    parts = F.split(joined, _MARK)
    return F.when(F.size(parts) == 7, parts)


def full_fields(parts: Column) -> dict[str, Column]:
    """Typed fields of :func:`full_parts`."""
    def part(index: int) -> Column:
        value = F.get(parts, F.lit(index))
        return F.when(value != "", value)

    return {
        "timestamp": parse_time(part(0)),
        "traffic_type": F.trim(part(1)),
        "src_ip": part(2),
        "src_port": part(3).try_cast("int"),
        "dst_ip": part(4),
        "dst_port": part(5).try_cast("int"),
    }


def _labelled_port(line: Column, label: str) -> Column:
    digits = F.regexp_extract(line, label + r":\s*(\d+)", 1)
    return F.when(digits != "", digits).try_cast("int")


def legacy_fields(line: Column) -> dict[str, Column]:
    """Fields of the older layout: no addresses, two time formats."""
    stamp = F.when(line.startswith("["), F.regexp_extract(line, r"^\[([^\]]*)\]", 1))
    known = stamp.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$") | stamp.rlike(
        r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"
    )
    rest = F.regexp_replace(line, r"(?s)^[^\]]*\]", "")
    return {
        "timestamp": F.when(known, parse_time(F.regexp_replace(stamp, "/", "-"))),
        "traffic_type": F.trim(
            F.when(line.contains("]"), F.substring_index(rest, "|", 1)).otherwise(line)
        ),
        "src_ip": F.lit(None).cast("string"),
        "src_port": _labelled_port(line, "Src Port"),
        "dst_ip": F.lit(None).cast("string"),
        "dst_port": _labelled_port(line, "Dst Port"),
    }


def category(traffic_type: Column) -> Column:
    return F.when(F.lower(traffic_type).contains("attack"), "attack").otherwise("normal")


def detection_line(
    ts: Column, attack: Column, src_ip: Column, src_port: Column, dst_port: Column
) -> Column:
    """The line the detector writes for a scored packet."""
    stamp = F.date_format(ts, "'['yyyy-MM-dd HH:mm:ss']'")
    ports = F.concat(
        F.lit("Src Port: "), src_port.cast("string"), F.lit(" | Dst Port: "), dst_port.cast("string")
    )
    alarm = F.concat(
        F.lit("⚠️ [ATTACK DETECTED] Src IP: "), F.coalesce(src_ip, F.lit("Unknown")), F.lit(" | "), ports
    )
    calm = F.concat(F.lit("✅ Normal Traffic | "), ports)
    return F.concat_ws(" ", stamp, F.when(attack, alarm).otherwise(calm))
