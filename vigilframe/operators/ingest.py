"""Ingest steps: JSON scans, validation, defaults, gating and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import coerce

# Limits of an accepted event.
MAX_PORT = 65535
MAX_LENGTH = {"proto": 32, "severity": 32, "message": 2048}
KNOWN_FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port", "proto", "severity", "message")
FLAG_ON = ("1", "true", "yes", "on")
PULSE = "auto-pulse"  # follows the producer's name


def scan_json_events(df: DataFrame, raw: str = "raw", out: str = "event") -> DataFrame:
    """Rows whose text is a JSON object, with the parsed event."""
    return df.withColumn(out, coerce.parsed(F.col(raw))).filter(F.col(out).isNotNull())


def scan_json_lenient(df: DataFrame, raw: str = "raw", out: str = "payload") -> DataFrame:
    """Like a scan, but text that is not JSON is kept as ``{"raw": text}``."""
    kept = F.to_json(F.struct(F.col(raw).alias("raw")))
    return df.withColumn(out, F.when(F.try_parse_json(F.col(raw)).isNotNull(), F.col(raw)).otherwise(kept))


def normalise_events(df: DataFrame, as_of: Column, raw: str = "raw") -> DataFrame:
    """Typed columns of raw events, whatever aliases the producer used."""
    events = scan_json_events(df, raw)
    e = F.col("event")
    return events.select(
        *[c for c in df.columns if c != raw],
        coerce.event_time(e, as_of).alias("ts"), coerce.source_ip(e).alias("src_ip"),
        coerce.destination_port(e).alias("dst_port"), coerce.protocol(e).alias("proto"),
        coerce.raw_is_attack(e).alias("attack"),
    )


def validate_events(df: DataFrame) -> DataFrame:
    """Adds ``errors``, the reason codes of a rejection, and ``accepted``."""
    checks = [
        F.when(~F.col(c).between(0, MAX_PORT), F.lit(f"{c}_range")) for c in ("src_port", "dst_port")
    ]
    checks += [F.when(~coerce.is_valid_ip(F.col(c)), F.lit(f"{c}_invalid")) for c in ("src_ip", "dst_ip")]
    checks += [
        F.when(F.char_length(c) > limit, F.lit(f"{c}_too_long")) for c, limit in MAX_LENGTH.items()
    ]
    return df.withColumn("errors", F.filter(F.array(*checks), lambda x: x.isNotNull())).withColumn(
        "accepted", F.size("errors") == 0
    )


def is_heartbeat(*candidates: Column, producer: str) -> Column:
    """The first non-empty text is a pulse of this producer."""
    text = F.trim(F.lower(F.coalesce(coerce.first_text(*candidates), F.lit(""))))
    return text.startswith(f"{producer.lower()} {PULSE}")


def drop_heartbeats(df: DataFrame, *fields: str, producer: str) -> DataFrame:
    """Leaves out the pulses of one producer; messages of others stay, whatever their form."""
    return df.filter(~is_heartbeat(*[F.col(c) for c in fields or ("message",)], producer=producer))


def default_event_fields(df: DataFrame, as_of: Column, ts: str = "ts", content: Sequence[str] = KNOWN_FIELDS) -> DataFrame:
    """Missing times become the arrival time, missing ids a digest of all that was sent.

    The digest covers the content fields, the time as sent, and ``extras`` where there are
    any, so a retry repeats the id and another event doesn't. Each value carries its length and
    NULL is a mark of its own: fields can't run into each other.
    """
    sent = [F.col(c).cast("string") for c in (*content, ts)]
    if "extras" in df.columns:
        sent.append(F.to_json(F.array_sort(F.map_entries("extras"))))
    marked = [F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in sent]
    digest = F.sha2(F.concat_ws("|", *marked), 256)
    given = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), digest) if "id" in df.columns else digest
    return df.withColumn("id", given).withColumn(ts, F.coalesce(F.col(ts), as_of))


def extras(df: DataFrame, raw: str = "raw", known: Sequence[str] = KNOWN_FIELDS) -> DataFrame:
    """Adds ``extras``: the unknown fields of a raw event, without nulls."""
    fields = F.from_json(F.col(raw), "map<string,string>")
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*known) & v.isNotNull())
    return df.withColumn("extras", kept)


def maintenance_gate(df: DataFrame, flag: DataFrame, column: str = "flag") -> DataFrame:
    """Passes nothing while the one-row flag table says maintenance is on."""
    on = flag.select(F.lower(F.col(column)).isin(*FLAG_ON)).scalar()
    return df.filter(~F.coalesce(on, F.lit(False)))


def dedup_events(df: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row per id, the earliest; aggregates partially, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), order)
    return df.groupBy(key).agg(first.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
