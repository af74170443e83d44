"""Address-derived map positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _octet(ip: Column, index: int) -> Column:
    return F.get(F.split(ip, "[.]"), F.lit(index))


def _leading_int(part: Column) -> Column:
    return F.regexp_extract(part, r"^\s*([+-]?\d+)", 1).try_cast("int")


def address_word(ip: Column) -> Column:
    """The dotted address as a signed 32-bit word; NULL when a part is not a number."""
    parts = F.split(ip, "[.]")
    readable = ~F.exists(parts, lambda p: ~p.rlike(r"^\s*[+-]?\d+"))
    terms = [
        F.shiftleft(F.coalesce(_leading_int(_octet(ip, i)), F.lit(0)), 24 - 8 * i) for i in range(4)
    ]
    word = terms[0].bitwiseOR(terms[1]).bitwiseOR(terms[2]).bitwiseOR(terms[3])
    return F.when((ip != "") & readable, word)


def ip_lat(ip: Column) -> Column:
    lat = F.pmod(address_word(ip), F.lit(180)) - 90
    return F.when(lat.isNotNull(), F.greatest(F.lit(-85), F.least(F.lit(85), lat)))


def ip_lon(ip: Column) -> Column:
    return F.pmod(F.shiftright(address_word(ip), 8), F.lit(360)) - 180


def _plain_octet(ip: Column, index: int) -> Column:
    return F.coalesce(_octet(ip, index).try_cast("bigint"), F.lit(0).cast("bigint"))


def pseudo_seed(ip: Column, rank: Column) -> Column:
    parts = F.transform(
        F.split(ip, "[.]"), lambda p, i: F.coalesce(p.try_cast("bigint"), F.lit(0).cast("bigint")) * (i + 1)
    )
    return F.aggregate(parts, (rank * 17).cast("bigint"), lambda acc, x: acc + x)


def pseudo_lat(ip: Column, rank: Column) -> Column:
    return pseudo_seed(ip, rank) % 160 - 80 + _plain_octet(ip, 0) % 7


def pseudo_lon(ip: Column, rank: Column) -> Column:
    return pseudo_seed(ip, rank) % 340 - 170 + _plain_octet(ip, 1) % 11


def polar_x(angle: Column) -> Column:
    return 0.5 + 0.45 * F.cos(F.radians(angle))


def polar_y(angle: Column) -> Column:
    return 0.5 - 0.45 * F.sin(F.radians(angle))
