"""Addresses as fixed-width hex keys: 8 digits for IPv4, 32 for IPv6. Ranges become string ranges."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.times import col, let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_V4_TAIL = rf"(?:{_OCTET}\.){{3}}{_OCTET}$"


def _v4_hex(ip: Column) -> Column:
    return F.concat(
        *[F.lpad(F.hex(F.split_part(ip, F.lit("."), F.lit(i)).cast("bigint")), 2, "0") for i in (1, 2, 3, 4)]
    )


def _v6_groups(text: Column) -> Column:
    """The eight groups of an address in colon form, NULL when it is not valid."""
    none = F.array().cast("array<string>")

    def groups(part: Column) -> Column:
        return F.when(part == "", none).otherwise(F.split(part, ":"))

    halves = F.split(text, "::")
    gap = F.size(halves) == 2
    head, rest = groups(F.get(halves, F.lit(0))), F.when(gap, groups(F.get(halves, F.lit(1)))).otherwise(none)
    fill = 8 - F.size(head) - F.size(rest)
    shape = (F.size(halves) <= 2) & F.when(gap, fill >= 1).otherwise(fill == 0)
    full = F.concat(head, F.when(gap, F.array_repeat(F.lit("0"), fill)).otherwise(none), rest)
    checked = F.when(shape, full)
    return let(checked, lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$")), g))


def _v6_hex(ip: Column) -> Column:
    """NULL when the text is no IPv6 address. A dotted tail is turned into two groups first."""

    def colon_form(tail: Column) -> Column:
        h = _v4_hex(tail)
        return F.when(
            tail != "",
            F.concat(F.regexp_replace(ip, _V4_TAIL, ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)),
        ).otherwise(ip)

    text = let(F.regexp_extract(ip, _V4_TAIL, 0), colon_form)
    padded = F.transform(let(text, _v6_groups), lambda g: F.lpad(F.upper(g), 4, "0"))
    return F.when(ip.contains(":") & ~ip.contains(":::"), F.array_join(padded, ""))


def ip_hex(ip: str | Column) -> Column:
    """Comparable key of an address, NULL when it is not valid."""
    ip = F.trim(col(ip))
    return F.when(ip.rlike(V4), _v4_hex(ip)).when(ip.contains(":"), _v6_hex(ip))


def truncate_ip(ip: str | Column) -> Column:
    """IPv4 to /24, IPv6 to /48, '' when not valid."""
    ip = F.trim(col(ip))

    def short(h: Column) -> Column:
        parts = F.transform(
            F.array(F.lit(1), F.lit(5), F.lit(9)),
            lambda i: F.regexp_replace(F.lower(F.substring(h, i, F.lit(4))), "^0{1,3}", ""),
        )
        # Zero groups at the end are part of the closing double colon.
        kept = F.regexp_replace(F.array_join(parts, ":"), "(^|:)0(:0)*$", "")
        return F.when(h.isNull(), "").otherwise(F.concat(kept, F.lit("::")))

    v6 = let(_v6_hex(ip), short)
    return F.when(ip.rlike(V4), F.concat(F.substring_index(ip, ".", 3), F.lit(".0"))).otherwise(v6)


def client_ip(df: DataFrame, header: str, remote: str = "remote_addr", out: str = "ip") -> DataFrame:
    """Left-most valid address of a forwarding header, else the connecting address, else ''."""
    valid = F.filter(
        F.transform(F.split(F.coalesce(F.col(header), F.lit("")), ","), lambda a: F.trim(a)),
        lambda a: ip_hex(a).isNotNull(),
    )
    direct = F.trim(F.coalesce(F.col(remote), F.lit("")))
    return df.withColumn(
        out, F.coalesce(F.get(valid, F.lit(0)), F.when(ip_hex(direct).isNotNull(), direct), F.lit(""))
    )


def cidr_bounds(entry: str) -> tuple[str, str] | None:
    """First and last key of an address or CIDR block from the settings; NULL for a broken entry."""
    try:
        net = ipaddress.ip_network(entry.strip(), strict=False)
    except ValueError:
        return None
    width = 8 if net.version == 4 else 32
    return f"{int(net[0]):0{width}X}", f"{int(net[-1]):0{width}X}"


def in_cidrs(ip: str | Column, cidrs: Sequence[str]) -> Column:
    """Whether an address lies in a block of its own family. The list is a setting, not a table."""
    bounds = [b for b in map(cidr_bounds, cidrs) if b]
    if not bounds:
        return F.lit(False)

    def hit(key: Column) -> Column:
        out = F.lit(False)
        for lo, hi in bounds:
            out = out | ((F.length(key) == len(lo)) & key.between(lo, hi))
        return F.coalesce(out, F.lit(False))

    return let(ip_hex(ip), hit)


def exclude_ips(df: DataFrame, cidrs: Sequence[str], ip: str = "ip") -> DataFrame:
    return df.where(~in_cidrs(ip, cidrs))
