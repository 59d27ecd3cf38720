"""Network addresses of both families as column expressions: 32 hexadecimal digits, an IPv4 address as the IPv6 one it is mapped to."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: What an IPv4 address is mapped behind.
MAPPED = "0" * 20 + "ffff"
#: IPv6 ranges that hold an IPv4 address, by their leading digits, and the number of digits before it: mapped, translated,
#: compatible and NAT64 addresses have it at the end, 6to4 ones after 16 bits.
EMBEDDED = ((MAPPED, 24), ("0" * 16 + "ffff0000", 24), ("0" * 24, 24), ("0064ff9b" + "0" * 16, 24), ("2002", 4))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def _v4_digits(ip: Column) -> Column:
    return F.array_join(F.transform(F.split(ip, r"\."), lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))), "")


def _v6_digits(plain: Column) -> Column:
    """The digits of an IPv6 address without an IPv4 one at its end."""
    groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))
    halves = F.transform(F.split(plain, "::", -1), groups)

    def joined(parts: Column) -> Column:
        missing = 8 - F.size(F.flatten(parts))
        zeros = F.array_repeat(F.lit("0"), missing)
        return F.when(F.size(parts) == 1, F.get(parts, 0)).when((F.size(parts) == 2) & (missing >= 1), F.concat(F.get(parts, 0), zeros, F.get(parts, 1)))

    def padded(whole: Column) -> Column:
        good = (F.size(whole) == 8) & F.forall(whole, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), ""))

    return F.when(plain.contains(":"), _let(halves, lambda parts: _let(joined(parts), padded)))


def _without_v4(plain: Column) -> Column:
    """An IPv6 address with an IPv4 one at its end as two groups; null if that is none."""

    def swapped(tail: Column) -> Column:
        groups = _let(_v4_digits(tail), lambda d: F.concat(F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
        return F.when(tail == "", plain).when(tail.rlike(_V4), F.concat(F.regexp_replace(plain, r"[^:]*$", ""), groups))

    return _let(F.regexp_extract(plain, r":([^:]*\.[^:]*)$", 1), swapped)


def address_digits(text: Column) -> Column:
    """The digits of an address: any valid form, in brackets or with a zone too; null for what is no address."""

    def read(bare: Column) -> Column:
        v6 = _let(_let(F.regexp_replace(bare, "%.*$", ""), _without_v4), _v6_digits)
        return F.when(bare.rlike(_V4), F.concat(F.lit(MAPPED), _v4_digits(bare))).otherwise(v6)

    return _let(F.lower(F.regexp_replace(F.trim(text), r"^\[(.*)\]$", "$1")), read)


def routed_digits(digits: Column) -> Column:
    """The address that a packet goes to: of one that holds an IPv4 address, that one."""

    def held(d: Column) -> Column:
        out = d
        for lead, at in reversed(EMBEDDED):
            out = F.when(d.startswith(lead), F.concat(F.lit(MAPPED), F.substring(d, at + 1, 8))).otherwise(out)
        return out

    return _let(digits, held)


def leading(digits: Column, bits: Column) -> Column:
    """The first `bits` bits of an address, the rest 0, as far as digits reach."""
    part, whole = F.pmod(bits, F.lit(4)), F.floor(bits / 4).cast("int")
    nibble = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2.0), 4 - part)
    return F.concat(F.substring(digits, F.lit(1), whole), F.when(part == 0, "").otherwise(F.lower(F.hex((F.floor(nibble / step) * step).cast("long")))))


def network_prefix(text: Column) -> Column:
    """What addresses of one network share: the /24 of an IPv4 address (that an IPv6 one may hold), the /48 of any other."""
    return _let(routed_digits(address_digits(text)), lambda d: F.when(d.startswith(MAPPED), F.substring(d, 1, 30)).otherwise(F.substring(d, 1, 12)))


def in_ranges(digits: Column, ranges: tuple[str, ...]) -> Column:
    """Whether an address is in one of a few ranges that are settings: no join."""

    def inside(d: Column) -> Column:
        out = F.lit(False)
        for text in ranges:
            own = ipaddress.ip_network(text)
            bits = own.prefixlen + (96 if own.version == 4 else 0)
            first = int(own.network_address) + (0xFFFF << 32 if own.version == 4 else 0)
            out = out | d.between(f"{first:032x}", f"{first + (1 << (128 - bits)) - 1:032x}")
        return out

    return _let(digits, inside)
