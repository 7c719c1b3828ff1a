"""Addresses in hosts as numbers: IPv4 in every form that resolvers take, IPv6 as two longs, networks, and what may be fetched."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions import urls as ux
from sightline.functions.text import let

#: Hosts that are refused by name.
REFUSED = ("localhost", "ip6-localhost", "ip6-loopback", "metadata.google.internal", "metadata.goog", "metadata", "metadata.azure.com", "metadata.ec2.internal", "metadata.oraclecloud.com", "127.0.0.1", "0.0.0.0", "::1", "169.254.169.254", "fd00:ec2::254")
#: Networks that are not public.
NOT_PUBLIC_4 = ("0.0.0.0/32", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
NOT_PUBLIC_6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8")


def _number(part: Column) -> Column:
    """A part of an address in base 16 (0x), 8 (0) or 10; null if it is none or has more than 32 bits or so."""

    def read(digits: Column) -> Column:
        short = lambda base, n: F.conv(F.concat(F.lit("0"), F.substring(digits, 1, n)), base, 10).cast("long")
        size = F.length(digits)
        return F.when(part.rlike("^0x[0-9a-f]+$") & (size <= 8), short(16, 8)).when(part.rlike("^0[0-7]*$") & (size <= 11), short(8, 11)).when(part.rlike("^[1-9][0-9]*$") & (size <= 10), short(10, 10))

    return let(F.regexp_replace(part, "^(?:0x)?0*", ""), read)


def ipv4(host: Column) -> Column:
    """The number of an IPv4 address of one to four parts, each of base 10, 8 or 16; the last part fills what is left. Else null."""

    def read(numbers: Column) -> Column:
        n, last = F.size(numbers), F.element_at(numbers, -1)
        head = F.slice(numbers, 1, F.greatest(n - 1, F.lit(0)))
        room = F.element_at(F.array(*[F.lit(1 << (8 * k)) for k in (4, 3, 2, 1)]), F.least(F.greatest(n, F.lit(1)), F.lit(4)))
        fits = (n <= 4) & F.forall(numbers, lambda x: x.isNotNull()) & F.forall(head, lambda x: x <= 255) & (last < room)
        return F.when(fits, F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * room + last)

    return let(F.transform(F.split(F.lower(host), r"\."), _number), read)


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def _written_out(text: Column) -> Column:
    """IPv6 text whose dotted last part, if it has one, is two groups."""
    tail = F.regexp_extract(text, r":((?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3})$", 1)
    hexed = lambda n: F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
    return F.when(text.contains("."), let(ipv4(F.nullif(tail, F.lit(""))), hexed)).otherwise(text)


def _filled(halves: Column) -> Column:
    """The groups before and after ::, with as many zeros between them as make eight; as they are without ::."""

    def fill(sides: Column) -> Column:
        missing = 8 - F.size(sides[0]) - F.size(F.get(sides, F.lit(1)))
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        return F.when(F.size(sides) == 1, sides[0]).when((F.size(sides) == 2) & (missing >= 1), F.concat(sides[0], zeros, F.get(sides, F.lit(1))))

    return let(F.transform(halves, _groups), fill)


def _halves(groups: Column) -> Column:
    valid = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    half = lambda start: F.aggregate(F.slice(groups, start, 4), F.lit(0).cast("long"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(F.conv(F.substring(g, 1, 4), 16, 10).cast("long")))
    return F.when(valid, F.struct(half(1).alias("high"), half(5).alias("low")))


def ipv6(host: Column) -> Column:
    """(high, low): the halves of an IPv6 address as longs, brackets or not, dotted last part or not; null if it is none."""
    text = F.lower(F.regexp_replace(host, r"^\[(.*)\]$", "$1"))
    return let(let(F.split(let(text, _written_out), "::"), _filled), _halves)


def mapped_ipv4(address: Column) -> Column:
    """The IPv4 number within ::ffff:0:0/96; null for other IPv6 addresses."""
    return let(address, lambda a: F.when(in_ipv6(a, "::ffff:0:0/96"), a["low"].bitwiseAND(0xFFFFFFFF)))


def in_ipv4(number: Column, network: str) -> Column:
    """Whether an IPv4 number lies in a network of CIDR notation."""
    net = ipaddress.IPv4Network(network)
    return number.between(int(net.network_address), int(net.broadcast_address))


def in_ipv6(address: Column, network: str) -> Column:
    """Whether (high, low) lies in a network of CIDR notation: the bits of its mask are its own, in each half that has some."""
    net = ipaddress.IPv6Network(network)
    own, mask = int(net.network_address), int(net.netmask)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tests = [address[name].bitwiseAND(F.lit(signed(m)).cast("long")) == signed(o) for name, m, o in (("high", mask >> 64, own >> 64), ("low", mask & (2**64 - 1), own & (2**64 - 1))) if m]
    return F.when(address.isNotNull(), reduce(lambda a, b: a & b, tests, F.lit(True)))


def public_ipv4(number: Column) -> Column:
    return let(number, lambda x: ~reduce(lambda a, b: a | b, [in_ipv4(x, n) for n in NOT_PUBLIC_4]))


def public_ipv6(address: Column) -> Column:
    """Whether (high, low) is public; a mapped IPv4 address is as public as that is."""
    own = lambda x: ~reduce(lambda a, b: a | b, [in_ipv6(x, n) for n in NOT_PUBLIC_6])
    return let(address, lambda x: F.coalesce(public_ipv4(mapped_ipv4(x)), own(x)))


def host(url: Column) -> Column:
    """A URL's host in lower case without one dot at its end; an IPv4 address of any form as a dotted quad. Null where the last
    part is a number and the host is no such address, and for a host that is empty."""
    name = F.lower(F.trim(F.regexp_replace(F.regexp_replace(ux.part(url, 2), r"^.*@", ""), r":\d*$", "")))
    quad = lambda n: F.when(n.isNotNull(), ipv4_text(n))
    numeric = lambda x: x.rlike(r"(?:^|\.)(?:0x[0-9a-f]*|[0-9]+)$") & ~x.startswith("[")
    return let(F.regexp_replace(name, r"([^.])\.$", "$1"), lambda x: F.when(numeric(x), let(ipv4(x), quad)).otherwise(F.nullif(x, F.lit(""))))


def safe(url: Column) -> Column:
    """Whether a server may fetch a URL, as far as its text says: http(s), no user, %, or backslash in the authority, no
    fragment that looks like one, and a host that is neither refused by name nor an address that isn't public."""
    confused = ux.part(url, 2).rlike(r"[@%\\]") | F.lower(url).rlike("#@|%23@")

    def fit(name: Column) -> Column:
        bare = F.regexp_replace(name, r"^\[(.*)\]$", "$1")
        public = F.when(name.startswith("["), public_ipv6(ipv6(name))).otherwise(F.coalesce(public_ipv4(ipv4(name)), F.lit(True)))
        return ~bare.isin(*REFUSED) & public

    return F.coalesce(url.rlike(r"(?i)^https?://") & ~confused & let(host(url), fit), F.lit(False))
