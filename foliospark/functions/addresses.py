"""Addresses written in URLs: one 128-bit form for every spelling, matched against a table of ranges by longest prefix."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that are not publicly routable, and (public) parts of them that are. Fixed values, from the registries.
NON_PUBLIC = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
              "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8")
PUBLIC = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _bits(network: str) -> str:
    n = ipaddress.ip_network(network)
    value, length = int(n.network_address), n.prefixlen
    if n.version == 4:
        value, length = value | 0xFFFF << 32, length + 96
    return f"{value:0128b}"[:length]


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(p: Column) -> Column:
    digits = F.when(p == "0x", "0").when(p.startswith("0x"), F.conv(F.substring(p, 3, 20), 16, 10)).when(p.startswith("0"), F.conv(p, 8, 10)).otherwise(p)
    return F.when(p.rlike("^(0x[0-9a-f]{0,15}|0[0-7]{0,20}|[1-9][0-9]{0,15})$"), digits.cast("decimal(20,0)"))


def _v4(host: Column) -> Column:
    """The 8 hex digits of one to four decimal, octal (0..) or hexadecimal (0x..) parts, the last of which fills what is left."""

    def of(numbers: Column) -> Column:
        n, last = F.size(numbers), F.element_at(numbers, -1)
        room = F.element_at(F.array(*[F.lit(256 ** (5 - k)).cast("decimal(20,0)") for k in range(1, 5)]), F.least(n, F.lit(4)))
        fits = (n <= 4) & ~F.exists(numbers, lambda v: v.isNull()) & F.forall(F.slice(numbers, 1, n - 1), lambda v: v < 256) & (last < room)
        start = F.struct(F.lit(0).cast("long").alias("v"), F.lit(16777216).cast("long").alias("w"))
        head = F.aggregate(F.slice(numbers, 1, n - 1), start, lambda s, v: F.struct((s["v"] + v.cast("long") * s["w"]).alias("v"), F.shiftright(s["w"], 8).alias("w")))["v"]
        return F.when(fits, F.lower(F.lpad(F.hex(head + last.cast("long")), 8, "0")))

    return _let(F.transform(F.split(host, r"\."), _number), of)


def _v6(host: Column) -> Column:
    """The 32 hex digits of eight groups, `::` filled up, a dotted quad at the end taken as two groups."""
    quad = lambda h: F.regexp_extract(h, r":([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
    plain = lambda h: _let(quad(h), lambda q: F.when(q == "", h).otherwise(_let(_v4(F.when(~q.rlike(r"(^|\.)0[0-9]"), q)), lambda t: F.concat(F.regexp_replace(h, r"[0-9.]+$", ""), F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4)))))
    none = F.array().cast("array<string>")
    groups = lambda s: F.when(s == "", none).otherwise(F.split(s, ":"))

    def of(halves: Column) -> Column:
        both = F.struct(groups(F.element_at(halves, 1)).alias("l"), F.when(F.size(halves) == 2, groups(F.element_at(halves, -1))).otherwise(none).alias("r"), F.size(halves).alias("n"))
        return _let(both, whole)

    def whole(b: Column) -> Column:
        n = F.size(b["l"]) + F.size(b["r"])
        count = F.when(b["n"] == 1, n == 8).otherwise((b["n"] == 2) & (n <= 7))
        filled = F.concat(b["l"], F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), b["r"])
        return F.when(count & F.forall(filled, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(host.contains(":"), _let(F.split(plain(F.regexp_replace(host, "%.*$", "")), "::", -1), of))


def address(host: Column) -> Column:
    """32 hex digits of the address that host spells (IPv4 as ::ffff:a.b.c.d), or null where it is a name. Lower case, no brackets."""
    return _let(host, lambda h: F.when(h.contains(":"), _v6(h)).otherwise(_let(_v4(h), lambda four: F.concat(F.lit("0" * 20 + "ffff"), four))))


def is_public(digits: Column) -> Column:
    """Whether the range with the longest prefix that holds the address is public; null for null."""
    bits = lambda d: F.concat(*[F.lpad(F.conv(F.substring(d, 8 * k + 1, 8), 16, 2), 32, "0") for k in range(4)])
    table = sorted([(_bits(n), False) for n in NON_PUBLIC] + [(_bits(n), True) for n in PUBLIC], key=lambda r: -len(r[0]))
    ranges = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in table])  # longest first
    first = lambda b: F.try_element_at(F.transform(F.filter(ranges, lambda r: b.startswith(r["p"])), lambda r: r["o"]), F.lit(1))
    return _let(digits, lambda d: F.when(d.isNotNull(), F.coalesce(_let(bits(d), first), F.lit(True))))


def screen(url: Column, deny: tuple[str, ...], allow: tuple[str, ...]) -> tuple[Column, Column]:
    """(host, verdict): SCHEME, NO_HOST, DENIED, NOT_ALLOWED, BAD_ADDRESS, NON_PUBLIC or OK, the first rule that fails.

    Suffixes hold for a domain and all below it; an empty allow list allows all. A host that ends in a number or holds a colon
    is an address; where it spells none it is refused."""
    of = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/:?#]*)", 1), r"[\[\]]|\.$", ""))
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))

    def judged(host: Column) -> Column:
        under = lambda names: host.rlike(r"(^|\.)(" + "|".join(n.replace(".", "[.]") for n in names) + ")$")
        looks = host.rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)$") | host.contains(":")
        verdict = F.when(~scheme.isin("http", "https"), "SCHEME").when(host == "", "NO_HOST")
        if deny:
            verdict = verdict.when(under(deny), "DENIED")
        if allow:
            verdict = verdict.when(~looks & ~under(allow), "NOT_ALLOWED")
        at = _let(F.when(looks, address(host)), lambda d: F.when(d.isNull(), "BAD_ADDRESS").when(is_public(d), "OK").otherwise("NON_PUBLIC"))
        return verdict.when(looks, at).when((host == "localhost") | host.endswith(".localhost"), "NON_PUBLIC").otherwise("OK")

    return of, _let(of, judged)
