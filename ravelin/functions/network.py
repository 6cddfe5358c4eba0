"""Addresses: IPv4 arithmetic, CIDR blocks, URL parts, special-use ranges."""

from __future__ import annotations

import functools
import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: Networks that no public host has.
SPECIAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)


def is_ipv4(text: Column) -> Column:
    return F.coalesce(text.rlike(IPV4), F.lit(False))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a 32-bit number in a long."""
    parts = F.split(ip, r"\.")
    number = lambda k: F.get(parts, F.lit(k)).cast("bigint")
    return F.when(is_ipv4(ip), number(0) * 16777216 + number(1) * 65536 + number(2) * 256 + number(3))


def ip_text(number: Column) -> Column:
    byte = lambda shift: F.shiftright(number, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def cidr(text: Column) -> Column:
    """An IPv4 block with the bits of its hosts cleared; a bare address is its own /32; null if it is no block."""
    ip = F.substring_index(text, "/", 1)
    bits = F.when(F.instr(text, "/") > 0, F.when(F.substring_index(text, "/", -1).rlike(r"^\d{1,2}$"), F.substring_index(text, "/", -1).cast("int"))).otherwise(F.lit(32))
    host = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - bits)
    return F.when(is_ipv4(ip) & bits.between(0, 32), F.concat(ip_text(ip_number(ip) - F.pmod(ip_number(ip), host)), F.lit("/"), bits.cast("string")))


#: IPv6 networks that no public host has.
SPECIAL_6 = ("::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8")


def ipv6_groups(text: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address, a trailing dotted IPv4 part included; null if it is none. A zone after % is ignored."""
    groups = lambda part: F.filter(F.split(F.coalesce(part, F.lit("")), ":", -1), lambda g: F.coalesce(part, F.lit("")) != "")
    hextet = lambda n: F.lower(F.hex(n))

    def with_words(bare: Column) -> Column:
        """The dotted part, if there is one, as two groups."""
        four = ip_number(F.regexp_extract(bare, r":(\d+\.\d+\.\d+\.\d+)$", 1))
        head = F.regexp_extract(bare, r"^(.*:)\d+\.\d+\.\d+\.\d+$", 1)
        return let(four, lambda n: F.when(head == "", bare).when(n.isNotNull(), F.concat(head, hextet(F.shiftright(n, 16)), F.lit(":"), hextet(n.bitwiseAND(F.lit(0xFFFF))))))

    def filled(cut: Column) -> Column:
        def pad(sides: Column) -> Column:
            missing = F.lit(8) - F.size(sides["l"]) - F.size(sides["r"])
            whole = F.concat(sides["l"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), sides["r"])
            return F.when(F.size(cut) == 1, sides["l"]).when((F.size(cut) == 2) & (missing >= 1), whole)

        return let(F.struct(groups(F.get(cut, F.lit(0))).alias("l"), groups(F.get(cut, F.lit(1))).alias("r")), pad)

    bare = F.lower(F.substring_index(F.regexp_replace(F.trim(text), r"^\[|\]$", ""), "%", 1))
    every = let(let(bare, with_words), lambda b: let(F.split(b, "::", -1), filled))
    good = lambda g: (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    return let(every, lambda g: F.when(good(g), F.transform(g, lambda x: F.conv(x, 16, 10).cast("int"))))


def _in_block_6(groups: Column, block: str) -> Column:
    net = ipaddress.ip_network(block)
    out = F.lit(True)
    for k in range(-(-net.prefixlen // 16)):
        bits = min(16, net.prefixlen - 16 * k)
        mask = 0xFFFF << (16 - bits) & 0xFFFF
        out = out & (F.get(groups, F.lit(k)).bitwiseAND(F.lit(mask)) == (int(net.network_address) >> (112 - 16 * k) & mask))
    return out


def is_special(ip: Column) -> Column:
    """Whether an address lies in a special-use network (so no fetch may go there): IPv4, IPv6, and IPv4 inside a mapped IPv6 address."""

    def judged(groups: Column) -> Column:
        inner = ip_text(F.get(groups, F.lit(6)).cast("bigint") * 65536 + F.get(groups, F.lit(7)))
        six = functools.reduce(lambda a, b: a | b, (_in_block_6(groups, block) for block in SPECIAL_6))
        return F.when(groups.isNull(), let(ip, _is_special_4)).when(_in_block_6(groups, "::ffff:0:0/96"), let(inner, _is_special_4)).otherwise(six)

    return let(ipv6_groups(ip), judged)


def _is_special_4(ip: Column) -> Column:
    blocks = [ipaddress.ip_network(block) for block in SPECIAL]
    inside = lambda n: functools.reduce(lambda a, b: a | b, (n.between(int(b[0]), int(b[-1])) for b in blocks))
    return F.coalesce(let(ip_number(ip), inside), F.lit(False))


def url_part(url: Column, part: str) -> Column:
    """scheme, authority, host, path, query or fragment of a URL, empty if it has none."""
    shape = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    pick = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    if part == "scheme":
        return F.lower(pick(1))
    if part == "host":
        return F.lower(F.regexp_replace(F.regexp_replace(pick(2), r"^.*@", ""), r":\d*$", ""))
    return {"authority": pick(2), "path": pick(3), "query": pick(4), "fragment": pick(5)}[part]


def url_is_admissible(url: Column) -> Column:
    """http or https, with a host and without a user."""
    return url_part(url, "scheme").isin("http", "https") & (url_part(url, "host") != "") & ~url_part(url, "authority").contains("@")


def resolve(base: Column, href: Column) -> Column:
    """A reference against the URL of its page: absolute, scheme-relative, rooted, query, fragment or relative, with dot segments removed."""
    scheme, authority, path = url_part(base, "scheme"), url_part(base, "authority"), url_part(base, "path")
    root = F.concat(scheme, F.lit("://"), authority)
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    query = F.when(url_part(base, "query") != "", F.concat(F.lit("?"), url_part(base, "query"))).otherwise(F.lit(""))
    href_path = F.regexp_extract(href, r"^[^?#]*", 0)
    tail = F.substring(href, F.length(href_path) + 1, F.length(href))
    merged = F.when(href.startswith("/"), href_path).otherwise(F.concat(folder, href_path))

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    parts = F.split(F.substring(merged, F.lit(2), F.length(merged)), "/")
    tidy = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    tidy = F.when(merged.rlike(r"/\.{1,2}$") & ~tidy.endswith("/"), F.concat(tidy, F.lit("/"))).otherwise(tidy)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", F.concat(root, path, query))
        .when(href.startswith("#"), F.concat(root, path, query, href))
        .when(href.startswith("?"), F.concat(root, path, href))
        .otherwise(F.concat(root, tidy, tail))
    )


def confined(base: Column, href: Column, hosts: list[str], path_pattern: str) -> Column:
    """The resolved link without its fragment if it stays on the given hosts and paths, else null."""
    good = lambda url: url_is_admissible(url) & url_part(url, "host").isin(hosts) & url_part(url, "path").rlike(path_pattern)
    return let(F.regexp_replace(resolve(base, href), r"#.*$", ""), lambda url: F.when(good(url), url))


def looks_like_pdf(content_type: Column, head: Column, url: Column) -> Column:
    """By content type, else by the first bytes, else by the path."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    magic = F.coalesce(F.substring(head, 1, 5) == F.unhex(F.lit("255044462D")), F.lit(False))
    return (kind == "application/pdf") | magic | F.lower(url_part(url, "path")).endswith(".pdf")
