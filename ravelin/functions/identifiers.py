"""Indicators in text: shapes, patterns, harvests, and the identifiers by which a text is anchored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .network import url_part

#: Type -> (pattern template, observable type).
PATTERNS = {
    "ip": ("[ipv4-addr:value = '{v}']", "IPv4-Addr"),
    "domain": ("[domain-name:value = '{v}']", "Domain-Name"),
    "url": ("[url:value = '{v}']", "Url"),
    "hash_md5": ("[file:hashes.MD5 = '{v}']", "StixFile"),
    "hash_sha1": ("[file:hashes.'SHA-1' = '{v}']", "StixFile"),
    "hash_sha256": ("[file:hashes.'SHA-256' = '{v}']", "StixFile"),
    "email": ("[email-addr:value = '{v}']", "Email-Addr"),
}
#: The shape that a value of each type must have.
SHAPES = {
    "ip": r"^\d{1,3}(?:\.\d{1,3}){3}$",
    "domain": r"^(?=.{1,253}$)(?:\*\.)?(?!-)[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+$",
    "url": r"^https?://[^\s'\"\\]{1,2000}$",
    "hash_md5": r"^[A-Fa-f0-9]{32}$",
    "hash_sha1": r"^[A-Fa-f0-9]{40}$",
    "hash_sha256": r"^[A-Fa-f0-9]{64}$",
    "email": r"^[^\s'\"\\@]{1,64}@(?!-)[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+$",
}
#: Generic top-level domains that are in wide use. Country codes are known by their form: two letters.
GENERIC_TLDS = (
    "com", "net", "org", "info", "biz", "edu", "gov", "mil", "int", "arpa", "name", "pro", "aero", "coop", "museum", "jobs", "mobi", "travel", "tel", "asia", "cat", "post", "xxx",
    "xyz", "top", "online", "site", "website", "space", "club", "shop", "store", "app", "dev", "page", "cloud", "tech", "live", "life", "world", "today", "news", "blog", "wiki", "work",
    "works", "email", "link", "click", "vip", "win", "bid", "loan", "men", "date", "party", "trade", "review", "stream", "download", "racing", "science", "cricket", "faith", "accountant",
    "icu", "cyou", "buzz", "monster", "quest", "sbs", "rest", "bar", "fun", "pw", "host", "press", "agency", "digital", "network", "systems", "solutions", "services", "support", "center",
    "group", "company", "finance", "money", "bank", "insurance", "capital", "exchange", "market", "markets", "global", "international", "media", "studio", "design", "art", "games",
    "game", "bet", "casino", "poker", "chat", "social", "video", "photos", "zip", "mov", "run", "rocks", "ninja", "guru", "zone", "expert", "tools", "software", "codes", "security",
    "health", "care", "school", "academy", "university", "law", "legal", "example", "test", "invalid", "localhost", "onion",
)


def is_tld(label: Column, tlds: tuple[str, ...] | None = None) -> Column:
    """Whether a lower-case label is a top-level domain: one of tlds if they are given (a full list, say), else a country code by form or a generic one."""
    return label.isin(*tlds) if tlds else label.rlike("^[a-z]{2}$") | label.isin(*GENERIC_TLDS)


HASH_SIZES = (("hash_sha256", 64), ("hash_sha1", 40), ("hash_md5", 32))


def has_shape(kind: Column, value: Column) -> Column:
    """Whether a value has the form of its type; unknown types have none."""
    out = F.lit(False)
    for name, shape in SHAPES.items():
        out = F.when(kind == name, value.rlike(shape)).otherwise(out)
    labels = F.split(F.substring_index(value, "@", -1), r"\.", -1)  # judged one by one, as a pattern that repeats a group recurses
    mail = value.rlike(r"^[^\s'\"\\@]{1,64}@(?!-)[A-Za-z0-9.-]+$") & (F.size(labels) > 1) & F.forall(labels, lambda x: F.length(x).between(1, 63))
    return F.coalesce(F.when(kind == "email", mail).otherwise(out), F.lit(False))


def pattern_of(kind: Column, value: Column) -> Column:
    """The pattern of a well-formed value, else null."""
    out = F.lit(None).cast("string")
    for name, (template, _) in PATTERNS.items():
        before, after = template.split("{v}")
        out = F.when(kind == name, F.concat(F.lit(before), T.escape(value), F.lit(after))).otherwise(out)
    return F.when(has_shape(kind, value), out)


def observable_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, observable) in PATTERNS.items():
        out = F.when(kind == name, F.lit(observable)).otherwise(out)
    return out


def type_label(pattern: Column) -> Column:
    """What a pattern is about, for display; `Unknown` if it can't be read."""
    raw = F.regexp_extract(pattern, r"^\[([a-z0-9-]+):", 1)
    return (
        F.when(raw == "ipv4-addr", "IPv4").when(raw == "domain-name", "Domain").when(raw == "url", "URL").when(raw == "email-addr", "Email")
        .when((raw == "file") & pattern.contains("SHA-256"), "SHA-256").when((raw == "file") & pattern.contains("SHA-1"), "SHA-1").when((raw == "file") & pattern.contains("MD5"), "MD5")
        .when(raw != "", raw).otherwise("Unknown")
    )


def hashes(text: Column) -> Column:
    """(type, value) of all hex runs of a hash's size, by type from the longest, then in text order."""
    size = "|".join(f"[A-Fa-f0-9]{{{n}}}" for _, n in HASH_SIZES)
    shape = rf"(?<![A-Fa-f0-9])({size})(?![A-Fa-f0-9])"
    of = lambda runs, name, n: F.transform(F.filter(runs, lambda r: F.length(r) == n), lambda r: F.struct(F.lit(name).alias("type"), r.alias("value")))
    found = F.transform(F.array(F.regexp_extract_all(text, F.lit(shape), F.lit(1))), lambda runs: F.concat(*[of(runs, *x) for x in HASH_SIZES]))
    return F.flatten(found)


def cves(text: Column) -> Column:
    """Vulnerability ids in upper case, each once, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(\bCVE-\d{4}-\d{4,7}\b)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def salvage_emails(domain: Column, text: Column) -> Column:
    """The addresses a domain is part of, if it stands nowhere on its own; null if it does, or isn't there.

    Occurrences inside a longer host name count for neither."""
    before = F.transform(T.occurrences(text, domain), lambda at: F.struct(F.regexp_extract(F.substring(text, F.lit(1), at), r"[A-Za-z0-9._%+-]+@$", 0).alias("local"), F.substring(text, at, F.lit(1)).alias("prev"), F.substring(text, at + F.length(domain) + 1, F.lit(1)).alias("next"), at.alias("at")))
    mails = F.transform(F.filter(before, lambda x: x["local"] != ""), lambda x: F.concat(x["local"], domain))
    alone = F.exists(before, lambda x: (x["local"] == "") & ~((x["at"] > 0) & x["prev"].rlike(r"(?U)[\p{L}\p{N}.\-]")) & ~x["next"].rlike(r"(?U)[\p{L}\p{N}\-]"))
    return F.when(~alone & (F.size(mails) > 0), F.array_distinct(mails))


def normal_identifier(kind: Column, value: Column) -> Column:
    """Case folded where it carries no meaning: scheme and host of a URL, domains, and upper case for ids."""
    head = F.regexp_extract(value, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    url = F.concat(F.lower(head), F.substring(value, F.length(head) + 1, F.length(value)))
    return F.when(kind == "url", url).when(kind == "domain", F.lower(value)).when(kind.isin("cve", "technique"), F.upper(value)).otherwise(value)


_URL = r"(?i)https?://[^\s|)\]}>\"'`]+"
KINDS = ("ipv4", "technique", "cve", "url", "domain")


def domain_names(text: Column) -> Column:
    """Host names of two labels or more that end in letters, in a lower-case text, each the longest in its run of labels.

    Runs of the signs of names are found first and then judged in pieces without empty labels, so a text of any form
    takes time by its length alone. Letters and numbers beyond those of names, and _, are part of the word they touch."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}._-]{4,})"), F.lit(1)), lambda r: r.contains("."))
    pieces = F.flatten(F.transform(runs, lambda r: F.split(F.regexp_replace(r, r"(?<![\p{L}\p{N}_])[a-z0-9]*+[^a-z0-9.-][\p{L}\p{N}_]*+", "_"), r"_+|\.{2,}")))
    names = F.transform(pieces, lambda p: F.regexp_extract(F.ltrim(p, F.lit(".-")), r"^([a-z0-9][a-z0-9.-]*\.[a-z]{2,})(?![a-z0-9])", 1))
    return F.filter(names, lambda n: n != "")


def facts(text: Column, tlds: tuple[str, ...] | None = None, kinds: tuple[str, ...] = KINDS) -> Column:
    """(kind, value) of the identifiers in a text, each once, sorted: IPv4, technique and CVE ids, URLs, and domains outside URLs; or those of some kinds."""
    made = lambda kind, found: F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), normal_identifier(F.lit(kind), v).alias("value")))
    every = lambda kind, pattern: made(kind, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    urls = lambda: made("url", F.transform(F.regexp_extract_all(text, F.lit(f"({_URL})"), F.lit(1)), lambda v: F.rtrim(v, F.lit(".,;:*"))))
    names = lambda: F.filter(made("domain", domain_names(F.lower(F.regexp_replace(text, _URL, " ")))), lambda x: is_tld(F.substring_index(x["value"], ".", -1), tlds))
    of = {
        "ipv4": lambda: every("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), "technique": lambda: every("technique", r"(?i)\bT1\d{3}(?:\.\d{3})?\b"), "cve": lambda: every("cve", r"(?i)\bCVE-\d{4}-\d{4,7}\b"),
        "url": urls, "domain": names,
    }
    return F.array_sort(F.array_distinct(F.concat(*[of[k]() for k in kinds])))


def context_facts(text: Column, tlds: tuple[str, ...] | None = None) -> Column:
    """The same of a context, where the host of a URL also stands for its domain or address."""
    found = facts(text, tlds)
    hosts = F.transform(F.filter(found, lambda x: x["kind"] == "url"), lambda x: url_part(x["value"], "host"))
    hosts = F.transform(F.filter(hosts, lambda h: h != ""), lambda h: F.struct(F.when(h.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ipv4").otherwise("domain").alias("kind"), h.alias("value")))
    return F.array_sort(F.array_union(found, hosts))


def source_type(mode: Column, url: Column, blog_hosts: tuple[str, ...] = ()) -> Column:
    """report for a PDF, blog for the host of a known vendor, else unknown."""
    return F.when(mode == "pdf", "report").when(url_part(url, "host").isin(*blog_hosts) if blog_hosts else F.lit(False), "blog").otherwise("unknown")


def is_valid_name(name: Column, category: Column) -> Column:
    """Long enough for its category, not cut off, and no placeholder."""
    least = F.when(category.isin("threat_actors", "malware_families"), 3).otherwise(2)
    return (F.length(name) >= least) & ~name.rlike(r"…|\.\.\.") & ~name.rlike(r"(?iU)\b(?:unknown|unnamed|unidentified)\b")


#: What a message says that tells of the network, in lower case.
TRANSIENT = (
    "name resolution", "cannot resolve", "temporary failure", "not reachable", "timed out", "timeout", "connection refused", "connection reset", "connection aborted", "connection error",
    "max retries", "502", "503", "504", "bad gateway", "service unavailable", "gateway time",
)


def is_transient(message: Column) -> Column:
    """Whether a failure came from the network, so that the URL is tried again."""
    said = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*map(F.lit, TRANSIENT)), lambda sign: F.contains(said, sign))
