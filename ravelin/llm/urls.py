"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And mask: a bit per literal character, a self-loop where a star
follows. One step per byte moves every rule at once, for a whole batch of canonical URLs (host and path) in numpy.
Rules see a separator between host and path; the blocking globs see both as one string.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands between host and path where rules are matched; no UTF-8 text holds this byte.
SEPARATOR = b"\xff"


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host with its subdomains, and the paths that start with a prefix."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[bytes, ...]:
        """Over host, SEPARATOR and path: what the leading star stands for ends in the host."""
        own = self.host.encode() + SEPARATOR + self.path.encode()
        return own + b"*", b"*." + own + b"*"


#: The rules of the query.
RULES = (UrlRule("com", "/en/", "block"), UrlRule("example.com", "/en/7", "allow"), UrlRule("net", "/de/", "allow"), UrlRule("example.net", "/de/8", "block"), UrlRule("org", "/es/", "block"))
#: Globs over host and path that block where no rule fits: signs of spam and of files that hold no text.
BLOCKED = (
    "spam-*", "*.spam-*", "*cheap-pills*", "*casino*", "*-escorts.*", "*viagra*", "*.doubleclick.net/*", "*/adserver/*", "*/wp-login*", "*/wp-admin/*", "*/cgi-bin/*", "*/xmlrpc.php", "*/login/", "*/signup/", "*/cart/*",
    "*/checkout/*", "*.exe", "*.msi", "*.apk", "*.dmg", "*.iso", "*.zip", "*.rar", "*.gz", "*.jpg", "*.jpeg", "*.png", "*.gif", "*.webp", "*.svg", "*.ico", "*.mp3", "*.mp4", "*.avi", "*.css", "*.js", "*.woff", "*.woff2",
)


class GlobSet:
    """Globs (literals and *, matching whole strings of bytes) as masks over `words` 64-bit words."""

    def __init__(self, globs: list[str] | list[bytes]):
        bits: list[tuple[int, bool]] = []  # (byte, whether a star follows) of each literal
        self.first, self.free, self.last, self.empty = [], [], [], []
        for glob in globs:
            data = glob.encode() if isinstance(glob, str) else glob
            literal = data.replace(b"*", b"")
            self.empty.append(not literal)
            self.first.append(len(bits))
            self.free.append(data[:1] == b"*")
            for k, byte in enumerate(data):
                if byte != 42:
                    bits.append((byte, data[k + 1 : k + 2] == b"*"))
            self.last.append(len(bits) - 1)
        self.n = len(globs)
        self.words = max(1, -(-len(bits) // 64))
        self.on = np.zeros((256, self.words), np.uint64)
        self.loops, self.begin, self.always = (np.zeros(self.words, np.uint64) for _ in range(3))
        put = lambda mask, k: mask.__setitem__(k >> 6, mask[k >> 6] | np.uint64(1 << (k & 63)))
        for k, (byte, star) in enumerate(bits):
            put(self.on[byte], k)
            if star:
                put(self.loops, k)
        for first, free, empty in zip(self.first, self.free, self.empty, strict=True):
            if not empty:
                put(self.begin, first)
                if free:
                    put(self.always, first)

    def match(self, strings: list[bytes]) -> np.ndarray:
        """A row per string, a column per glob: whether the glob matches the whole string."""
        size = np.fromiter(map(len, strings), np.int64, count=len(strings))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        flat = np.frombuffer(b"".join(strings[k] for k in order), np.uint8)
        start = np.cumsum(size) - size
        state = np.zeros((len(strings), self.words), np.uint64)
        live = len(strings)
        for at in range(int(size[0]) if live else 0):
            live = int(np.searchsorted(-size[:live], -at, side="left"))  # strings that are longer than at
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= ~self.begin
            moved |= self.begin if at == 0 else self.always
            state[:live] = moved & self.on[flat[start[:live] + at]] | now & self.loops
        out = np.zeros((len(strings), self.n), bool)
        for k, (last, empty) in enumerate(zip(self.last, self.empty, strict=True)):
            out[order, k] = (size == 0) | self.free[k] if empty else (state[:, last >> 6] >> np.uint64(last & 63) & np.uint64(1)).astype(bool)
        return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null or a url without ://."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    pick = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return F.translate(pick(1), _UPPER, _LOWER), pick(2)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """id_col, host, path, rule, verdict, matched for every row of pages.

    The longest rule that fits decides (at equal length the first); without one, any blocking glob blocks and is
    named in matched. Null urls have empty parts and are allowed. Other columns are ignored; repeated rows stay."""
    globs = [(g, r) for r in rules for g in r.globs]
    host, path = parts(F.col(url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, by_sign = GlobSet([g for g, _ in globs]), GlobSet(list(blocked))
        by_length = sorted(rules, key=lambda r: -len(r.name))
        for batch in batches:
            pairs = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
            strings = [h + p for h, p in pairs]
            hit, sign = by_rule.match([h + SEPARATOR + p for h, p in pairs]), by_sign.match(strings)
            rule = np.full(len(strings), None, object)
            verdict = np.full(len(strings), "allow", object)
            glob = np.full(len(strings), None, object)
            for k in reversed(range(len(blocked))):
                at = sign[:, k]
                verdict[at], glob[at] = "block", blocked[k]
            for r in reversed(by_length):
                at = hit[:, [k for k, (_, of) in enumerate(globs) if of is r]].any(axis=1)
                rule[at], verdict[at], glob[at] = r.name, r.verdict, None
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.string()) for c in (rule, verdict, glob))], names=[id_col, "host", "path", "rule", "verdict", "matched"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col), host.alias("_host"), path.alias("_path"))
    rows = rows.select(id_col, "_host", "_path", F.col("_host").cast("binary").alias("_h"), F.col("_path").cast("binary").alias("_p"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, matched string")
