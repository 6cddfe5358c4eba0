"""Language identification by interpolated Kneser-Ney models of characters.

Each language has a model over letters (all else is one boundary sign). The n-grams of all languages stand in one
sorted array of hashes per order, found through a table of their leading bits, with a row of log probabilities,
one per language. A text is given the language of the lowest cross-entropy per character. The models are fitted on
a bounded sample: `max_docs` texts and `max_chars` characters of each language (3,000 and 12 million unless set). A
fifth of the texts only calibrates the temperature of the scores and the cross-entropy beyond which a text is marked
as rejected; of a language with few texts all are learned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fold, in_batches, runs_by_size, share_of, stored

ORDER = 4
#: Signs that are scored at once (some 100 bytes of memory each).
PIECE = 1 << 19
MAX_DOCS, MAX_CHARS = 3_000, 12_000_000
#: Sampled texts of a language from which on a fifth of them calibrates.
CALIBRATES = 50
UNKNOWN = "und"
_M, _MIX, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(44)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once per process."""
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _LETTER[0]


def signs(text: str) -> np.ndarray:
    """Code points of the lower-case letters; each run of other characters, and either end, is one 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(0))
    codes = np.concatenate([codes, np.zeros(1, np.uint32)])
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[0] = codes[0] != 0
    return codes[keep]


def _hash(columns) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h + c + np.uint64(1)) * _M
        h ^= h >> np.uint64(29)
    return h * _MIX


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows by their hashes, the place of each row among them, and how often each occurs."""
    _, first, to, n = np.unique(_hash(list(grams.T)), return_index=True, return_inverse=True, return_counts=True)
    return grams[first], to, n


def _summed(to: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values added up by their place."""
    return np.stack([np.bincount(to, values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


class Hashes:
    """Sorted 64-bit hashes, found by a table of their 20 leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        self.start = np.searchsorted(keys, np.arange(1 << 20, dtype=np.uint64) << _TOP).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(keys)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        top = (h >> _TOP).astype(np.int32)
        at, end = self.start[top], self.start[top + 1]
        out = np.where((self.keys[at] == h) & (at < end), at, np.int32(-1))
        left = np.flatnonzero((out < 0) & (end - at > 1))
        while len(left):
            at[left] += 1
            good = self.keys[at[left]] == h[left]
            out[left[good]] = at[left[good]]
            left = left[~good & (end[left] - at[left] > 1)]
        return out


@dataclass
class Models:
    languages: list[str]
    grams: list[Hashes] = field(default_factory=list)  # by order, from 1
    logs: list[np.ndarray] = field(default_factory=list)  # row per gram, column per language
    contexts: list[Hashes] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)  # row per context
    floor: float = 0.0
    temperature: float = 10.0
    limits: np.ndarray | None = None

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per sign (row per text, column per language), and the number of letters."""
        parts = [signs(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        letters = np.array([np.count_nonzero(p) for p in parts], np.int64)
        sums = np.zeros((len(texts), len(self.languages)))
        context = len(self.grams) - 1
        for k, part in enumerate(parts):  # a long text in pieces, each after the signs before it
            if len(part) > PIECE:
                padded = np.concatenate([np.zeros(context, np.uint32), part])
                for start in range(0, len(part), PIECE):
                    sums[k] += self._sums([padded[start : start + PIECE + context]], False)[0]
                parts[k] = part[:0]
        for run in runs_by_size([len(p) for p in parts], PIECE):
            sums[run] += self._sums(parts[run], True)
        return -sums / np.maximum(sizes, 1)[:, None], letters

    def _sums(self, parts: list[np.ndarray], pads: bool) -> np.ndarray:
        """Summed log probabilities; without pads the first signs of each part are only context."""
        order = len(self.grams)
        pad = np.zeros(order - 1 if pads else 0, np.uint32)
        sizes = np.array([len(p) - (0 if pads else order - 1) for p in parts])
        flat = np.concatenate([x for p in parts for x in (pad, p)]).astype(np.uint64)
        starts = np.cumsum(sizes + order - 1) - sizes
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        logs = self._logs([flat[at - k] for k in range(order - 1, -1, -1)], order)
        begin = np.cumsum(sizes) - sizes
        sums = np.zeros((len(parts), len(self.languages)))
        full = sizes > 0
        if full.any():
            sums[full] = np.add.reduceat(logs, begin[full], axis=0)
        return sums

    def _logs(self, columns: list[np.ndarray], k: int) -> np.ndarray:
        place = self.grams[k - 1].find(_hash(columns))
        out = self.logs[k - 1][place]  # -1 takes the last row, which is replaced below
        miss = np.flatnonzero(place < 0)
        if len(miss):
            rest = [c[miss] for c in columns]
            lower = self._logs(rest[1:], k - 1) if k > 1 else self.floor + np.repeat(self.backoff[0][:1], len(miss), axis=0)
            if k > 1:
                context = self.contexts[k - 1].find(_hash(rest[:-1]))
                lower = lower + np.where((context >= 0)[:, None], self.backoff[k - 1][context], np.float32(0))
            out[miss] = lower
        return out


def fit(grams: np.ndarray, counts: np.ndarray, languages: list[str]) -> Models:
    """Kneser-Ney models of distinct n-grams (a row of code points each) and their counts by language."""
    order = grams.shape[1]
    levels = [(grams.astype(np.uint64), counts.astype(np.float64))]
    for _ in range(order - 1):  # a shorter gram counts once for each different sign before it
        g, c = levels[-1]
        shorter, to, _ = _distinct(g[:, 1:])
        levels.append((shorter, _summed(to, c > 0, len(shorter))))
    levels.reverse()
    signs_seen = len(levels[0][0]) + 1
    models = Models(languages, floor=float(np.log2(1 / signs_seen)))
    below, below_keys = np.full((1, len(languages)), 1 / signs_seen), None
    for k, (g, c) in enumerate(levels, 1):
        once, twice = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        discount = np.where(once + twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        discount = np.clip(discount, 0.1, 0.95)
        key, context = _hash(list(g.T)), _hash(list(g[:, :-1].T)) if k > 1 else np.zeros(len(g), np.uint64)
        contexts, of = np.unique(context, return_inverse=True)
        total, types = _summed(of, c, len(contexts)), _summed(of, c > 0, len(contexts))
        weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        lower = below[below_keys.find(_hash(list(g[:, 1:].T)))] if k > 1 else np.broadcast_to(below[0], c.shape)
        chance = np.maximum(c - discount, 0) / np.maximum(total[of], 1) + weight[of] * lower
        by_key = np.argsort(key)
        models.grams.append(Hashes(key[by_key]))
        models.logs.append(np.log2(chance[by_key]).astype(np.float32))
        models.contexts.append(Hashes(contexts))
        models.backoff.append(np.log2(weight).astype(np.float32))
        below, below_keys = chance[by_key], models.grams[-1]
    return models


def _sample(docs: DataFrame, max_docs: int, max_chars: int, folds: int, out: int) -> DataFrame:
    """(lang, text, part): of each language at most about max_docs texts and max_chars characters from the training folds.

    Part 0 calibrates: a fifth of the texts of a language that has CALIBRATES of them in the sample, none of others."""
    rows = docs.select(F.col("_id"), "_text", "_lang").where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (fold(F.col("_id"), folds) != out))
    choice = None
    for lang, n, chars in sorted(rows.groupBy("_lang").agg(F.count("*"), F.sum(F.length("_text"))).collect()):
        share = min(1.0, max_docs / n, max_chars / max(1, chars))
        part = F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(5)) if n * share >= CALIBRATES else F.lit(1)
        own = (F.col("_lang") == lang) & share_of(share, F.col("_id"), F.lit("language"))
        choice = F.when(own, part) if choice is None else choice.when(own, part)
    rows = rows.withColumn("part", F.lit(None).cast("int") if choice is None else choice.cast("int"))
    return rows.where("part is not null").select(F.col("_lang").alias("lang"), "_text", "part")


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, folds: int = 3, out: int = 1) -> Models:
    sample = _sample(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")), max_docs, max_chars, folds, out)
    sample = stored(sample, "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.zeros(ORDER - 1, np.uint32)
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(names)):
                own = [t for t, mine in zip(texts, names == lang, strict=True) if mine]
                for some in runs_by_size(list(map(len, own)), PIECE):
                    parts = [signs(t) for t in own[some]]
                    wins = [np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, p]), ORDER) for p in parts if len(p)]
                    if wins:
                        grams, _, n = _distinct(np.concatenate(wins))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), *(pa.array(grams[:, k].astype(np.int32)) for k in range(ORDER)), pa.array(n)], names=["lang", *cols, "n"])

    cols = [f"c{k}" for k in range(ORDER)]
    counted = in_batches(sample.where("part > 0").select("lang", "_text"), count, "lang string, " + ", ".join(f"{c} int" for c in cols) + ", n bigint")
    rows = counted.groupBy("lang", *cols).agg(F.sum("n").alias("n")).toArrow()  # max_chars rows of each language at most
    if not rows.num_rows:
        return Models([])
    names = rows["lang"].combine_chunks().dictionary_encode()
    own = names.dictionary.to_pylist()
    languages = sorted(own)
    grams, to, _ = _distinct(np.stack([rows[c].to_numpy().astype(np.uint32) for c in cols], axis=1))
    counts = np.zeros((len(grams), len(languages)))
    counts[to, np.array([languages.index(x) for x in own])[names.indices.to_numpy()]] = rows["n"].to_numpy()  # each pair once
    models = fit(grams, counts, languages)
    _calibrate(models, sample.where("part = 0").select("lang", "_text"))
    return models


def _calibrate(models: Models, sample: DataFrame) -> None:
    """Sets the temperature by likelihood, and per language the entropy that one in 200 right texts exceeds."""
    own = sample.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, letters = own.value.entropies(batch.column(1).to_pylist())
            cuts = np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(h.ravel())), pa.array(letters)], names=["lang", "h", "letters"])

    rows = in_batches(sample, run, "lang string, h array<double>, letters bigint").where("letters > 0").select("lang", "h").toArrow()
    models.limits = np.full(len(models.languages), np.inf)
    place = {lang: k for k, lang in enumerate(models.languages)}
    right = np.array([place.get(lang, -1) for lang in rows["lang"].to_pylist()], int)
    if not (right >= 0).any():
        return
    h = rows["h"].combine_chunks().flatten().to_numpy().reshape(len(right), -1)[right >= 0]
    right = right[right >= 0]
    at = np.arange(len(h))

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_posterior(h, t)[at, right], 1e-9)).mean())

    models.temperature = min((1, 2, 4, 8, 16, 32), key=loss)
    for k in range(len(models.languages)):
        mine = h[right == k, k]
        if len(mine) >= 20:
            models.limits[k] = np.quantile(mine, 0.995) + 0.5


def _posterior(h: np.ndarray, temperature: float) -> np.ndarray:
    z = np.exp(-temperature * (h - h.min(axis=1, keepdims=True)))
    return z / z.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, folds: int = 3, out: int = 1) -> DataFrame:
    """id_col, held_out, lang_pred, score, rejected for every row of docs.

    Null texts and texts without letters get `und` and score 0, as do all without any language to learn. A null id
    is never held out. Ties go to the language that sorts first. rejected marks texts unlike all languages; they
    keep the nearest one at half the score. Other columns are ignored; repeated rows each come back."""
    own = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col, max_docs, max_chars, folds, out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = own.value
        names = np.array([*models.languages, UNKNOWN], object)
        for batch in batches:
            for part in by_bytes(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                if models.languages:
                    h, letters = models.entropies(texts)
                    best, p = h.argmin(axis=1), _posterior(h, models.temperature).max(axis=1)
                    off = (h.min(axis=1) > models.limits[best]) & (letters > 0)
                    best, score = np.where(letters > 0, best, len(names) - 1), np.where(letters > 0, np.where(off, p / 2, p), 0.0)
                else:
                    best, score, off = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(off)], names=[id_col, "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = in_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
    return found.select(id_col, (fold(F.col(id_col), folds) == out).alias("held_out"), "lang_pred", "score", "rejected")
