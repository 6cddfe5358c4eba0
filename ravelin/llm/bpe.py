"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be its last: the token t that matches at the end and whose
predecessor, the last token of the prefix before it, may stand beside t, meaning that merging the two tokens'
text gives the same two tokens back. An automaton over the vocabulary lists the tokens that end at each place,
longest first; the token that passes the pair test is stored, and following the stored tokens back from the end
gives the ids. Words that repeat are encoded once per worker while they stay in a bounded memory.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, in_batches

#: How the vocabulary file cuts a lower-case text into words.
_WHITE = r"\t-\r \x85\xA0  -     　"
WORDS = r"\p{L}+|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^" + _WHITE + r"\p{L}\p{N}]+"
#: The same for texts that hold ASCII and common Latin letters only, where it is twice as fast.
PLAIN = r"[\x00-\x7Fß-öø-ÿ]*"
PLAIN_WORDS = r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-zß-öø-ÿ0-9]+"
#: Marks the last byte of a word inside the automaton; no byte is written so.
END = "\x00"
#: Bytes that each of a worker's two generations of words takes at most, and pairs of tokens that it remembers.
MEMORY, PAIRS = 48 << 20, 300_000
#: How the vocabulary file normalises and cuts texts, which WORDS and normal() follow.
CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}


class _Memory(dict):
    """Values by word, made when they are missing; the older generation goes when the younger is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.size = make, {}, 0

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if self.size >= MEMORY:
            self.old, self.size = dict(self), 0
            self.clear()
        self[word] = value
        self.size += 200 + 2 * len(word) + len(value)
        return value


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        for part, known in CUTS.items():
            if spec.get(part) != known:
                raise ValueError(f"{path}: {part} is not the one that this encoder follows")
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.merged = {(vocab[a], vocab[b]): (k, vocab[a + b]) for (a, b), k in self.rank.items()}
        self.parts = {t: (k, a, b) for (a, b), (k, t) in self.merged.items()}
        self.letters = _byte_letters()
        self.tokens = ahocorasick.Automaton()
        for token, i in vocab.items():
            form = token[: -len(suffix)] + END if token.endswith(suffix) else token
            self.tokens.add_word(form, (len(form), i))
        self.tokens.make_automaton()
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.plain, self.plain_words = re.compile(PLAIN), re.compile(PLAIN_WORDS)
        self.fits: dict[int, bool] = {}
        self.packed = _Memory(lambda word: array("I", self.encode_word(word)).tobytes())
        self.bytes = [self.text[i].encode() for i in range(len(self.text))]

    def stands(self, left: int, right: int) -> bool:
        """Whether merging the text of two neighbours gives just these two tokens.

        Undo merges next to the border, latest first. A merge across the border that comes before the one undone
        last would have been made instead; at equal rank the one further left is made first."""
        limit, from_left = float("inf"), False
        while True:
            across = self.merged.get((left, right))
            if across and (across[0] < limit or across[0] == limit and not from_left):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # of two equal merges the left one was made first, so the right one is undone first
            if b is None or a is not None and a[0] > b[0]:
                limit, left, from_left = a[0], a[2], True
            else:
                limit, right, from_left = b[0], b[1], False

    def encode_word(self, word: str) -> list[int]:
        form = "".join(map(self.letters.__getitem__, word.encode())) + END
        last = [0] * (len(form) + 1)
        size = [0] * (len(form) + 1)
        fits = self.fits
        for end, (n, token) in self.tokens.iter(form):
            stop = end + 1
            if size[stop]:
                continue
            if n <= end:
                before = stop - n
                if not size[before]:
                    continue
                pair = last[before] << 32 | token
                good = fits.get(pair)
                if good is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    good = fits[pair] = self.stands(last[before], token)
                if not good:
                    continue
            last[stop], size[stop] = token, n
        if not size[-1]:
            raise ValueError(f"no tokens of the vocabulary give the word {word!r}")
        ids, at = [], len(form)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def decode(self, ids) -> str:
        """The tokens' text, joined by spaces: the file names no decoder."""
        return self.decode_bytes(ids).decode()

    def decode_bytes(self, ids) -> bytes:
        return b" ".join(map(self.bytes.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, decoded text in UTF-8) of a whole text."""
        packed: list[bytes] = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                packed.append(struct.pack("<I", self.special[part]))
            elif part:
                part = normal(part)
                words = (self.plain_words if self.plain.fullmatch(part) else self.words).findall(part)
                packed += map(self.packed.__getitem__, words)
        ids = b"".join(packed)
        return ids, self.decode_bytes(array("I", ids))


def normal(text: str) -> str:
    """NFC and lower case, letter by letter (a final sigma is no special case)."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


_MODELS: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """The vocabulary of a file, read once per Python process."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids (array of int), for every row of docs.

    path: the vocabulary file, on every executor. Null texts are empty: no ids, and the digests of no bytes.
    Repeated rows each come back; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for part in by_bytes(batch, 1):  # some texts at a time, so their ids don't pile up
                both = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                columns = [
                    part.column(0),
                    pa.array([len(p) // 4 for p, _ in both], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p, _ in both], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for _, d in both], pa.string()),
                ]
                if with_ids:
                    cuts, flat = [0], b"".join(p for p, _ in both)
                    for p, _ in both:
                        cuts.append(cuts[-1] + len(p) // 4)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return in_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, schema)
