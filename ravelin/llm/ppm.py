"""Language-model scores by prediction by partial matching over bytes, with a word model beside them.

The text is scored as its lower-case words, a space between two and an end sign after the last, byte by byte. All
training texts are counted in Spark, for contexts of five bytes and then of one byte less at a time; every context
that occurs stays in these tables. Escape estimates are those of method D, and a symbol that a longer context has seen
is excluded from the shorter ones.

The trie is fixed after training, so each byte after five others has one code length. Those of the most frequent
places (bytes with their contexts, HEAD of them at most) are sent to all executors as sorted arrays and looked up for
whole batches at a time. The other places of a text leave the task as packed bytes; Spark works out their code lengths
from the tables, each distinct one once, and joins them back. A place is sent if it has a share of all training places,
so the others are a share of the input that doesn't rise with its size. The bounds move work between the two ways;
scores don't depend on them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fold, in_batches, runs_by_size, stored
from .language import Hashes

ORDER = 5
#: Places whose code lengths are sent to all executors at most (12 bytes each on the way, some 40 where they are used); the slots by which they are found.
HEAD, SLOT_BITS = 1_500_000, 21
#: Places with less than this share of all training places are not sent, so that the places left grow no faster than the input.
HEAD_SHARE = 2e-8
_TOP = np.uint64(64 - SLOT_BITS)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words with at least this share of all training tokens are sent to all executors: 100,000 words at most.
COMMON_SHARE = 1e-5
#: Start padding and end sign; words and the spaces between them never hold it.
EDGE = 10
_PAD = bytes([EDGE]) * ORDER


#: Bytes that are worked on at once (some 60 bytes of memory each), and words that are counted before they are sent on.
PIECE, COUNTED = 1 << 19, 150_000


def _pieces(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts (as words) in pieces: bytes with ORDER bytes of context before each, the places that are predicted, and the text of each place."""
    bodies = [b" ".join(words) + bytes([EDGE]) for words in texts]
    for part in runs_by_size([len(b) + ORDER for b in bodies], PIECE):
        sizes = np.fromiter(map(len, bodies[part]), np.int64, count=part.stop - part.start)
        flat = np.frombuffer(b"".join(x for b in bodies[part] for x in (_PAD, b)), np.uint8)
        starts = np.cumsum(sizes + ORDER) - sizes
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        of = np.repeat(np.arange(part.start, part.stop), sizes)
        for k in range(0, len(at), PIECE):  # a text that is larger alone
            own = at[k : k + PIECE]
            low = own[0] - ORDER
            yield flat[low : own[-1] + 1], own - low, of[k : k + PIECE]


def _count(docs: DataFrame) -> DataFrame:
    """(word, gram, n) over all texts: words as binary, with null for the end sign; grams of ORDER + 1 bytes packed in a long.

    A task sums what it meets until it holds COUNTED words or grams that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams, n, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            ends += batch.num_rows
            for part in by_bytes(batch, 0, 2 << 20):
                texts = [(t or b"").lower().split() for t in part.column(0).to_pylist()]
                for t in texts:
                    words.update(t)
                if len(words) > COUNTED:
                    yield counted(list(words.keys()), list(words.values()))
                    words.clear()
                for flat, at, _ in _pieces(texts):
                    code, count = np.unique(_packed(flat, at), return_counts=True)
                    grams.append(code)
                    n.append(count)
                    if sum(map(len, grams)) > 4 * COUNTED:
                        code, count = summed(grams, n)
                        if len(code) > 2 * COUNTED:
                            yield places(code, count)
                            code, count = code[:0], count[:0]
                        grams, n = [code], [count]
        if ends:
            yield places(*summed(grams, n))
            yield counted([*words.keys(), None], [*words.values(), ends])

    def summed(grams: list, n: list) -> tuple[np.ndarray, np.ndarray]:
        code, count = np.concatenate(grams), np.concatenate(n)
        order = np.argsort(code, kind="stable")
        code, count = code[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, int)
        return code[first], np.add.reduceat(count, first) if len(code) else count

    def places(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.binary()), pa.array(code), pa.array(n)], names=["word", "gram", "n"])

    def counted(keys: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.nulls(len(keys), pa.int64()), pa.array(n, pa.int64())], names=["word", "gram", "n"])

    return in_batches(docs.select("_text"), run, "word binary, gram bigint, n bigint").groupBy("word", "gram").agg(F.sum("n").alias("n"))


class Head:
    """Code lengths of the frequent places, the most frequent first, found by a hash of their packed bytes.

    The leading bits of a hash lead to a slot that holds the most frequent of its places; the others stand in a sorted
    array. The slots are made where the object is used."""

    def __init__(self, keys: np.ndarray, cost: np.ndarray):
        self.keys, self.cost = keys, cost
        slot = keys >> _TOP
        _, first = np.unique(slot, return_index=True)
        self.slot = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slot_cost = np.zeros(1 << SLOT_BITS, np.float32)
        self.slot[slot[first]], self.slot_cost[slot[first]] = keys[first], cost[first]
        others = np.delete(np.arange(len(keys)), first)
        others = others[np.argsort(keys[others])]
        self.others, self.others_cost = Hashes(keys[others]), np.append(cost[others], np.float32(0))

    def __reduce__(self):
        return Head, (self.keys, self.cost)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code length of each place, 0 for those that aren't here, and which those are."""
        slot = key >> _TOP
        cost, here = self.slot_cost[slot], self.slot[slot] == key
        miss = np.flatnonzero(~here | (key == 0))  # an empty slot holds 0
        place = self.others.find(key[miss])
        cost[miss] = self.others_cost[place]  # -1 takes the last, which is 0
        return cost, miss[place < 0]

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text over the places that are here; the other places of all texts, packed, and their number in each text."""
        total, left = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        codes = [np.empty(0, np.int64)]
        for flat, at, of in _pieces(texts):
            code = _packed(flat, at)
            cost, out = self.find(code.view(np.uint64) * _MIX)
            total += np.bincount(of, cost, minlength=len(texts))
            codes.append(code[out])
            left += np.bincount(of[out], minlength=len(texts))
        return total, np.concatenate(codes), left


def _packed(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes at some places and the ORDER bytes before them in one number each, the latest lowest."""
    code = flat[ORDER:].astype(np.int64)
    for k in range(1, ORDER + 1):
        code |= flat[ORDER - k : len(flat) - k].astype(np.int64) << (8 * k)
    return code[at - ORDER]


@dataclass
class Words:
    """Add-0.1 estimates of the common words; rarer ones are joined from the counted table."""

    place: dict[bytes, int]
    logs: np.ndarray


def _levels(grams: DataFrame) -> list[DataFrame]:
    """(context, byte, n) for each length of context, each counted from the one that is a byte longer."""
    here = grams.select(F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n")
    levels = [here]
    for k in range(ORDER - 1, -1, -1):
        shorter = here.select(F.col("context").bitwiseAND(F.lit(256**k - 1).cast("bigint")).alias("context"), "byte", "n")
        here = stored(shorter.groupBy("context", "byte").agg(F.sum("n").alias("n")), "contexts")
        levels.append(here)
    return levels[::-1]


def _head(longest: DataFrame, most: int, share: float = HEAD_SHARE) -> Head:
    """The code lengths of the places that have at least the share of all and occur so often that they are `most` or fewer."""
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = longest.groupBy(step.alias("step")).agg(F.count("*").alias("count"), F.sum("n").alias("n")).collect()  # eight rows for each power of two
    by_step, floor = {r["step"]: r["count"] for r in steps}, share * sum(r["n"] for r in steps)
    held, least = 0, max(by_step, default=-1) + 1
    while least > 0 and held + by_step.get(least - 1, 0) <= most:
        least -= 1
        held += by_step.get(least, 0)
    totals = longest.groupBy("context").agg(F.sum("n").alias("total"))
    gram = F.call_function("shiftleft", F.col("context"), F.lit(8)) + F.col("byte")
    rows = longest.where((step >= least) & (F.col("n") >= floor)).join(totals, "context").select(gram.alias("gram"), "n", F.log10((F.col("n") - 0.5) / F.col("total")).cast("float").alias("cost")).toArrow()  # `most` at most
    order = np.argsort(-rows["n"].to_numpy(), kind="stable")
    return Head((rows["gram"].to_numpy().view(np.uint64) * _MIX)[order], rows["cost"].to_numpy()[order])


def _costs(places: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(gram, cost): the code length, as log10 probability, of the last byte after the others, for each distinct packed place.

    From the longest context down: where it has seen the byte, its share of what longer ones have not excluded; else an
    escape. What a context excludes from the next is `below`, the count that its bytes have there."""
    state = places.select("gram", F.lit(0.0).alias("cost"), F.lit(False).alias("done"), F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("kinds"))
    done: DataFrame | None = None
    for k in range(ORDER, -1, -1):
        here = F.shiftright("gram", 8).bitwiseAND(F.lit(256**k - 1).cast("bigint"))
        state = state.withColumns({"context": here, "byte": F.col("gram").bitwiseAND(F.lit(255)).cast("int")})
        own = levels[k].join(state.select("context").distinct(), "context", "left_semi")
        if k:
            shorter = levels[k - 1].select(F.col("context").alias("suffix"), "byte", F.col("n").alias("m"))
            own = own.withColumn("suffix", F.col("context").bitwiseAND(F.lit(256 ** (k - 1) - 1).cast("bigint"))).join(shorter, ["suffix", "byte"])
        else:
            own = own.withColumn("m", F.lit(0).cast("bigint"))
        # a context has 256 bytes at most, so its counts travel as one row
        counts = F.map_from_entries(F.collect_list(F.struct("byte", "n")))
        sums = own.groupBy("context").agg(F.sum("n").alias("_total"), F.count("*").alias("_kinds"), F.sum("m").alias("_below"), counts.alias("_of"))
        found = state.join(sums, "context", "left").withColumn("_n", F.try_element_at("_of", F.col("byte")))
        rest, new = F.col("_total") - F.col("below"), F.col("_kinds") - F.col("kinds")
        escape = F.when(rest > 0, F.log10(new / 2 / rest)).otherwise(F.lit(0.0))
        hit = F.col("_n").isNotNull()
        cost = F.col("cost") + F.when(hit, F.log10((F.col("_n") - 0.5) / rest)).when(F.col("_total").isNotNull(), escape).otherwise(F.lit(0.0))
        if not k:
            cost = F.when(hit, cost).otherwise(cost - F.log10(256 - F.coalesce("_kinds", F.lit(0))))
        after = stored(found.select("gram", cost.alias("cost"), hit.alias("done"), F.coalesce("_below", "below").alias("below"), F.coalesce("_kinds", "kinds").alias("kinds")), "places")
        ended = after.where("done" if k else "true").select("gram", "cost")
        done = ended if done is None else done.unionByName(ended)
        state = after.where("not done")
    return done


def _train(docs: DataFrame, head: int = HEAD) -> tuple[Head, list[DataFrame], Words, DataFrame, dict]:
    """The frequent places, the counts of all contexts, the common words, the counts of the others by hash, and the totals."""
    counted = stored(_count(docs), "counted")
    words = counted.where("gram is null")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("texts")).first().asDict()
    levels = _levels(counted.where("gram is not null"))
    frequent = _head(levels[ORDER], head)
    least = totals["tokens"] * COMMON_SHARE
    words = words.where("word is not null")
    common = words.where(F.col("n") >= least).select("word", "n").toArrow()
    place = {w: k for k, w in enumerate(common["word"].to_pylist())}
    logs = np.log10(common["n"].to_numpy() + 0.1)
    rare = words.where(F.col("n") < least).select(F.xxhash64("word").alias("hash"), F.col("n").alias("c"))
    return frequent, levels, Words(place, logs), rare, totals


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, out: int = 0, head: int = HEAD) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Training takes the rows outside the fold `out`, those with a null id included. Null texts are empty: their only
    token is the end. Rare words meet their counts by a 64-bit hash. Without any training row all words are unknown
    and all bytes equally likely. Other columns are ignored; repeated rows each count and come back. head bounds what
    is sent to all executors; the scores don't depend on it."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    frequent, levels, words, rare, totals = _train(rows.where(fold(F.col("_id"), folds) != out), head)
    context = docs.sparkSession.sparkContext
    model = context.broadcast((frequent, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, words = model.value
        logs = np.append(words.logs, 0.0)
        for batch in batches:
            for part in by_bytes(batch, 2, 2 << 20):
                texts = [(t or b"").lower().split() for t in part.column(2).to_pylist()]
                n, known, sums, cuts, hashes = [], [], [], [0], []
                for t in texts:
                    at = np.fromiter(map(words.place.get, t, repeat(-1)), np.int64, count=len(t))
                    off = np.flatnonzero(at < 0)
                    n.append(len(t) + 1)
                    known.append(len(t) - len(off))
                    sums.append(float(logs[at].sum()))
                    hashes += [xxhash.xxh64_intdigest(t[k], 42) for k in off]
                    cuts.append(len(hashes))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)))
                total, codes, left = frequent.score(texts)
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), pa.array(codes))
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(total), lists, places]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "_id", "n_tokens", "known", "logs", "score", "rare", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_text")
    scored = stored(in_batches(numbered, run, f"_row bigint, _id {kind}, n_tokens bigint, known bigint, logs double, score double, rare array<bigint>, places array<bigint>"), "scored")
    asked = scored.select("_row", F.explode("rare").alias("hash"))
    found = asked.join(rare, "hash").groupBy("_row").agg(F.count("*").alias("found"), F.sum(F.log10(F.col("c") + 0.1)).alias("found_logs"))
    left = scored.select("_row", F.explode("places").alias("gram"))
    costs = _costs(left.select("gram").distinct(), levels)
    priced = left.join(costs, "gram").groupBy("_row").agg(F.sum("cost").alias("rest"))
    zero = F.lit(0).cast("bigint")
    total = float(totals["tokens"]) + 0.1 * (totals["kinds"] + 1)
    end_logs = float(np.log10(totals["texts"] + 0.1))
    found_n = F.coalesce("found", zero)
    unknown = F.col("n_rare") - found_n
    base = F.col("logs") + F.coalesce("found_logs", F.lit(0.0)) + unknown * F.lit(float(np.log10(0.1))) + F.lit(end_logs) - F.col("n_tokens") * F.lit(float(np.log10(total)))
    scored = scored.withColumn("n_rare", F.size("rare")).drop("rare", "places")
    return scored.join(found, "_row", "left").join(priced, "_row", "left").select(
        F.col("_id").alias(id_col),
        (fold(F.col("_id"), folds) == out).alias("held_out"),
        "n_tokens",
        (F.col("known") + found_n + F.lit(int(totals["texts"] > 0))).alias("n_known"),
        F.lit(int(totals["tokens"])).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
