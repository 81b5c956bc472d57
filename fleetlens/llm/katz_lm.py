"""LM scoring: a bigram model with Katz backoff, Good-Turing discounts and exactly normalised backoff weights.

Every training token is a word of the model. Per token:

    P(w | h) = d(c) * c / c'(h) if c = c(h, w) > 0, else alpha(h) * P(w)        alpha(h) = 1 for an h never seen
    P(w) = c(w) / (N + 1), 1 / (N + 1) for tokens never seen

d is Good-Turing's discount for counts up to DISCOUNTED. alpha(h) makes P(. | h) sum to 1 exactly; c'(h) is c(h), or c(h) + 1 where no count of h is discounted.

Counts cover all training tokens and are kept in partitioned tables: rows of (bucket, sorted keys, counts), a key being a token's 64-bit hash or a pair of
numbers of frequent tokens. Frequent histories are dealt by pair, so no bucket depends on one of them. Pairs with a rare token are kept beside that token: with w's count if w is
rare (side 0), with h's backoff weight if h is (side 1; pairs of two rare tokens on both sides, so each side can tell by itself whether the pair was seen).
To score, documents are packed in chunks; a chunk sends each bucket its keys once, and the documents that have them; the bucket sums each document's log probabilities, and answers with
the sums of the documents that have a key there, so answers are no more than keys however many buckets there are; a chunk's answers meet by chunk. Only arrays of the FREQUENT most frequent tokens are broadcast.

Defined cases: a null text is an empty one (its end alone is scored); with no training text every token is unknown (score: the slot for tokens never seen);
rows are independent, so repeated rows, ids and null ids each get a score (a null id counts as an empty text in choosing training rows);
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import common
from fleetlens.llm.language_id import remainder

FREQUENT, DISCOUNTED = 65_000, 5
EXACT = 4096
CHUNK_TOKENS, CHUNK_DOCS, BUCKET_BYTES = 2_000_000, 60_000, 20_000_000
#: The end's hash, and the bits of a frequent token's number.
END = xxhash.xxh3_64_intdigest(b"\n")
SHIFT = 17


def squeeze(values: np.ndarray) -> bytes:
    """An array of unsigned integers, byte plane by byte plane, compressed."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.compress(np.ascontiguousarray(wide.T).tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data), dtype=np.uint64)


#: Bits of a sum that an answer leaves out; what is left is exact to 2e-9 of it.
SPARED = np.uint64(24)


def sparse_sums(docs: np.ndarray, values: np.ndarray) -> bytes:
    """The sums of values by document, of the documents that occur: their numbers, and sums without the last SPARED bits, rounded."""
    there = common.distinct(docs)
    sums = np.bincount(np.searchsorted(there, docs), values, len(there))
    bits = (sums.view(np.uint64) + (np.uint64(1) << (SPARED - np.uint64(1)))) >> SPARED
    numbers = zstandard.compress(np.diff(there, prepend=there.dtype.type(0)).astype("<u2").tobytes(), 1)
    return len(numbers).to_bytes(4, "little") + numbers + squeeze(bits)


def add_sums(data: bytes, to: np.ndarray) -> None:
    """Adds what sparse_sums() packed to an array of all documents' sums."""
    n = int.from_bytes(data[:4], "little")
    there = np.cumsum(np.frombuffer(zstandard.decompress(data[4 : 4 + n]), "<u2").astype(np.int64))
    to[there] += (expand(data[4 + n :]) << SPARED).view(np.float64)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def counted_keys(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each occurs, or its sum of weights (whole numbers)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)
    return keys[first], np.add.reduceat(weights, first).astype(np.uint64) if len(first) else weights[:0]


class Words:
    """The frequent tokens: hashes with numbers and counts; numbers go by frequency. Other tokens have the number `unknown`."""

    SLOT_BITS = 20

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, hot_from: float):
        self.size = len(hashes)
        self.unknown, self.start = self.size, self.size + 1
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.hot = np.concatenate([counts >= hot_from, [True, True]])
        # By its first bits, a hash meets its slot: the place of the one word there, or -1; hashes of slots with several words are searched.
        slots = (self.hashes >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        self.places = np.full(1 << self.SLOT_BITS, -1, np.int32)
        self.places[slots] = np.arange(self.size, dtype=np.int32)
        several = np.bincount(slots, minlength=1 << self.SLOT_BITS) > 1
        self.places[several] = -2

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(hashes), self.unknown)
        at = self.places[(hashes >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)]
        searched = np.flatnonzero(at == -2)
        at[searched] = np.minimum(np.searchsorted(self.hashes, hashes[searched]), self.size - 1)
        return np.where((at >= 0) & (self.hashes[at] == hashes), self.numbers[at], self.unknown)

    def buckets(self, pairs: np.ndarray, n: int) -> np.ndarray:
        """Of pairs (h << SHIFT | w): by h, or by the pair where h is frequent."""
        h = pairs >> np.uint64(SHIFT)
        return (scramble(np.where(self.hot[h.astype(np.int64)], pairs, h)) % np.uint64(n)).astype(np.int64)


@dataclass
class Chunk:
    rows: list  # of the first column, an Arrow array for each batch
    hashes: np.ndarray
    docs: np.ndarray  # of each token
    sizes: np.ndarray  # tokens of each document


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Tokens of (id, text) batches, whole documents, about CHUNK_TOKENS at a time."""
    rows, hashes, held = [], [], 0
    end = np.array([END], np.uint64)

    def full() -> Chunk:
        sizes = np.array([len(x) + 1 for x in hashes])
        return Chunk(rows, np.concatenate([y for x in hashes for y in (x, end)]), np.repeat(np.arange(len(sizes)), sizes), sizes)

    for batch in batches:
        first = 0
        for i, x in enumerate(common.byte_texts(batch.column(1))):
            own = common.word_hashes(x.translate(common.LOWER) if x else None)
            hashes.append(own)
            held += len(own) + 1
            if held >= CHUNK_TOKENS or len(hashes) >= CHUNK_DOCS:
                rows.append(batch.column(0).slice(first, i + 1 - first))
                yield full()
                first, rows, hashes, held = i + 1, [], [], 0
        if first < batch.num_rows:
            rows.append(batch.column(0).slice(first))
    if hashes:
        yield full()


def pairs_of(chunk: Chunk, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens, and pairs with the token before."""
    numbers = words.number(chunk.hashes)
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[np.cumsum(chunk.sizes) - chunk.sizes] = words.start
    return numbers, before.astype(np.uint64) << np.uint64(SHIFT) | numbers.astype(np.uint64)


def rare_pairs(chunk: Chunk, words: Words, numbers: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By side: hashes of the rare token of each pair (0: w, 1: h), the other token (its number, or its hash if it is rare, too), and which tokens these are."""
    before = (pairs >> np.uint64(SHIFT)).astype(np.int64)
    codes = np.where(numbers == words.unknown, chunk.hashes, numbers.astype(np.uint64))
    codes_before = np.where(before == words.unknown, np.roll(chunk.hashes, 1), before.astype(np.uint64))
    for side, rare, owner, other in ((0, numbers == words.unknown, codes, codes_before), (1, before == words.unknown, codes_before, codes)):
        at = np.flatnonzero(rare)
        yield side, owner[at], other[at], at


def is_number(codes: np.ndarray) -> np.ndarray:
    return codes < np.uint64(1 << SHIFT)


def pair_key(owner: np.ndarray, other: np.ndarray) -> np.ndarray:
    return scramble(owner ^ scramble(other + np.uint64(0x9E3779B97F4A7C15)))


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys: their places in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _cut(buckets: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Of sorted buckets: each one that occurs, with its stretch."""
    ends = np.searchsorted(buckets, np.arange(n), "right")
    for b, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        if i < j:
            yield b, slice(i, j)


COUNTS = "bucket int, keys binary, counts binary"


def bucketed(buckets: np.ndarray, n: int) -> np.ndarray:
    """The order that brings buckets together and keeps what is in each as it is."""
    return np.argsort(buckets.astype(np.uint16) if n < 65_536 else buckets, kind="stable")


def of_counts(counts: np.ndarray) -> list[int]:
    """How many counts there are of 1 to DISCOUNTED + 1."""
    return np.bincount(np.minimum(counts, DISCOUNTED + 2).astype(np.int64), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def counted(docs: DataFrame, n: int) -> DataFrame:
    """COUNTS of all tokens of docs, by the hash's bucket. One row a bucket, with size and tokens."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            keys, counts = counted_keys(chunk.hashes)
            buckets = (keys % np.uint64(n)).astype(np.int64)
            order = bucketed(buckets, n)
            keys, counts = keys[order], counts[order]
            yield batch_of([(b, squeeze_sorted(keys[s]), squeeze(counts[s])) for b, s in _cut(buckets[order], n)], schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = held.setdefault(b, [])
                own.append((expand_sorted(k), expand(c)))
                if sum(len(x[0]) for x in own[1:]) > 4_000_000:  # what is held follows the distinct keys
                    own[:] = [counted_keys(*map(np.concatenate, zip(*own, strict=True)))]
        for b, own in held.items():
            keys, counts = counted_keys(*map(np.concatenate, zip(*own, strict=True)))
            yield batch_of([(b, squeeze_sorted(keys), squeeze(counts), len(keys), int(counts.sum()))], schema.append(pa.field("size", pa.int64())).append(pa.field("tokens", pa.int64())))

    return docs.mapInArrow(parts, COUNTS).repartitionById(n, F.col("bucket")).mapInArrow(merge, f"{COUNTS}, size long, tokens long")


PAIRS = "bucket int, side int, owner binary, other binary, counts binary"
PAIRS_SCHEMA = pa.schema([("bucket", pa.int32()), ("side", pa.int32()), ("owner", pa.binary()), ("other", pa.binary()), ("counts", pa.binary())])
BACKOFF_SCHEMA = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("s", pa.binary()), ("p", pa.binary())])


def counted_pairs(docs: DataFrame, words: Callable[[], Words], n: int) -> DataFrame:
    """PAIRS of all tokens of docs in one pass, one row a bucket and side, and of_counts (pairs of two rare tokens count on side 0 only). Side -1: pairs of frequent tokens,
    `owner` being both numbers and `other` null. Sides 0 and 1: pairs with a rare token, by that token's bucket and sorted by it."""

    def distinct(owner: np.ndarray, other: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((other, owner))
        owner, other = owner[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])])) if len(owner) else order
        sums = np.diff(np.append(first, len(owner))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts
        return owner[first], other[first], sums.astype(np.uint64)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            own = words()
            numbers, pairs = pairs_of(chunk, own)
            keys, counts = counted_keys(pairs[(numbers != own.unknown) & (pairs >> np.uint64(SHIFT) != own.unknown)])
            buckets = own.buckets(keys, n)
            order = bucketed(buckets, n)
            keys, counts = keys[order], counts[order]
            out: list[tuple] = [(b, -1, squeeze_sorted(keys[s]), None, squeeze(counts[s])) for b, s in _cut(buckets[order], n)]
            for side, owner, other, _ in rare_pairs(chunk, own, numbers, pairs):
                owner, other, counts = distinct(owner, other, None)
                buckets = (owner % np.uint64(n)).astype(np.int64)
                order = bucketed(buckets, n)
                owner, other, counts = owner[order], other[order], counts[order]
                out += [(b, side, squeeze_sorted(owner[s]), squeeze(other[s]), squeeze(counts[s])) for b, s in _cut(buckets[order], n)]
            if out:
                yield batch_of(out, PAIRS_SCHEMA)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def merged(side: int, own: list) -> tuple:
            columns = tuple(map(np.concatenate, zip(*own, strict=True)))
            return counted_keys(*columns) if side < 0 else distinct(*columns)

        for batch in batches:
            for b, side, owner, other, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = held.setdefault((b, side), [])
                own.append((expand_sorted(owner), expand(c)) if side < 0 else (expand_sorted(owner), expand(other), expand(c)))
                if sum(len(x[0]) for x in own[1:]) > 4_000_000:
                    own[:] = [merged(side, own)]
        while held:
            (b, side), own = held.popitem()
            owner, *other, counts = merged(side, own)
            new = counts[is_number(other[0])] if side == 1 else counts
            yield batch_of([(b, side, squeeze_sorted(owner), *(map(squeeze, other) if other else [None]), squeeze(counts), of_counts(new))], PAIRS_SCHEMA.append(pa.field("of_counts", pa.list_(pa.int64()))))

    return docs.mapInArrow(parts, PAIRS).repartitionById(n, F.col("bucket")).mapInArrow(merge, f"{PAIRS}, of_counts array<long>")


def backoff(seen: np.ndarray, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """c'(h) and alpha(h) of histories that occur `seen` times, with sums s of discounted counts and p of their words' P(w)."""
    full = 1 - p <= 1e-12  # each word follows h: nothing backs off
    below = np.where(full, s, seen + (s >= seen - 1e-9))
    return below, np.where(full, 1.0, (1 - s / below) / np.where(full, 1.0, 1 - p))


def _class(counts: np.ndarray) -> np.ndarray:
    """Classes of counts: each count up to EXACT its own, then steps of a hundredth."""
    return np.where(counts <= EXACT, counts, EXACT + 1 + np.floor(100 * np.log(np.maximum(counts, 1) / EXACT))).astype(np.int64)


def _frequent(unigrams: DataFrame, most: int) -> list:
    """(hash, count) of the most frequent tokens, most frequent first, the lower hash first among equals.

    The driver sees a histogram of count classes first. From the class in which the last one falls, only the share of hashes that is needed is fetched
    (with room for chance, and all of them should that not do), so what it gets is about `most` rows, however many buckets there are."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(1).to_pylist():
                classes, n = np.unique(_class(expand(c).astype(np.int64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(n.astype(np.int64))], names=["class", "n"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = expand_sorted(k).view(np.int64), expand(c).astype(np.int64)
                own = _class(counts)
                take = (own > last) | ((own == last) & (keys / 2.0**64 + 0.5 <= share))
                yield pa.RecordBatch.from_arrays([pa.array(keys[take]), pa.array(counts[take])], names=["hash", "n"])

    tables = unigrams.select("keys", "counts")
    sizes = tables.mapInArrow(histogram, "class long, n long").groupBy("class").agg(F.sum("n")).collect()
    last, share, above = 0, 1.0, 0
    for own, n in sorted(map(tuple, sizes), reverse=True):
        if above + n >= most:
            f = (most - above) / n
            last, share = own, f + 10 * math.sqrt(f / n) + 10 / n if own <= EXACT else 1.0
            break
        above += n
    found = tables.mapInArrow(top, "hash long, n long").collect()
    if share < 1 and len(found) < most:
        share = 1.0
        found = tables.mapInArrow(top, "hash long, n long").collect()
    return sorted(found, key=lambda r: (-r[1], r[0]))[:most]


def discounts(of_counts: list[int]) -> np.ndarray:
    """d(0..DISCOUNTED + 1), Good-Turing's for counts up to DISCOUNTED, 1 beyond; where too few counts make it useless, (r - 1/2) / r."""
    k, n = DISCOUNTED, [0, *of_counts]
    out = np.ones(k + 2)
    common_part = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - common_part) / (1 - common_part) if n[r] and common_part < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Model:
    """Tables below `path` (unigrams, pairs, histories) and the arrays of the frequent tokens."""

    path: str
    buckets: int
    tokens: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray  # of frequent tokens, then of all others and of the start
    d: np.ndarray
    below: np.ndarray  # c'(h)
    alpha: np.ndarray

    def words(self) -> Words:
        return Words(self.hashes, self.counts[: len(self.hashes)], self.tokens / (4 * self.buckets) + 1)

    def unigram(self) -> np.ndarray:
        """P(w) of frequent tokens (and a number in the place of the others)."""
        return self.counts[:-1] / (self.tokens + 1)


def _held(make: Callable[[], Words]) -> Callable[[], Words]:
    token = uuid.uuid4().hex
    return lambda: common.worker_state(("words", token), make)


def train(docs: DataFrame, path: str, *, frequent: int = FREQUENT, buckets: int | None = None) -> Model:
    """Learns from all of docs (doc_id, text); tables are written below path, with a bucket for each BUCKET_BYTES of text, or `buckets`. `frequent` tokens are broadcast."""
    spark = docs.sparkSession
    own = common.renamed_apart(docs, ["doc_id", "text"])
    ends, size = own.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = buckets or max(12, math.ceil((size or 0) / BUCKET_BYTES))
    counted(own, buckets).write.parquet(f"{path}/unigrams")
    unigrams = spark.read.parquet(f"{path}/unigrams")
    tokens, distinct = (int(x or 0) for x in unigrams.agg(F.sum("tokens"), F.sum("size")).first())
    top = _frequent(unigrams, min(frequent, (1 << SHIFT) - 2))
    hashes, counts = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    model = Model(path, buckets, tokens, distinct, hashes, np.concatenate([counts, [tokens - counts.sum(), ends]]), np.ones(1), np.ones(1), np.ones(1))
    sent = spark.sparkContext.broadcast((hashes, counts, tokens / (4 * buckets) + 1))
    words = _held(lambda: Words(*sent.value))
    counted_pairs(own, words, buckets).write.partitionBy("side").parquet(f"{path}/pairs")
    pairs = _pairs(spark, path)
    counts_of = pairs.select(F.posexplode("of_counts").alias("r", "n")).groupBy("r").agg(F.sum("n")).orderBy("r").collect()
    model.d = discounts([r[1] for r in counts_of] or [0] * (DISCOUNTED + 1))
    d, unigram = model.d, model.unigram()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = expand_sorted(k), expand(c)
                h, w = (keys >> np.uint64(SHIFT)).astype(np.int64), (keys & np.uint64((1 << SHIFT) - 1)).astype(np.int64)
                first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else h == 0  # keys are sorted by h
                own, inverse = h[first], np.cumsum(first) - 1
                discounted = np.bincount(inverse, d[np.minimum(counts, DISCOUNTED + 1).astype(np.int64)] * counts)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(discounted), pa.array(np.bincount(inverse, unigram[w]))], names=["h", "s", "p"])

    parts = pairs.where("side < 0").select("owner", "counts").mapInArrow(sums, "h long, s double, p double").unionByName(_rare_histories(model, spark))
    seen = parts.groupBy("h").agg(F.sum("s"), F.sum("p")).collect()  # a row for each frequent token at most
    model.below, model.alpha = model.counts.astype(np.float64), np.ones(len(model.counts))
    if seen:
        h, s, p = (np.array(x) for x in zip(*seen, strict=True))
        model.below[h], model.alpha[h] = backoff(model.below[h], s, p)
    return model


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{PAIRS}, of_counts array<long>").parquet(f"{path}/pairs")


def _rare_histories(model: Model, spark: SparkSession) -> DataFrame:
    """Writes the table of rare histories: bucket, keys (sorted hashes), below, alpha. Returns h, s, p that rare words add to frequent histories."""
    n, d, tokens, path, unigram = model.buckets, model.d, model.tokens, model.path, spark.sparkContext.broadcast(model.unigram())
    rare = _pairs(spark, path).where("side >= 0").select("bucket", F.col("side").alias("role"), "owner", "other", "counts")
    unigrams = spark.read.parquet(f"{path}/unigrams").select("bucket", F.lit(-1).alias("role"), F.col("keys").alias("owner"), F.lit(None).cast("binary").alias("other"), "counts")

    def sums_by(h: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        own, inverse = np.unique(h, return_inverse=True)
        return own, *(np.bincount(inverse, x, len(own)) for x in values)

    def from_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Side 0, where the counts of rare words are. Bucket -1: sums of frequent histories; other buckets: P(w) summed for rare histories."""
        at_bucket, table, values = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            for b, role, owner, other, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                owner, counts = expand_sorted(owner), expand(c)
                if b != at_bucket:
                    at_bucket, table, values = b, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
                if role < 0:
                    table, values = owner, counts
                    continue
                other = expand(other)
                p, frequent = values[find(table, owner)[0]] / (tokens + 1), is_number(other)
                h, s, q = sums_by(other[frequent], (d[np.minimum(counts, DISCOUNTED + 1).astype(np.int64)] * counts)[frequent], p[frequent])
                out = [(-1, squeeze_sorted(h), s.tobytes(), q.tobytes())]
                h, q = sums_by(other[~frequent], p[~frequent])
                buckets = (h % np.uint64(n)).astype(np.int64)
                order = np.argsort(buckets, kind="stable")
                h, q = h[order], q[order]
                out += [(to, squeeze_sorted(h[s]), None, q[s].tobytes()) for to, s in _cut(buckets[order], n)]
                yield batch_of(out, BACKOFF_SCHEMA)

    def histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Side 1, with what from_words sent (role 2)."""
        held: dict[int, list] = {}
        for batch in batches:
            for b, role, owner, other, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                h = expand_sorted(owner)
                if role == 2:
                    held.setdefault(b, []).append((h, np.zeros(len(h)), np.zeros(len(h)), np.frombuffer(c)))
                    continue
                other, counts = expand(other), expand(c)
                p = np.where(is_number(other), unigram.value[np.where(is_number(other), other, np.uint64(0)).astype(np.int64)], 0.0)
                held.setdefault(b, []).append(sums_by(h, counts, d[np.minimum(counts, DISCOUNTED + 1).astype(np.int64)] * counts, p))
        for b, own in held.items():
            h, seen, s, p = sums_by(*map(np.concatenate, zip(*own, strict=True)))
            below, alpha = backoff(seen, s, p)
            schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("below", pa.binary()), ("alpha", pa.binary())])
            yield batch_of([(b, squeeze_sorted(h), below.tobytes(), alpha.tobytes())], schema)

    def frequent_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, s, p in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(expand_sorted(h).astype(np.int64)), pa.array(np.frombuffer(s)), pa.array(np.frombuffer(p))], names=["h", "s", "p"])

    met = unigrams.unionByName(rare.where("role = 0")).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "role")
    met.mapInArrow(from_words, "bucket int, keys binary, s binary, p binary").write.parquet(f"{path}/backoff")
    sent = spark.read.parquet(f"{path}/backoff")
    of_rare = sent.where("bucket >= 0").select("bucket", F.lit(2).alias("role"), F.col("keys").alias("owner"), F.lit(None).cast("binary").alias("other"), F.col("p").alias("counts"))
    both = rare.where("role = 1").unionByName(of_rare).repartitionById(n, F.col("bucket"))
    both.mapInArrow(histories, "bucket int, keys binary, below binary, alpha binary").write.parquet(f"{path}/histories")
    return sent.where("bucket < 0").select("keys", "s", "p").mapInArrow(frequent_ones, "h long, s double, p double")


def score(docs: DataFrame, model: Model, passed: str | None = None) -> DataFrame:
    """doc_id, `passed` if named, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark, n = docs.sparkSession, model.buckets
    head = F.struct(F.col("doc_id").alias("doc_id"), *([F.col(passed).alias(passed)] if passed else []))
    own = docs.select(head.alias("head"), F.col("text").alias("text"))
    kind = own.schema["head"].dataType.simpleString()
    sent = spark.sparkContext.broadcast((model.hashes, model.counts, model.tokens / (4 * n) + 1, model.d, model.below, model.alpha, model.unigram()))
    words = _held(lambda: Words(sent.value[0], sent.value[1][: len(sent.value[0])], sent.value[2]))
    layout = f"bucket int, role int, chunk long, keys binary, counts binary, docs binary, n_docs int, heads array<{kind}>, n_tokens binary, n_known binary, base binary"
    names = [x.split()[0] for x in layout.split(", ")[:7]] + ["heads", "n_tokens", "n_known", "base"]

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Role 2: keys of a chunk's pairs of frequent tokens, how often each occurs, and in which documents. Role 4: what the chunk knows itself.
        Role 6 and 7: pairs with a rare w and a rare h, the rare token's hash as the key and the other token in n_tokens."""
        from pyspark import TaskContext

        for k, chunk in enumerate(chunks(batches)):
            name = TaskContext.get().partitionId() << 24 | k
            numbers, pairs = pairs_of(chunk, words())
            out = []
            both = np.flatnonzero((numbers != words().unknown) & (pairs >> np.uint64(SHIFT) != words().unknown))
            asked_of = [(2, pairs[both], None, chunk.docs[both], words().buckets(pairs[both], n))]
            asked_of += [(6 + side, owner, other, chunk.docs[at], (owner % np.uint64(n)).astype(np.int64)) for side, owner, other, at in rare_pairs(chunk, words(), numbers, pairs)]
            for role, keys, other, docs_of, buckets in asked_of:
                order = np.argsort(keys) if other is None else np.lexsort((other, keys))
                order = order[bucketed(buckets[order], n)]
                keys, docs_of, buckets = keys[order], docs_of[order].astype("<u2"), buckets[order]
                other = None if other is None else other[order]
                for b, s in _cut(buckets, n):
                    differs = keys[s][1:] != keys[s][:-1]
                    if other is not None:
                        differs |= other[s][1:] != other[s][:-1]
                    new = np.flatnonzero(np.concatenate([[True], differs]))
                    others = None if other is None else squeeze(other[s][new])
                    out.append((b, role, name, squeeze_sorted(keys[s][new]), squeeze(np.diff(np.append(new, s.stop - s.start))), zstandard.compress(docs_of[s].tobytes(), 1), len(chunk.sizes), None, others, None, None))
            known = np.append(np.log10(sent.value[1][: words().size] + 1.0), 0.0)[numbers]
            own = [np.bincount(chunk.docs, w, len(chunk.sizes)).tobytes() for w in (numbers != words().unknown, known)]
            heads = pa.concat_arrays(chunk.rows)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.list_(heads.type), pa.binary(), pa.binary(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            last = [int(scramble(np.array([name], np.uint64))[0] % np.uint64(n)), 4, name, None, None, None, len(chunk.sizes), None, chunk.sizes.astype("<i8").tobytes(), own[0], own[1]]
            columns = [pa.array([x], t) for x, t in zip(last, types, strict=True)]
            columns[7] = pa.ListArray.from_arrays(pa.array([0, len(heads)], pa.int32()), heads)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition come by bucket and role: tables first. Role 5: sums for a chunk's documents: log P, then log(c + 1) and known, of rare tokens."""
        d, below, alpha, unigram = sent.value[3:]
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        tables: dict[int, tuple[np.ndarray, ...]] = {}

        def met_by(key: int, keys: np.ndarray) -> np.ndarray:
            table, values = tables.get(key, nothing)
            at, there = find(table, keys)
            return np.where(there, values[at], 0) if len(table) else np.zeros(len(keys), np.int64)

        def rare_log(side: int, owner: np.ndarray, other: np.ndarray) -> list[np.ndarray | None]:
            """log10 of this side's part of P(w | h); with side 0, also log10(c(w) + 1) and whether w is known."""
            number = is_number(other)
            code = np.where(number, other, np.uint64(0)).astype(np.int64)
            pair = met_by(-2 + side, pair_key(owner, other))
            seen = d[np.minimum(pair, DISCOUNTED + 1)] * pair
            if side == 0:
                c = met_by(1, owner)
                p = np.maximum(c, 1) / (model_tokens + 1)
                of_pair = np.where(number, np.where(pair > 0, seen / np.maximum(below[code], 1e-300), alpha[code] * p), np.where(pair > 0, 1.0, p))
                return [np.log10(of_pair), np.log10(c + 1.0), c > 0]
            hashes, own_below, own_alpha = tables.get(-3, (np.zeros(0, np.uint64), np.ones(1), np.ones(1)))
            at, there = find(hashes, owner)
            weight = np.where(there, own_alpha[at], 1.0) * np.where(number, unigram[code], 1.0)
            return [np.log10(np.where(pair > 0, seen / own_below[at], weight)), None, None]

        at_bucket = None
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, role, name = (batch.column(c)[i].as_py() for c in range(3))
                if bucket != at_bucket:
                    at_bucket, tables = bucket, {}
                if role == 4:
                    yield batch.slice(i, 1)
                    continue
                keys = expand_sorted(batch.column(3)[i].as_py())
                if role == -3:  # rare histories
                    tables[role] = (keys, *(np.frombuffer(batch.column(c)[i].as_py()) for c in (4, 8)))
                    continue
                counts = expand(batch.column(4)[i].as_py()).astype(np.int64)
                if role < 0:  # pairs with a rare token
                    own = pair_key(keys, expand(batch.column(8)[i].as_py()))
                    order = np.argsort(own)
                    tables[role] = (own[order], counts[order])
                    continue
                if role < 2:
                    tables[role] = (keys, counts)
                    continue
                owners = np.frombuffer(zstandard.decompress(batch.column(5)[i].as_py()), "<u2")
                n_docs = batch.column(6)[i].as_py()
                if role >= 6:
                    logs = rare_log(role - 6, keys, expand(batch.column(8)[i].as_py()))
                    sums = [None if x is None else sparse_sums(owners, np.repeat(x, counts)) for x in logs]
                else:
                    found = met_by(0, keys)
                    h, w = (keys >> np.uint64(SHIFT)).astype(np.int64), (keys & np.uint64((1 << SHIFT) - 1)).astype(np.int64)
                    p = np.where(found > 0, d[np.minimum(found, DISCOUNTED + 1)] * found / np.maximum(below[h], 1e-300), alpha[h] * unigram[w])
                    sums = [sparse_sums(owners, np.repeat(np.log10(p), counts)), None, None]
                row = [at_bucket, 5, name, None, None, None, n_docs, None, *sums]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, batch.schema.types, strict=True)], schema=batch.schema)

    def combine(rows: pa.Table) -> pa.Table:
        roles = rows.column("role").to_pylist()
        k, n_docs = roles.index(4), rows.column("n_docs")[0].as_py()
        sums = np.zeros((3, n_docs))
        for i, role in enumerate(roles):
            if role == 5:
                for j, c in enumerate(("n_tokens", "n_known", "base")):
                    x = rows.column(c)[i].as_py()
                    if x is not None:
                        add_sums(x, sums[j])
        n_tokens = np.frombuffer(rows.column("n_tokens")[k].as_py(), "<i8")
        known, base = (np.frombuffer(rows.column(c)[k].as_py()) for c in ("n_known", "base"))
        base_score = base + sums[1] - n_tokens * math.log10(model_tokens + model_distinct + 1)
        heads = rows.column("heads").combine_chunks()[k].values
        return pa.table([heads, pa.array(n_tokens), pa.array(np.rint(known + sums[2]).astype(np.int64)), pa.array(base_score), pa.array(sums[0])], names=["head", "n_tokens", "n_known", "base_score", "score"])

    model_tokens, model_distinct = model.tokens, model.distinct
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("docs", "binary"), ("n_docs", "int"), ("heads", f"array<{kind}>"), ("n_tokens", "binary"), ("n_known", "binary"), ("base", "binary"))]
    row = lambda role, keys, counts, other: ("bucket", role.alias("role"), F.lit(-1).cast("long").alias("chunk"), F.col(keys).alias("keys"), F.col(counts).alias("counts"), *empty[:3], other.alias("n_tokens"), *empty[4:])
    nothing = F.lit(None).cast("binary")
    kept = _pairs(spark, model.path).select(*row(F.when(F.col("side") < 0, 0).otherwise(F.col("side") - 2), "owner", "counts", F.col("other")))
    kept = kept.unionByName(spark.read.parquet(f"{model.path}/unigrams").select(*row(F.lit(1), "keys", "counts", nothing)))
    kept = kept.unionByName(spark.read.parquet(f"{model.path}/histories").select(*row(F.lit(-3), "keys", "below", F.col("alpha"))))
    asked = own.mapInArrow(requests, layout)
    met = kept.unionByName(asked).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "role")
    rows = met.mapInArrow(answers, layout).groupBy("chunk").applyInArrow(combine, f"head {kind}, n_tokens long, n_known long, base_score double, score double")
    return rows.select("head.*", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(7) == 2).alias("held_out"))
    model = train(docs.where("NOT held_out"), f"{common.checkpoint_path(spark)}/katz-{uuid.uuid4().hex}")
    return score(docs, model, passed="held_out")
