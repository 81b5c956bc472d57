"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a slice of documents as one sequence of word numbers. Its suffix array holds, sorted, the suffixes that begin with the two
words of some benchmark window (no other suffix can match). Every benchmark suffix of a window or more is binary-searched
in it; neighbouring finds on one diagonal join to the longest verbatim matches, with their places. Documents never leave their partition.
Suffixes that begin otherwise are left out of the array, since a search can't end at one: what is found is the same as in an array of all suffixes.
A benchmark of over BLOCK_BYTES of text is met block by block: each block is a pass over the documents, with its index built once in a worker, which keeps the finds of
the texts that have any, by the text's digest; only one block is held by the driver and the workers at a time.

Defined cases: null and wordless texts have no words, hits or items; a null item id is listed as an empty string; repeated items count once, repeated
documents each get the same result; further columns are ignored or, in remove_contaminated, kept; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import common

WINDOW = 10
BLOCK_BYTES = 8_000_000


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of each i, counts[i] of them."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        numbers: dict[bytes, int] = {}
        coded = [[numbers.setdefault(w, len(numbers) + 1) for w in common.plain_words(text)] for _, text in items]
        self.ids, self.numbers, self.depth = [i for i, _ in items], numbers, window
        kind = ">u2" if len(numbers) < 0xFFFF else ">u4"
        self.kind, self.width = np.dtype(kind), np.dtype(kind).itemsize * window
        places: dict[bytes, list[tuple[int, int]]] = {}
        sizes: dict[bytes, int] = {}
        for k, own in enumerate(coded):
            n = min(window, len(own))
            packed, step = np.array(own, kind).tobytes(), self.kind.itemsize
            for s in range(len(own) - n + 1 if n else 0):
                key = packed[s * step : (s + n) * step]
                places.setdefault(key, []).append((k, s))
                sizes[key] = n
        keys = list(places)
        self.sizes = np.array([sizes[k] for k in keys], np.int64)
        self.low = np.array([k.ljust(self.width, b"\0") for k in keys], f"S{self.width}")
        self.high = np.array([k.ljust(self.width, b"\xff") for k in keys], f"S{self.width}")
        counts = np.array([len(places[k]) for k in keys], np.int64)
        self.place_counts, self.place_starts = counts, np.cumsum(counts) - counts
        flat = np.array([p for k in keys for p in places[k]], np.int64).reshape(-1, 2)
        self.place_item, self.place_at = flat[:, 0], flat[:, 1]
        firsts = [np.frombuffer(k, kind, min(2, len(k) // self.kind.itemsize)).tolist() for k in keys]
        self.base = len(numbers) + 1
        self.single = np.zeros(self.base, bool)
        self.single[[f[0] for f in firsts if len(f) == 1]] = True
        self.first = np.zeros(self.base, bool)
        self.first[[f[0] for f in firsts if len(f) == 2]] = True
        self.pairs = np.unique(np.array([f[0] * self.base + f[1] for f in firsts if len(f) == 2], np.int64))

    def suffixes(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard's suffix array, and the suffixes' first words as comparable bytes. tokens: 0 for any other word and between documents."""
        padded = np.concatenate([tokens, np.zeros(self.depth, tokens.dtype)])
        at = np.flatnonzero(self.first[tokens])
        if len(self.pairs):
            pair = padded[at].astype(np.int64) * self.base + padded[at + 1]
            at = at[self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair]
        if self.single.any():
            at = np.union1d(at, np.flatnonzero(self.single[tokens]))
        keys = np.ascontiguousarray(padded[at[:, None] + np.arange(self.depth)].astype(self.kind)).view(f"S{self.width}").reshape(-1)
        order = np.argsort(keys, kind="stable")
        return at[order], keys[order]

    def occurrences(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and window of each occurrence."""
        array, keys = self.suffixes(tokens)
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        counts = high - low
        return array[_ranges(low, counts)], np.repeat(np.arange(len(counts)), counts)


def _matches(index: Index, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The longest matches (item, place in it, place in the shard, words) that the occurrences make up."""
    counts = index.place_counts[window]
    place = _ranges(index.place_starts[window], counts)
    pos, size = np.repeat(at, counts), np.repeat(index.sizes[window], counts)
    item, start = index.place_item[place], index.place_at[place]
    order = np.lexsort((pos, pos - start, item))
    item, start, pos, size = item[order], start[order], pos[order], size[order]
    if not len(pos):
        return item, start, pos, size
    new = np.ones(len(pos), bool)
    new[1:] = (item[1:] != item[:-1]) | (start[1:] - start[:-1] != 1) | (pos[1:] - pos[:-1] != 1)
    heads = np.flatnonzero(new)
    return item[heads], start[heads], pos[heads], size[heads] + np.diff(np.append(heads, len(pos))) - 1


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark as lists of (item id as text, text), of about block_bytes of text at most, or one item."""
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text")).distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(2 * total / block_bytes) if total > block_bytes else 1
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r[0], bytes(r[1]) if r[1] is not None else None) for r in part.collect()]


NAMES = ["n_words", "match_items", "match_item_starts", "match_doc_starts", "match_words"]
TYPES = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
MATCHES = "n_words long, match_items array<string>, match_item_starts array<int>, match_doc_starts array<int>, match_words array<int>"


def _searched(texts: list[bytes], index: Index) -> list[tuple]:
    """NAMES of each text."""
    get = index.numbers.get
    found: list[tuple] = []
    for rows in common.sliced([len(x) for x in texts]):
        own = [common.word_array(texts[i], lambda w: get(w, 0), "int32") for i in rows]
        sizes = np.array([len(x) for x in own], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        tokens = np.zeros(int((sizes + 1).sum()), np.int32)
        for x, s in zip(own, starts.tolist(), strict=True):
            tokens[s : s + len(x)] = x
        made = [(n, [], [], [], []) for n in sizes.tolist()]
        item, start, pos, size = _matches(index, *index.occurrences(tokens))
        doc = np.searchsorted(starts, pos, "right") - 1
        for d, *values in zip(doc.tolist(), [index.ids[i] for i in item.tolist()], start.tolist(), (pos - starts[doc]).tolist(), size.tolist(), strict=True):
            for out, value in zip(made[d][1:], values, strict=True):
                out.append(value)
        found += made
    return found


def _met(docs: DataFrame, block: list[tuple[str, bytes | None]], window: int, hits_only: bool) -> tuple[DataFrame, Callable[[], None]]:
    """docs with NAMES by one block, or `digest` and NAMES of the distinct texts with finds; and what frees the block."""
    sent, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = common.worker_state(("windows", token), lambda: Index(sent.value, window))
        for batch in batches:
            whole = common.byte_texts(batch.column(at))
            found = _searched([x.translate(common.PLAIN) if x else b"" for x in whole], index)
            if hits_only:
                rows = {hashlib.md5(x).digest(): f for x, f in zip(whole, found, strict=True) if f[1]}
                columns, found, names = [pa.array(rows.keys(), pa.binary())], list(rows.values()), ["digest", *NAMES]
            else:
                columns, names = batch.columns, [*batch.schema.names, *NAMES]
            added = [pa.array([f[k] for f in found], t) for k, t in enumerate(TYPES)]
            yield pa.RecordBatch.from_arrays([*columns, *added], names=names)

    own = "digest binary" if hits_only else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(common.freed(run), f"{own}, {MATCHES}"), sent.destroy


def n_hit() -> Column:
    """The words that the union of a row's matches covers."""
    spans = F.array_sort(F.arrays_zip(F.col("match_doc_starts").alias("p"), F.col("match_words").alias("n")))
    state = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["p"] + s["n"] - F.greatest(a["end"], s["p"]))).alias("hit"), F.greatest(a["end"], s["p"] + s["n"]).alias("end"))
    return F.aggregate(spans, state, step, lambda a: a["hit"].cast("long"))


def find_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of docs (all its columns but those of the result's names) with n_words, n_hit, and the longest matches: arrays match_items, match_item_starts, match_doc_starts, match_words."""
    base = docs.drop(*NAMES, "n_hit")
    blocks = _blocks(benchmark, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        found, _ = _met(base, block, window, hits_only=False)
    else:
        parts = []
        texts = base.select("text")
        while block is not None:
            part, free = _met(texts, block, window, hits_only=True)
            parts.append(common.checkpointed(part.dropDuplicates(["digest"])))
            free()
            block, following = following, next(blocks, None)
        found_by_text = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in NAMES[1:]])
        lists = common.checkpointed(found_by_text.select(F.col("digest").alias("__digest"), F.struct(*NAMES[1:]).alias("__found")))
        counted, _ = _met(base, [], window, hits_only=False)
        marked = counted.drop(*NAMES[1:]).withColumn("__digest", F.unhex(F.md5(F.col("text").cast("binary"))))
        joined = common.with_lists(marked, lists, "__digest", "__found")
        empty = {"match_items": "array<string>"}
        found = joined.select(*[F.col(f"`{c}`") for c in base.columns], "n_words", *[F.coalesce(F.col("__found")[c], F.array().cast(empty.get(c, "array<int>"))).alias(c) for c in NAMES[1:]])
    return found.select(*[F.col(f"`{c}`") for c in base.columns], "n_words", n_hit().alias("n_hit"), *NAMES[1:])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that have no benchmark window, with their own columns."""
    clash = {"n_words", "n_hit", "match_items", "match_item_starts", "match_doc_starts", "match_words"} & set(docs.columns)
    apart = docs.withColumnsRenamed({c: f"__own_{c}" for c in clash})
    clean = find_matches(apart, benchmark, window=window, block_bytes=block_bytes).where("n_hit = 0").select([F.col(f"`{c}`") for c in apart.columns])
    return clean.withColumnsRenamed({f"__own_{c}": c for c in clash})


def digests(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    items = F.array_sort(F.array_distinct("match_items"))
    found = find_matches(common.renamed_apart(docs, ["doc_id", "text"]), benchmark, window=window, block_bytes=block_bytes)
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.coalesce(F.array_max("match_words"), F.lit(0)).alias("longest_match"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
