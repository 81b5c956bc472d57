"""Substring dedup: Rabin-Karp hashes of fixed-length windows of words, counted in Spark; repeated windows merge into removal intervals.

A window is removed in a document if its words also start in a document with a smaller doc_id. Only windows that can repeat are shipped:

1. The least hash of the GRAM-word sequences in a window (its fingerprint) is the same wherever the window stands. Each document is cut into
   segments, its longest runs of windows with one fingerprint. Fingerprints that one document alone has are dropped: none of their windows repeats.
2. A segment, too, is hashed (Rabin-Karp, over all its words). In a document that isn't the first with a segment, all of it goes.
3. First documents of segments whose fingerprint also has other segments: each of their windows is hashed by two Rabin-Karp
   hashes (128 bits), Spark takes each hash's least doc_id, and windows with a smaller one than their own go.

This is exact but for collisions of 128-bit hashes. Removals of a document are merged into maximal intervals.

Defined cases: null and wordless texts have no words; texts shorter than a window lose nothing; rows with equal ids are taken as copies of one document;
a null id is never smaller than another and loses nothing; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import common

WINDOW, GRAM = 50, 20
#: Two odd bases of the Rabin-Karp hashes, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of a base and of its inverse, modulo 2**64, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grown(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def prefix_sums(words: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of words[j] * base**j below each place, and the powers of the inverse."""
    up, down = common.worker_state("powers", lambda: {b: Powers(b) for b in BASES})[base].grown(len(words) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])]), down


def rolling(words: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of words[starts[i]:ends[i]]."""
    sums, down = prefix_sums(words, base)
    return (sums[ends] - sums[starts]) * down[starts]


def segments(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and fingerprint of each segment."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(words) - gram + 1)
    least = rolling(words, BASES[0], at, at + gram)
    least = (least ^ (least >> np.uint64(32))) * np.uint64(BASES[1])  # the low bits of the hash depend on few words
    width, want = 1, window - gram + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return starts, np.diff(np.append(starts, n)), least[starts]


def _segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, fp, seg, start, n of each document's segments."""
    kind = common.type_of(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.text_slices(batch.column(1)):
                found = []
                for i, text in zip(part, texts, strict=True):
                    own = common.word_hashes(text)
                    starts, counts, prints = segments(own, window, gram)
                    found.append((np.full(len(starts), i), prints, rolling(own, BASES[1], starts, starts + counts + window - 1), starts, counts))
                rows, prints, hashes, starts, counts = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows.astype(np.int64))), pa.array(prints.view(np.int64)), pa.array(hashes.view(np.int64)), pa.array(starts.astype(np.int32)), pa.array(counts.astype(np.int32))], names=["doc_id", "fp", "seg", "start", "n"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(common.freed(run), f"doc_id {kind}, fp long, seg long, start int, n int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """h1, h2, doc_id, start of the windows of docs (doc_id, text, spans: first window and number of windows)."""
    kind = common.type_of(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, spans in zip(batch.column(0), common.byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = common.word_hashes(text)
                at = common.distinct(np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in spans]))
                at = at[at + window <= len(own)]
                yield pa.RecordBatch.from_arrays([*(pa.array(rolling(own, b, at, at + window).view(np.int64)) for b in BASES), pa.repeat(doc, len(at)), pa.array(at.astype(np.int32))], names=["h1", "h2", "doc_id", "start"])

    return docs.mapInArrow(common.freed(run), f"h1 long, h2 long, doc_id {kind}, start int")


def removals(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id and `spans`, its removed stretches as (start, n): the first window and the number of windows."""
    own = common.renamed_apart(docs, ["doc_id", "text"])
    found = common.checkpointed(_segments(own, window, gram))
    shared = found.groupBy("fp").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows")).where("low < high").select("fp", "rows")
    kept = common.checkpointed(common.met(found, shared, ["fp"], "rows", few=False))
    firsts = common.checkpointed(kept.groupBy("fp", "seg").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    later = common.met(kept, firsts.where("rows > 1"), ["fp", "seg"], "rows", few=False).where("doc_id > first").select("doc_id", "start", "n")
    several = firsts.groupBy("fp").agg(F.min("seg").alias("a"), F.max("seg").alias("b"), F.count("*").alias("rows")).where("a < b").select("fp", "rows")
    open_segments = common.met(firsts.drop("rows"), several, ["fp"], "rows", few=False).withColumnRenamed("first", "doc_id").join(kept, ["fp", "seg", "doc_id"])
    spans = common.checkpointed(open_segments.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    windows = common.checkpointed(_windows(common.semi(own, spans.select("doc_id"), "doc_id").join(spans, "doc_id"), window))
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).where("first < last").drop("last")
    single = common.met(windows, least, ["h1", "h2"], "rows", few=False).where("doc_id > first").select("doc_id", "start", F.lit(1).alias("n"))
    return later.unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def covered(n_words: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """True for each word of a removed window: the union of the spans is their maximal intervals."""
    edges = np.zeros(n_words + 1, np.int64)
    for s in spans or ():
        np.add.at(edges, [min(s["start"], n_words), min(s["start"] + s["n"] + window - 1, n_words)], [1, -1])
    return np.cumsum(edges[:-1]) > 0


def digests(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for."""
    own = common.renamed_apart(docs, ["doc_id", "text"])
    kind = common.type_of(own, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, texts, hashes = [], [], [], []
            for text, spans in zip(common.byte_texts(batch.column(1)), batch.column(2), strict=True):
                own = common.words(text)
                gone = covered(len(own), spans.as_py(), window) if spans.is_valid else None
                kept = b" ".join(own if gone is None else compress(own, (~gone).tolist()))
                words.append(len(own))
                removed.append(0 if gone is None else int(gone.sum()))
                hashes.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8") if with_text else None)
            columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()), *[pa.array(texts, pa.string())] * with_text]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    lists = common.checkpointed(removals(own, window=window, gram=gram))
    return common.with_lists(own, lists, "doc_id", "spans").mapInArrow(common.freed(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
