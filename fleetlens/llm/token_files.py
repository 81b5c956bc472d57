"""Token files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

A token file is one row of a Parquet table that Spark writes and reads, so that any store Spark knows can hold it. Files follow one
another in ascending doc_id order (columns `shard`, `part`) and hold whole documents; a file is closed once it has FILE_TOKENS ids. Ids may be of any
type that Spark orders: shards are ranges of (doc_id, a hash of the text), so that not even rows of one id are left to one task.
`payload` is: magic, number of ids, number of ranks (unsigned 32-bit); the ids by rank, most frequent first (32-bit each);
control bytes, with two bits for each of four ids, its rank's bytes less one; then the ranks' bytes, lowest first.

Defined cases: a null text is an empty one; each document gets the end id, also an empty one; null ids come first; rows with equal ids
keep an order by a hash of the text; further columns are ignored; an empty table makes no files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm import common, pieces

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
FILE_TOKENS = 1 << 20
MAGIC = b"RVB1"
#: Ids below it are counted in an array.
DENSE_IDS = 1 << 20


def pack(ids: np.ndarray) -> bytes:
    """The payload of a file with these ids."""
    if len(ids) and ids.max() < DENSE_IDS:
        by_id = np.bincount(ids)
        distinct = np.flatnonzero(by_id)
        counts, places = by_id[distinct], ids
    else:
        distinct, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        by_id = np.zeros(len(distinct))
    by_rank = np.lexsort((distinct, -counts))
    rank_of = np.empty(len(by_id), np.uint32)
    rank_of[distinct[by_rank] if places is ids else by_rank] = np.arange(len(distinct), dtype=np.uint32)
    ranks = rank_of[places.reshape(-1)]
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    quads = np.zeros(-len(ids) % 4 + len(ids), np.uint8)
    quads[: len(ids)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    head = np.array([len(ids), len(distinct)], "<u4").tobytes()
    return MAGIC + head + distinct[by_rank].astype("<u4").tobytes() + control.astype(np.uint8).tobytes() + data.tobytes()


#: Lengths of the four ranks that each control byte describes.
LENGTHS = np.stack([(np.arange(256) >> shift & 3) + 1 for shift in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload, by table lookups."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token file")
    n, distinct = np.frombuffer(payload, "<u4", 2, 4).tolist()
    table = np.frombuffer(payload, "<u4", distinct, 12)
    at = 12 + 4 * distinct
    control = np.frombuffer(payload, np.uint8, (n + 3) // 4, at)
    data = np.frombuffer(payload + bytes(4), np.uint8, offset=at + len(control))
    lengths = LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        ranks[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[ranks]


def ranged(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and text, dealt to n partitions by ranges, null ids first, and sorted within."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark")]
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")


def write_files(docs: DataFrame, target: str, *, path: str | None = None, end_id: int = END_ID, shards: int | None = None, file_tokens: int = FILE_TOKENS) -> None:
    """Encodes docs into token files below `target`."""
    path = path or pieces.default_path(VOCABULARY)
    own = common.renamed_apart(docs, ["doc_id", "text"])
    id_type = common.type_of(own, "doc_id")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = common.worker_state(("word", path), lambda: pieces.WordEnd(path))
        shard, part, held = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        coded: list[bytes] = []

        def file() -> pa.RecordBatch:
            of_docs = pa.concat_arrays(ids)
            columns = [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([held], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(of_docs)], pa.int32()), of_docs)]
            columns += [pa.array([[len(x) // 4 for x in coded]], pa.list_(pa.int32())), pa.array([pack(np.frombuffer(b"".join(coded), "<u4"))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "part", "n_tokens", "doc_ids", "doc_tokens", "payload"])

        for batch in batches:
            first = 0  # of the rows of this batch in the open file
            for rows, texts in common.text_slices(batch.column(1)):
                for i, x in zip(rows, coder.encode([(x or b"").decode("utf-8", errors="replace") for x in texts]), strict=True):
                    if held >= file_tokens:
                        ids.append(batch.column(0).slice(first, i - first))
                        yield file()
                        first, part, held, ids, coded = i, part + 1, 0, [], []
                    coded.append(x + end)
                    held += len(x) // 4 + 1
            ids.append(batch.column(0).slice(first))
        if coded:
            yield file()

    n = shards or max(1, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    files = ranged(own, n).mapInArrow(common.freed(run), f"shard int, part int, n_tokens long, doc_ids array<{id_type}>, doc_tokens array<int>, payload binary")
    files.write.option("compression", "none").parquet(target)


def read_files(spark: SparkSession, target: str, *, with_ids: bool = False) -> DataFrame:
    """Per document, from its file: doc_id, start, n_tokens, ids_crc32, and `ids` if asked for."""
    files = spark.read.parquet(target)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    # Sums within shards first: one task sees a row a shard, not a row a file.
    before = lambda *order: W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before("shard")), F.lit(0)).alias("shard_start"))
    own = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = files.select("shard", "part", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("own_start")).join(shards, "shard")
    starts = placed.select("shard", "part", (F.col("shard_start") + F.col("own_start")).alias("file_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, part, doc_ids, counts, payload = (c[k] for c in batch.columns)
                ids, n = unpack(payload.as_py()).astype("<u4"), np.array(counts.as_py(), np.int64)
                ends = np.cumsum(n)
                own = [ids[a:b] for a, b in zip(ends - n, ends, strict=True)]
                columns = [pa.repeat(shard, len(n)), pa.repeat(part, len(n)), doc_ids.values, pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                columns += [pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "part", "doc_id", "local_start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    docs = files.select("shard", "part", "doc_ids", "doc_tokens", "payload").mapInArrow(common.freed(run), f"shard int, part int, doc_id {id_type}, local_start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return docs.join(starts, ["shard", "part"]).select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{common.checkpoint_path(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(common.table(spark, sf_dir, "documents"), target)
    return read_files(spark, target)
