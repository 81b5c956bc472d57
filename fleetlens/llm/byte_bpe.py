"""Byte-level BPE encoding and decoding.

`encode` appends to each row its token ids and, from the byte-to-character mapping, the characters each token covers;
`decode` reverses the byte table. A character may be split among tokens: `token_texts` gives such a character to the token
that completes it, and offsets of all its tokens cover it.

Defined cases: a null text is an empty one (no ids); an empty text has no ids; rows are independent, so repeated rows and ids,
null ids and further columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import common, pieces

RANKS = "byte_bpe_50k.tiktoken"


def offsets(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token, of its length in bytes: each character that has one of its bytes."""
    first_bytes = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    character = np.cumsum(first_bytes) - 1
    ends = np.cumsum(lengths)
    return (character[ends - lengths], character[ends - 1] + 1) if len(ends) else (ends, ends)


def token_texts(coder: pieces.ByteLevel, ids: list[int]) -> list[str]:
    """The text each token completes; an unfinished character at the end is replaced by U+FFFD."""
    decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
    return [decoder.decode(coder.table[i], final=k == len(ids) - 1) for k, i in enumerate(ids)]


def _coder(path: str) -> pieces.ByteLevel:
    return common.worker_state(("byte", path), lambda: pieces.ByteLevel(path))


def _encoded(path: str, column: pa.Array) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Texts and their ids as bytes, slice by slice."""
    coder = _coder(path)
    for _, texts in common.text_slices(column):
        own = [x or b"" for x in texts]
        yield own, coder.encode([x.decode("utf-8", errors="replace") for x in own])


def encode(docs: DataFrame, *, path: str | None = None, text_column: str = "text", with_offsets: bool = True) -> DataFrame:
    """docs with `token_ids`, and `char_starts` and `char_ends` if asked for."""
    path = path or pieces.default_path(RANKS)
    added = "token_ids array<int>" + ", char_starts array<int>, char_ends array<int>" * with_offsets
    base = docs.drop("token_ids", "char_starts", "char_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            row = 0
            for texts, coded in _encoded(path, batch.column(batch.schema.get_field_index(text_column))):
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in coded]
                columns = [_lists(ids)]
                if with_offsets:
                    spans = [offsets(t, coder.lengths[i]) for t, i in zip(texts, ids, strict=True)]
                    columns += [_lists([s[k].astype(np.int32) for s in spans]) for k in (0, 1)]
                own = batch.slice(row, len(texts))
                row += len(texts)
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*own.schema.names, "token_ids", "char_starts", "char_ends"][: own.num_columns + len(columns)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(common.freed(run), f"{schema}, {added}")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def decode(coded: DataFrame, *, path: str | None = None, ids_column: str = "token_ids") -> DataFrame:
    """coded with `decoded`, the bytes that the ids stand for, and `decoded_text`, with U+FFFD for what is no UTF-8."""
    path = path or pieces.default_path(RANKS)
    base = coded.drop("decoded", "decoded_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_column))
            data = [b"" if x is None else coder.decode(np.array(x, dtype=np.int64)) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary()), pa.array([x.decode("utf-8", errors="replace") for x in data], pa.string())], names=[*batch.schema.names, "decoded", "decoded_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(common.freed(run), f"{schema}, decoded binary, decoded_text string")


def digests(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, number of ids, and SHA-256 of the ids and of what they decode to, without keeping ids beyond a slice."""
    path = path or pieces.default_path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for _, coded in _encoded(path, batch.column(1)):
                for x in coded:
                    counts.append(len(x) // 4)
                    of_ids.append(hashlib.sha256(x).hexdigest())
                    of_bytes.append(hashlib.sha256(coder.decode(np.frombuffer(x, dtype="<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = common.renamed_apart(docs, ["doc_id", "text"])
    return own.mapInArrow(common.freed(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
