"""Language ID by compression: a text belongs to the language whose dictionary compresses it best.

Each language gets a zstandard raw-content dictionary: the words of a bounded sample of its labelled rows, in an order of their own (so that
no passage that a sample document shares with others stands in it). A text, lower-cased and with every run of other characters than letters
as one space, is compressed in blocks of BLOCK_BYTES with each dictionary; the smallest sum wins. The score is the margin: (second - best) / second.
A text is rejected if it has no letter, or if its margin is under `min_margin`.

Bounds of the sample (documented parameters): SAMPLE_ROWS rows of each language, those of MIN_BYTES to MAX_BYTES bytes first, in the order of a hash of their
ids, of each at most SAMPLE_CHARS characters; DICTIONARY_BYTES of their words. Only whole texts are predicted, all of them.

Defined cases: text null or without a letter: `und`, score 0, rejected; nothing learned (no labelled row): the same; equal sizes: the language with more labelled
rows, then the first by name, score 0, rejected; rows are independent, so repeated rows and ids, null ids and further columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm import common

SAMPLE_ROWS, MIN_BYTES, MAX_BYTES, SAMPLE_CHARS, DICTIONARY_BYTES = 64, 500, 8000, 1_000_000, 65_536
LEVEL, BLOCK_BYTES, MIN_MARGIN = 5, 4096, 0.005
#: A text under SHORT_BYTES is compressed at a higher level and behind zeros, or it would be stored as it is whatever the dictionary.
SHORT_BYTES, SHORT_LEVEL, PADDING = 256, 12, bytes(120)
NOT_LETTERS = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text).lower().strip().encode("utf-8", errors="replace")


def dictionaries(labelled: DataFrame, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary), of labelled rows (doc_id, text, lang); languages with more documents first."""
    own = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.octet_length("text").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy((~F.col("n").between(MIN_BYTES, MAX_BYTES)).cast("int"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id"))
    chosen = own.withColumn("rank", rank).where(F.col("rank") <= rows).select("doc_id", "lang").distinct()
    found: dict[str, list] = {}
    for r in common.semi(labelled.where("text IS NOT NULL").select("doc_id", "lang", "text"), chosen, ["doc_id", "lang"]).select("lang", F.coalesce(F.xxhash64(F.col("doc_id").cast("string")), F.lit(0)), F.col("text").substr(1, chars)).collect():
        found.setdefault(r[0], []).append((r[1], r[2]))
    out = []
    frequent = {r[0]: r[1] for r in own.groupBy("lang").count().where(F.col("lang").isin(list(found))).collect()} if found else {}
    for lang, texts in sorted(found.items(), key=lambda x: (-frequent.get(x[0], 0), x[0])):
        words: list[bytes] = []
        held = 0
        for _, text in sorted(texts):
            own_words = normal(text).split()
            words += own_words
            held += sum(map(len, own_words)) + len(own_words)
            if held >= 2 * size:
                break
        order = sorted(range(len(words)), key=lambda i: xxhash.xxh3_64_intdigest(i.to_bytes(8, "little")))
        out.append((lang, b" ".join(words[i] for i in order)[:size]))
    return out


class Classifier:
    def __init__(self, learned: list[tuple[str, bytes]], level: int, min_margin: float):
        import zstandard

        self.min_margin, self.coders = min_margin, []
        for lang, data in learned:
            own = []
            for at in (level, SHORT_LEVEL):
                shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                shared.precompute_compress(level=at)
                own.append(zstandard.ZstdCompressor(level=at, dict_data=shared).compress)
            self.coders.append((lang, *own))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = normal(text)
        if len(data) < SHORT_BYTES:
            sizes = [len(compress(PADDING + b" " + data + b" ")) for _, _, compress in self.coders]
        else:
            blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
            sizes = [sum(map(len, map(compress, blocks))) for _, compress, _ in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        score = (second - sizes[best]) / second
        return self.coders[best][0], score, score < self.min_margin


def predict(docs: DataFrame, learned: list[tuple[str, bytes]], *, level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    base = docs.drop("lang_pred", "score", "rejected")
    at, model = base.columns.index("text"), docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(model.value, level, min_margin)
        for batch in batches:
            common.give_back()
            found = [judge(x.as_py()) for x in batch.column(at)]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(common.freed(run), f"{schema}, lang_pred string, score double, rejected boolean")


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def keep_known(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that aren't rejected, all columns as they are; learns from the rows whose remainder modulo 5 is not 0."""
    clash = {c: f"__own_{c}" for c in ("lang_pred", "score", "rejected") if c in docs.columns}
    learned = dictionaries(docs.where(remainder(5) != 0))
    kept = predict(docs.withColumnsRenamed(clash), learned, **params).where("NOT rejected").drop("lang_pred", "score", "rejected")
    return kept.withColumnsRenamed({b: a for a, b in clash.items()}).select([F.col(f"`{c}`") for c in docs.columns])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = dictionaries(docs.where(remainder(5) != 0))
    return predict(docs.select("doc_id", "text", (remainder(5) == 0).alias("held_out")), learned).drop("text")
