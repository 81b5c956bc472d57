"""Token counts by overlap resynchronisation.

A text of up to `chunk_chars` characters is encoded in one piece. A longer one is encoded in chunks that overlap, with offsets,
and two neighbouring chunks are spliced at a common boundary: a place in the overlap that no match of the vocabulary's pattern and no composition
of characters spans, whatever stands around it, and from which on both encodings have the same tokens at the same characters up to the next such
place. These places are white space and, for vocabularies of the pattern WORD_PATTERN, changes among letters, digits and punctuation. Without one the overlap is
widened twofold, in the end to the whole chunk; chunks without any place (one word of millions of letters) grow twofold, so work stays in proportion to the text.

Defined cases: a null text counts as empty (n_bytes 0, n_tokens 0, not over the limit); rows are independent, so repeated rows,
null ids and further columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import common, pieces

VOCABULARY = "word_bpe_49k.json"
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
LIMIT = 2048


#: Fixed value: the pattern by which the vocabulary cuts texts before merging; each digit and each run of letters or of other characters is a match.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = regex.compile(r"(?<![ \n\t\r])(?=[ \n\t\r])")
# Characters that neither compose with a neighbour nor change their class in lower case; no apostrophe, which may begin a match, and nothing that special tokens have.
_PLAIN = r"[\x21-\x26\x28-\x3B=\x3F-\x7B}~¡-įı-˿、-〃〈-】ぁ-ゖァ-ヿ一-鿿가-힣！-～]"
_LETTER, _DIGIT, _OTHER = rf"[{_PLAIN}&&\p{{L}}]", rf"[{_PLAIN}&&\p{{N}}]", rf"[{_PLAIN}--[\p{{L}}\p{{N}}\p{{M}}]]"
CHANGES = regex.compile(rf"(?V1)(?<![ \n\t\r])(?=[ \n\t\r])|(?<={_DIGIT})(?=[{_PLAIN}--\p{{M}}])|(?<={_PLAIN})(?={_DIGIT})|(?<={_LETTER})(?={_OTHER})|(?<={_OTHER})(?={_LETTER})")
#: Its small form depends on what stands behind it.
SIGMA = "Σ"


def cuts_by_words(coder: pieces.WordEnd) -> bool:
    """Whether the vocabulary cuts by WORD_PATTERN; told once for a coder."""
    if not hasattr(coder, "by_words"):
        rules = json.loads(coder.tokenizer.to_str())["pre_tokenizer"] or {}
        coder.by_words = any(r.get("pattern") == {"Regex": WORD_PATTERN} for r in rules.get("pretokenizers", [rules]))
    return coder.by_words


class _Chunk:
    """Ids and first characters, in the whole text, of a stretch's tokens."""

    def __init__(self, coder: pieces.WordEnd, text: str, start: int, end: int):
        e = coder.tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, end, e.ids
        self.firsts = [start + a for a, _ in e.offsets]

    def before(self, at: int) -> int:
        return bisect_left(self.firsts, at)


def _splice(left: _Chunk, right: _Chunk, text: str, by_words: bool) -> int | None:
    """The first stable common boundary: a place in the overlap from which on, up to the next place, both chunks encode alike."""
    inside = by_words and text.find(SIGMA, right.start, left.end) < 0
    places = (m.start() for m in (CHANGES if inside else WHITE).finditer(text, right.start + 1, left.end) if m.start() < left.end)
    begin = next(places, None)
    for stop in places:
        a, b = slice(left.before(begin), left.before(stop)), slice(right.before(begin), right.before(stop))
        if left.ids[a] == right.ids[b] and left.firsts[a] == right.firsts[b]:
            return begin
        begin = stop
    return None


def count_huge(coder: pieces.WordEnd, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> int:
    """The number of tokens of one text, by overlapping chunks."""
    by_words = cuts_by_words(coder)
    total, low = 0, 0  # tokens before `low` are counted
    chunk = _Chunk(coder, text, 0, min(len(text), chunk_chars))
    while chunk.end < len(text):
        overlap = overlap_chars
        while True:
            start = max(low, chunk.end - overlap)
            nearest = _Chunk(coder, text, start, min(len(text), chunk.end + max(chunk_chars - overlap, chunk_chars // 2)))
            at = _splice(chunk, nearest, text, by_words)
            if at is not None:
                total += chunk.before(at) - chunk.before(low)
                low, chunk = at, nearest
                break
            if start == low:  # nothing to align with: both chunks become one, twice as long
                chunk = _Chunk(coder, text, low, min(len(text), chunk.end + max(chunk_chars, chunk.end - low)))
                break
            overlap *= 2
    return total + len(chunk.ids) - chunk.before(low)


def token_counts(docs: DataFrame, *, path: str | None = None, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and spliced (whether chunks were spliced) of each document."""
    path = path or pieces.default_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = common.worker_state(("count", path), lambda: pieces.WordEnd(path, by_count=True))
        for batch in batches:
            sizes: list[int] = []
            counts: list[int] = []
            huge: list[bool] = []
            for _, part in common.text_slices(batch.column(1)):
                texts = [(x or b"").decode("utf-8", errors="replace") for x in part]
                long = [len(x) > chunk_chars for x in texts]
                short = iter(coder.count([x for x, own in zip(texts, long, strict=True) if not own]))
                counts += [count_huge(coder, x, chunk_chars, overlap_chars) if own else next(short) for x, own in zip(texts, long, strict=True)]
                sizes += [len(x or b"") for x in part]
                huge += long
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(huge, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "spliced"])

    own = common.renamed_apart(docs, ["doc_id", "text"])
    return own.mapInArrow(common.freed(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, spliced boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
