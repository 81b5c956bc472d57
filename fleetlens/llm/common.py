"""What the operators of this subpackage share: reading tables, reliable checkpoints, worker state, texts of Arrow columns."""

from __future__ import annotations

import contextlib
import gc
import re
import sys
import tempfile
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker takes apart at a time; bounds its Python objects whatever the Arrow batch holds.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_path(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, also for tables that an operator writes. Only a local master, whose executors share its disk, gets a folder of its own where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and cut off from its lineage."""
    checkpoint_path(df.sparkSession)
    return df.checkpoint(eager=True)


#: States that a worker keeps; the one unused for longest goes first.
STATES = 3


def worker_state(key: Any, build: Callable[[], Any]) -> Any:
    """What build() returned first in this process; survives from task to task of a reused worker, for the last STATES keys, until another operator's task (see freed)."""
    held = sys.__dict__.setdefault("_fleetlens_state", {})
    state = held.pop(key, None)
    if state is None:
        while len(held) >= STATES:
            del held[next(iter(held))]
        state = build()
    held[key] = state  # now the last one
    return state


def give_back() -> None:
    """Returns memory that this process has freed to the system; workers live on beside others."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def only_states_of(operator: str) -> None:
    """Drops what the worker keeps for another operator than that of its next task: one that lives on holds the tables of one operator at a time."""
    if sys.__dict__.get("_fleetlens_operator") != operator:
        sys.__dict__["_fleetlens_operator"] = operator
        if sys.__dict__.pop("_fleetlens_state", None):
            gc.collect()  # coders and their caches refer to each other
            give_back()


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that finds no states of other operators (told by module), and gives memory back when its task ends, too."""
    operator = run.__module__

    def own(batches: Iterator) -> Iterator:
        only_states_of(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    give_back()
    return column.cast(pa.binary()).to_pylist()


def sliced(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[range]:
    """Ranges of neighbouring rows of about `most` bytes each; a longer row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield range(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield range(start, len(sizes))


def text_slices(column: pa.Array) -> Iterator[tuple[range, list[bytes | None]]]:
    """Ranges of rows, and their texts; of a batch, only one range's texts are Python objects at a time."""
    import pyarrow.compute as pc

    for rows in sliced(pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_pylist()):
        yield rows, byte_texts(column.slice(rows.start, len(rows)))


#: The contract's word patterns. Words of the first are cut by white space only.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: As LOWER, and a space for each byte that no word of PLAIN_WORD has.
PLAIN = bytes(b if b >= 0x80 or re.match(rb"[0-9a-z]", bytes([b])) else 32 for b in LOWER)


def words(text: bytes | None) -> list[bytes]:
    """The SPACE_WORDs of a UTF-8 text: bytes.split() cuts at exactly these six bytes."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def renamed_apart(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the columns an operator needs, so that further ones can't clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


_CUT = re.compile(rb"[\x20\x09-\x0D]")
PIECE_BYTES = 4_000_000


def word_array(data: bytes | None, get: Callable[[bytes], Any], dtype: str) -> Any:
    """get(word) of each SPACE_WORD, as an array; a very long text is taken apart piece by piece."""
    import numpy as np

    if not data:
        return np.zeros(0, dtype)
    out, at = [], 0
    while at < len(data):
        cut = _CUT.search(data, at + PIECE_BYTES)
        end = cut.start() if cut else len(data)
        own = (data if at == 0 and end == len(data) else data[at:end]).split()
        out.append(np.fromiter(map(get, own), dtype, count=len(own)))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out)


def spread(x: Any) -> Any:
    """64-bit numbers, each bit of which depends on all bits of x (splitmix64's last steps)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: Any) -> Any:
    """Sorted distinct values."""
    import numpy as np

    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class _Bytes:
    """What word_hashes needs: powers of an odd base and of its inverse, modulo 2**64, a number for each byte, and which bytes are white space."""

    BASE, PIECE = 0x9E3779B97F4A7C15, 1 << 19

    def __init__(self):
        import numpy as np

        self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.PIECE - 1, b, np.uint64)])) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        self.numbers = spread((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(self.BASE))
        self.white = np.array([bool(_CUT.match(bytes([b]))) for b in range(256)])


def word_hashes(data: bytes | None) -> Any:
    """64-bit hashes of the SPACE_WORDs of a text, in order: Rabin-Karp hashes of their bytes from sums over the text, piece by piece. Words longer than a piece are hashed by xxh3."""
    import numpy as np
    import xxhash

    if not data:
        return np.zeros(0, np.uint64)
    own = worker_state("bytes", _Bytes)
    out, at, most = [], 0, own.PIECE
    while at < len(data):
        piece = np.frombuffer(data, np.uint8, min(most, len(data) - at), at)
        white = own.white[piece]
        if at + len(piece) < len(data):  # words end within the piece
            if not white.any():
                cut = _CUT.search(data, at + len(piece))
                stop = cut.start() if cut else len(data)
                if stop - at > most:
                    out.append(np.array([xxhash.xxh3_64_intdigest(data[at:stop])], np.uint64))
                    at = stop
                    continue
                n = stop - at
            else:
                n = len(white) - int(np.argmax(white[::-1]))
            piece, white = piece[:n], white[:n]
        edges = np.diff((~white).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(own.numbers[piece] * own.up[: len(piece)], out=sums[1:])
        out.append(spread((sums[ends] - sums[starts]) * own.down[starts]))
        at += len(piece)
    return out[0] if len(out) == 1 else np.concatenate(out)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


#: The most ids that are broadcast; beyond it, a join shuffles.
BROADCAST_IDS = 250_000


def semi(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """df with only the rows whose `column` is among ids (or, with left_anti, is not); ids are computed once, and broadcast if they are counted and few."""
    ids = checkpointed(ids)
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), column, how)


#: Rows from which a key is common.
HOT_ROWS = 2000


def met(df: DataFrame, keys: DataFrame, on: Sequence[str], rows: str, *, most: int = BROADCAST_IDS, hot_rows: int = HOT_ROWS, few: bool = True) -> DataFrame:
    """df joined with keys (unique in `on`; `rows` tells how many rows of df have each).

    Common keys, of over hot_rows rows (or, should they be more than `most`, of more rows yet), are broadcast, so no task gets all rows of one; the others are
    met by a shuffle. With `few`, all keys are broadcast where they are counted and at most `most`."""
    keys = checkpointed(keys)
    if few and keys.limit(most + 1).count() <= most:
        return df.join(F.broadcast(keys.drop(rows)), list(on))
    common = keys.where(F.col(rows) > hot_rows)
    if (n := common.count()) > most:
        hot_rows = common.select(F.percentile_approx(rows, 1 - most / n / 2, 10_000)).first()[0]
        common = keys.where(F.col(rows) > hot_rows)
    rest = df.join(keys.where(F.col(rows) <= hot_rows).drop(rows), list(on))
    return df.join(F.broadcast(common.drop(rows)), list(on)).unionByName(rest) if n else rest


def with_lists(df: DataFrame, lists: DataFrame, column: str, added: str) -> DataFrame:
    """df left-joined with `lists`, one row an id. Rows of df that have none don't move, if the ids that have one are few enough to broadcast."""
    ids = lists.select(column)
    if ids.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return df.join(lists, column, "left")
    ids = F.broadcast(ids)
    without = df.join(ids, column, "left_anti").withColumn(added, F.lit(None).cast(lists.schema[added].dataType))
    return df.join(ids, column, "left_semi").join(lists, column).unionByName(without)
