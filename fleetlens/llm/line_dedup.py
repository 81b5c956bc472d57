"""Line dedup: lines equal to an earlier line or within one edit of one go, the earliest stays. DataFrame functions only.

Lines are compared as lower-cased and trimmed; empty ones are left alone. Order is by (doc_id, place in the text).
A line goes if an equal line, or one of `min_chars` characters or more if a near line of as many, stands earlier anywhere.

Deletion neighbourhood, for an edit bound of 1. Of each distinct line, the strings that lack one of its characters are hashed:
* with the place of the deletion: lines that share such a key differ by one replaced character;
* alone, against whole lines: the longer line has one more character.
A key's earliest line is enough for all of its lines, so a key makes no pairs among them. Each find is confirmed by levenshtein().

Which lines send variants: two lines one edit apart have the first half or the second half in common (of the shorter one's length), and, of
eight windows, all but one. So each line first sends four hashed halves; lines that share one with a different line send hashes of all but
each window, in rounds if the windows are wide; and lines that share such a one send variants, of that window's places.

Defined cases: null texts stay null; a text whose lines all go becomes empty (dedup_lines can drop such rows); rows with equal ids are taken as copies
of one document; rows with a null id are left alone; further columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import common

#: For near lines only; equal lines go at any length.
MIN_CHARS = 20
WINDOWS, NARROW = 8, 64


def _hash(*parts: Column | int) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, pos, line (normalised), h1, h2 of each line of min_chars characters or more."""
    split = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "raw"))
    lines = split.select("doc_id", "pos", F.btrim("raw", F.lit(" \t\r\f\x0b")).alias("line")).where(F.length("line") >= min_chars)
    return lines.withColumns({"h1": _hash(F.col("line")), "h2": _hash(1, F.col("line"))})


def _halves() -> dict[str, Column]:
    """Hashes of the first and second half, for a shorter line of this length and of one character less."""
    n, line = F.length("line"), F.col("line")
    out = {}
    for k, shorter in enumerate((n, n - 1)):
        half = F.floor(shorter / 2).cast("int")
        out |= {f"front{k}": _hash(shorter, 0, line.substr(F.lit(1), half)), f"back{k}": _hash(shorter, 1, line.substr(n - shorter + half + 1, shorter - half))}
    return out


def _shared(keys: DataFrame) -> DataFrame:
    """The rows (key, id, ...) whose key a different id has, too."""
    several = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")
    return common.met(keys, several, ["key"], "n")


def _windows(lines: DataFrame) -> DataFrame:
    """first, low, high: the places of lines (id, first, line) in which a different line may have its one edit.

    Round by round, each stretch left is cut into WINDOWS; the line but for each window is hashed, and windows whose hash another line has stay, until
    they are NARROW. Lines of any length so make few variants. `shorter` is the shorter line's length: this one's, or one less."""
    n, line = F.length("line"), F.col("line")
    left = lines.select("id", "first", "line", F.explode(F.array(n, n - 1)).alias("shorter")).withColumns({"before": F.lit(0), "after": F.lit(0)})
    middle = F.col("shorter") - F.col("before") - F.col("after")
    longest = lines.agg(F.max(n)).first()[0] or 0
    done = []
    for _ in range(max(1, math.ceil(math.log(max(longest, 1) / NARROW, WINDOWS)))):
        cut = [F.struct((F.col("before") + F.floor(middle * w / WINDOWS)).cast("int").alias("before"), (F.col("shorter") - F.col("before") - F.floor(middle * (w + 1) / WINDOWS)).cast("int").alias("after")) for w in range(WINDOWS)]
        parts = left.select("id", "first", "line", "shorter", F.explode(F.array(*cut)).alias("w")).select("id", "first", "line", "shorter", "w.*")
        hashed = parts.withColumn("key", _hash(F.col("shorter"), F.col("before"), F.col("after"), line.substr(F.lit(1), F.col("before")), line.substr(n - F.col("after") + 1, F.col("after"))))
        kept = common.checkpointed(_shared(hashed.select("id", "first", "shorter", "before", "after", "key")).join(lines.select("first", "line"), "first").drop("key"))
        done.append(kept.where(middle <= NARROW))
        left = kept.where(middle > NARROW)
    found = left
    for part in done:
        found = found.unionByName(part)
    return found.select("first", (F.col("before") + 1).alias("low"), (n - F.col("after")).alias("high"))


def _variants(lines: DataFrame) -> DataFrame:
    """key, role, first, line of the variants of lines (first, line, places). Roles: 0 a replaced character, 1 one too many, 2 the line itself.

    Of a run of equal characters, any deletion leaves the same, so role 1 takes the first of its places alone: no line sends a key twice."""
    line = F.col("line")
    at = lines.select("first", "line", "places", F.posexplode("places").alias("j", "i"))
    i, before = F.col("i"), F.get("places", F.col("j") - 1)
    cut = F.concat(line.substr(F.lit(1), i - 1), line.substr(i + 1, F.length("line")))
    new = before.isNull() | (before < i - 1) | (line.substr(i - 1, F.lit(1)) != line.substr(i, F.lit(1)))
    made = at.select("first", "line", i.alias("i"), cut.alias("cut"), new.alias("new"))
    one = F.struct(_hash(F.col("cut"), F.col("i")).alias("key"), F.lit(0).alias("role"))
    two = F.when(F.col("new"), F.struct(_hash(F.col("cut")).alias("key"), F.lit(1).alias("role")))
    edited = made.select("first", "line", F.explode(F.array(one, two)).alias("v")).where("v IS NOT NULL")
    return edited.unionByName(lines.select("first", "line", F.struct(_hash(line).alias("key"), F.lit(2).alias("role")).alias("v"))).select("first", "line", "v.*")


def _near(distinct: DataFrame, docs: DataFrame, min_chars: int) -> DataFrame:
    """`first` of the distinct lines that are one edit from an earlier one."""
    suspects = _shared(distinct.where("front0 IS NOT NULL").select(F.col("h1").alias("id"), "first", F.explode(F.array("front0", "back0", "front1", "back1")).alias("key")))
    wanted = common.checkpointed(suspects.select("first").distinct())
    texts = _lines(common.semi(docs, wanted.select(F.col("first.doc_id").alias("doc_id")).distinct(), "doc_id"), min_chars).select(F.struct("doc_id", "pos").alias("first"), "line", F.col("h1").alias("id")).dropDuplicates(["first"])
    own = common.checkpointed(wanted.join(texts, "first"))
    places = _windows(own).groupBy("first").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.sequence("low", F.greatest("low", "high")))))).alias("places"))
    rows = _variants(own.select("first", "line").join(places, "first").withColumn("places", F.filter("places", lambda i: i <= F.length("line"))))
    several = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = common.checkpointed(common.met(rows, several, ["key"], "n"))
    least = lambda role: F.min(F.when(F.col("role") == role, F.struct("first", "line")))
    earliest = met.groupBy("key").agg(*[least(r).alias(f"e{r}") for r in (0, 1, 2)])
    earlier = F.when(F.col("role") == 0, F.col("e0")).when(F.col("role") == 1, F.col("e2")).otherwise(F.col("e1"))
    found = met.join(earliest, "key").withColumn("earlier", earlier).where("earlier.first < first")
    return found.where(F.levenshtein("line", "earlier.line", 1).between(0, 1)).select("first").distinct()


def removed_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and `gone`, the places of its lines that go."""
    own = common.renamed_apart(docs, ["doc_id", "text"])
    halves = {k: F.when(F.length("line") >= min_chars, x) for k, x in _halves().items()}
    lines = common.checkpointed(_lines(own, 1).withColumns(halves).drop("line"))
    distinct = common.checkpointed(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("copies"), *[F.min(k).alias(k) for k in halves]))
    near = common.checkpointed(_near(distinct, own, min_chars)).withColumn("near", F.lit(True))
    doubtful = distinct.join(near, "first", "left").where("copies > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"), "copies")
    gone = common.met(lines.select("doc_id", "pos", "h1", "h2"), doubtful, ["h1", "h2"], "copies").where(F.col("near") | (F.struct("doc_id", "pos") != F.col("first")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, drop_emptied: bool = False) -> DataFrame:
    """docs with the text's removed lines cut out, and `__n_lines`, `__n_removed`. With drop_emptied, rows whose lines with a word are all removed go."""
    lists = common.checkpointed(removed_lines(docs, min_chars=min_chars)).withColumnRenamed("gone", "__gone")
    raw = F.split("text", "\n")
    kept = F.filter(raw, lambda x, i: ~F.coalesce(F.array_contains("__gone", i), F.lit(False)))
    out = common.with_lists(docs, lists, "doc_id", "__gone").withColumns({"__n_lines": F.coalesce(F.size(raw), F.lit(0)).cast("long"), "__n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "__kept": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))})
    if drop_emptied:
        out = out.where("__n_removed = 0 OR length(btrim(__kept, ' \t\r\n\f')) > 0")
    return out.withColumn("text", F.col("__kept")).select(*[F.col(f"`{c}`") for c in docs.columns], "__n_lines", "__n_removed")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM raw WHERE trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> ''),
firsts AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM lines GROUP BY line),
long AS (SELECT * FROM firsts WHERE n >= 20),
keys AS (
  SELECT line, first, n AS l, 'front' AS side, left(line, n // 2) AS part FROM long UNION ALL
  SELECT line, first, n, 'back', right(line, n - n // 2) FROM long UNION ALL
  SELECT line, first, n - 1, 'front', left(line, (n - 1) // 2) FROM long UNION ALL
  SELECT line, first, n - 1, 'back', right(line, n - 1 - (n - 1) // 2) FROM long),
near AS (SELECT DISTINCT a.line FROM keys a JOIN keys b USING (l, side, part) WHERE b.first < a.first AND a.line <> b.line AND levenshtein(a.line, b.line) <= 1),
gone AS (SELECT DISTINCT doc_id, pos FROM lines JOIN firsts USING (line) WHERE (doc_id, pos) <> first OR line IN (SELECT line FROM near)),
whole AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
kept AS (SELECT w.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(w.raw, chr(10) ORDER BY w.pos) FILTER (g.pos IS NULL), '') AS text
  FROM whole w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
