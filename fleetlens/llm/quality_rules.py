"""Quality rules: counts of each text, and cross-document line frequency. DataFrame functions only.

Method: the normalised lines (lower-cased, trimmed) of each document are hashed; a line that more than MAX_DOCS distinct documents of one
host (`source`) have is removed (`cleaned` gives the texts without these), and a document that loses more than MAX_LOST percent of its distinct lines' words is rejected.

Repeated words, within a row: hashes of all 3-word windows are packed with their places and sorted, so equal ones become neighbours;
each place whose window has an equal neighbour covers three words, and the sorted places add up to the union. Where different windows stand side by side
under one packed hash, the windows' words themselves are sorted instead, so counts are exact.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own, apart from an empty one; rows with equal ids are taken as copies of one document and count once;
rows with a null id count for no line and lose none; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import common

MAX_DOCS, MAX_LOST = 50, 50
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def base_counts(docs: DataFrame, *, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Of a window's hash at most hash_bits are packed; the result is the same with any."""
    text = F.coalesce("text", F.lit(""))
    trimmed = docs.select("doc_id", text.alias("text"), F.btrim(text, F.lit(SPACE)).alias("body"))
    words = trimmed.select("doc_id", "text", F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", SPACES)).alias("words"))
    # Places need bits enough for the number of words; the other bits are the hash's, and the whole hash is compared where these agree.
    bits, n = F.col("bits"), F.size("words")
    shift = lambda name, x: F.call_function(name, x, bits)
    alike = lambda x: reduce(Column.__and__, (F.get("words", x["a"] + k) == F.get("words", x["b"] + k) for k in range(3)))
    sized = words.withColumns({"n": n, "bits": F.greatest(F.ceil(F.log2(n + F.lit(1))), F.lit(max(1, 64 - hash_bits))).cast("int")})
    made = F.transform("words", lambda x, i: shift("shiftleft", shift("shiftright", F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))).bitwiseOR(i.cast("long")))
    packed = sized.withColumn("packed", F.sort_array(F.when(n > 2, F.slice(made, 1, n - 2)).otherwise(F.array().cast("array<bigint>"))))
    neighbours = F.zip_with(F.col("packed"), F.slice("packed", 2, F.greatest(n, F.lit(1))), lambda a, b: F.when(shift("shiftright", a.bitwiseXOR(b)) == 0, F.struct(a.alias("a"), b.alias("b"))))
    place = lambda x: x.bitwiseAND(shift("shiftleft", F.lit(1).cast("long")) - 1).cast("int")
    near = packed.withColumn("near", F.filter(neighbours, lambda x: x.isNotNull()))
    placed = near.withColumn("near", F.transform("near", lambda x: F.struct(place(x["a"]).alias("a"), place(x["b"]).alias("b"))))
    spelled = F.sort_array(F.transform(F.slice("words", 1, n - 2), lambda x, i: F.struct(x.alias("x"), F.get("words", i + 1).alias("y"), F.get("words", i + 2).alias("z"), i.alias("i"))))
    equal = F.zip_with(spelled, F.slice(spelled, 2, n), lambda a, b: F.when((a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"]), F.struct(a["i"].alias("a"), b["i"].alias("b"))))
    found = placed.withColumn("same", F.when(F.forall("near", alike), F.col("near")).otherwise(F.filter(equal, lambda x: x.isNotNull())))
    found = found.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.transform("same", lambda x: F.array(x["a"], x["b"]))))))
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    filled = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return found.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(filled) - F.size(F.array_distinct(filled))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def _normal(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")


def _host() -> Column:
    """The host as a key; no host has the key of none."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host")


def _distinct_lines() -> Column:
    return F.array_distinct(F.transform(F.split(F.lower("text"), "\n"), _normal))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, host, h1, h2 of each distinct normalised line of each row."""
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", _host(), F.explode(_distinct_lines()).alias("line")).where("line <> ''")
    return own.select("doc_id", "host", *_hashes(F.col("line")))


def lost_lines(lines: DataFrame, *, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, h1, h2 of the distinct lines that documents lose: of hashed_lines, those above the limit in their host."""
    keys = ["host", "h1", "h2"]
    frequent = lines.groupBy(*keys).agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") > max_docs)
    return common.met(lines, frequent, keys, "docs").select("doc_id", "h1", "h2").distinct()


def depletion(docs: DataFrame, *, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, the hashes of the lines that it loses (`gone`), and the words of distinct lines that it loses and has, of documents that lose any."""
    lost = lost_lines(common.checkpointed(hashed_lines(docs)), max_docs=max_docs)
    lists = common.checkpointed(lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")))
    # Only documents that lose lines are split again, for the words of their lines.
    split = common.semi(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), lists.select("doc_id"), "doc_id").select("doc_id", F.explode(_distinct_lines()).alias("line")).where("line <> ''")
    words = split.select("doc_id", *_hashes(F.col("line")), F.size(F.split("line", SPACES)).alias("words")).distinct()
    sums = words.join(lists, "doc_id").groupBy("doc_id").agg(F.sum(F.when(F.array_contains("gone", F.struct("h1", "h2")), F.col("words"))).alias("lost"), F.sum("words").alias("total"))
    return lists.join(sums, "doc_id")


def cleaned(docs: DataFrame, *, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """docs without the depleted documents, and with the frequent lines cut out of the others' texts; `__n_removed` counts these lines."""
    found = depletion(common.renamed_apart(docs, ["doc_id", "text", "source"]), max_docs=max_docs)
    lists = common.checkpointed(found.select("doc_id", F.struct("gone", _depleted(max_lost).alias("depleted")).alias("__found")))
    raw, gone = F.split("text", "\n"), F.col("__found.gone")
    kept = F.filter(raw, lambda x: ~F.array_contains(gone, F.struct(*_hashes(_normal(F.lower(x))))))
    out = common.with_lists(docs, lists, "doc_id", "__found").where("__found IS NULL OR NOT __found.depleted").withColumn("__kept", F.when(gone.isNull() | F.col("text").isNull(), F.array()).otherwise(kept))
    text = F.when(gone.isNull(), F.col("text")).when(F.col("text").isNotNull(), F.array_join("__kept", "\n"))
    removed = F.when(gone.isNull() | F.col("text").isNull(), 0).otherwise(F.size(raw) - F.size("__kept")).cast("long")
    return out.withColumns({"__n_removed": removed, "text": text}).select(*[F.col(f"`{c}`") for c in docs.columns], "__n_removed")


def _depleted(max_lost: int) -> Column:
    return 100 * F.col("lost") > max_lost * F.col("total")


def judged(docs: DataFrame, *, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """doc_id, the base counts, base_failed, n_lost (words) and kept of each row of docs (doc_id, text, source)."""
    own = common.renamed_apart(docs, ["doc_id", "text", "source"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = depletion(own, max_docs=max_docs).select("doc_id", "lost", _depleted(max_lost).alias("depleted"))
    base = base_counts(own).withColumn("base_failed", failed)
    return base.join(verdict, "doc_id", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("lost", F.lit(0)).cast("long").alias("n_lost"), (~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
gram AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM tri),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM gram) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM d),
filled AS (SELECT doc_id, source, raw, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n, trim(lower(raw), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS norm FROM line WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM filled GROUP BY doc_id),
own AS (SELECT DISTINCT doc_id, coalesce('=' || source, '') AS host, norm, n FROM filled),
freq AS (SELECT host, norm FROM own GROUP BY host, norm HAVING count(DISTINCT doc_id) > 50),
loss AS (SELECT o.doc_id, sum(o.n) AS total, coalesce(sum(o.n) FILTER (f.norm IS NOT NULL), 0) AS lost FROM own o LEFT JOIN freq f ON o.host = f.host AND o.norm = f.norm GROUP BY o.doc_id),
base AS (SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, length(array_to_string(w.words, '')) AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(loss.lost, 0) AS lost, coalesce(loss.total, 0) AS total
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN loss USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(lost AS BIGINT) AS n_lost,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * lost > 50 * total) AS kept FROM base
"""
