"""The ten operators and the pipeline against brute force, and the defined cases."""

import hashlib
import math
import random
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import byte_bpe, common, decontaminate, katz_lm, language_id, line_dedup, near_dedup, pieces, quality_rules, queries, substring_dedup, token_counts, token_files
from fleetlens.llm.components import connected
from tests.oracle_tools import assert_same, connection, rows

ODD = ["", "  a\t\n b ", "a!\x1c b", "x y z", "  ", "don't  I'll\r\n\tgo 12 345 <|endoftext|> !!  ", "İH̱ Σας Ünïcode\x01 é é", "日本語 \U0001f600 ok", "A" * 3000, None]
#: Texts with the usual trouble, ids that repeat or are missing, and columns with names that operators use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans int, keys int, score string, gone int, token_ids string, set_hash string, kept string"


@pytest.fixture(scope="module")
def docs(spark, small):
    return common.table(spark, small, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    made = [(i, t, "en", "h", 1) for i, t in enumerate(ODD)] + [(1, ODD[1], "en", "h", 1), (None, "null id text", None, None, None), (20, "same words here and there " * 30, "en", "h", 1), (21, "same words here and there " * 30, None, None, 1)]
    return spark.createDataFrame([(*r, 1, 2, 3, "s", 4, "t", "u", "k") for r in made], CLASHING)


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def space_words(text):
    return (text or "").encode().split()


# 1


def brute_windows(texts, items, size):
    find = re.compile(common.PLAIN_WORD).findall
    windows = {}
    for item, text in items:
        own = find(lower(text))
        n = min(size, len(own))
        for s in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[s : s + n]), set()).add(str(item))
    sizes, out = {len(w) for w in windows}, {}
    for doc, text in texts.items():
        own, hit, found = find(lower(text)), set(), set()
        for n in sizes:
            for s in range(len(own) - n + 1):
                if got := windows.get(tuple(own[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= got
        out[doc] = (len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("size", [10, 3, 1])
def test_decontaminate(spark, small, docs, texts, size):
    benchmark = common.table(spark, small, "benchmark")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digests(docs, benchmark, window=size).collect()}
    assert got == brute_windows(texts, [(r.item_id, r.text) for r in benchmark.collect()], size)


def test_decontaminate_blocks_and_cases(spark, odd):
    benchmark = spark.createDataFrame([(7, "same words here"), (None, "a b"), (8, ""), (9, None), (7, "same words here")], "item_id long, text string")
    whole = decontaminate.digests(odd, benchmark).drop("longest_match").toPandas()
    assert rows(whole) == rows(decontaminate.find_matches(odd.select("doc_id", "text"), benchmark, block_bytes=4).select("doc_id", "n_words", "n_hit", F.size(F.array_distinct("match_items")).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.array_distinct("match_items")), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")).toPandas())
    kept = decontaminate.remove_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.where("doc_id = 20").count() == 0
    assert decontaminate.digests(odd, benchmark.limit(0)).where("contaminated").count() == 0
    match = decontaminate.find_matches(spark.createDataFrame([(1, "x y a b c d z")], "doc_id long, text string"), spark.createDataFrame([(3, "q a b c d e")], "item_id long, text string"), window=2).first()
    assert (match.match_item_starts, match.match_doc_starts, match.match_words) == ([1], [2], [4])


def test_decontaminate_in_blocks(spark, small, docs):
    """Many blocks find what one finds, and rows with the same text or id have the same finds."""
    benchmark, twice = common.table(spark, small, "benchmark"), docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(20))
    whole, parts = (rows(decontaminate.digests(twice, benchmark, window=3, block_bytes=b).toPandas()) for b in (1 << 30, 2000))
    assert whole == parts and any("True" in r for r in whole)


# 2, 7, 9


@pytest.fixture(scope="module")
def reference():
    ranks = pieces.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, texts, odd, reference):
    for table, own in ((docs, texts), (odd, {i: t for i, t in enumerate(ODD)})):
        for r in byte_bpe.digests(table).where("doc_id IS NOT NULL").collect():
            if r.doc_id in own:
                ids = reference.encode_ordinary(own[r.doc_id] or "")
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((own[r.doc_id] or "").encode()).hexdigest())


def test_byte_bpe_round_trip(odd, reference):
    done = byte_bpe.decode(byte_bpe.encode(odd)).collect()
    assert len(done) == odd.count()
    coder = pieces.ByteLevel(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for r in done:
        text = r.text or ""
        assert r.decoded_text == text and r.n_words == 1
        assert "".join(byte_bpe.token_texts(coder, r.token_ids)) == text
        assert all(0 <= a < b <= len(text) for a, b in zip(r.char_starts, r.char_ends))
        assert set().union(*(range(a, b) for a, b in zip(r.char_starts, r.char_ends))) == set(range(len(text)))
    assert byte_bpe.encode(odd.limit(0)).count() == 0


def test_merges_follow_ranks():
    merges = pieces.merges_of(ranks := pieces.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert len(merges) == len(ranks) - 256


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("chunk", [32_768, 300, 40])
def test_token_counts(docs, texts, odd, word_tokenizer, chunk):
    for table, own in ((docs, texts), (odd, dict(enumerate(ODD)))):
        for r in token_counts.token_counts(table, chunk_chars=chunk, overlap_chars=16).where("doc_id IS NOT NULL").collect():
            if r.doc_id in own:
                text = own[r.doc_id] or ""
                n = len(word_tokenizer.encode(text, add_special_tokens=False).ids)
                assert (r.n_bytes, r.n_tokens, r.over_limit, r.spliced) == (len(text.encode()), n, n > 2048, len(text) > chunk), text[:50]


@pytest.mark.parametrize("text", [
    "今日は、晴れです。" * 4000, "aGVsbG8gd29ybGQ9MTIzNDU2Nzg5MA+/" * 2000, "a" * 60_000, "x'sll've!?'d<|endoftext|>9" * 3000, "ΟΣ.ΑΣ! İ!क़!é," * 3000, "क़!क़?각!" * 3000, "が゙!が?" * 4000,
])
def test_token_counts_without_white_space(word_tokenizer, text):
    coder = pieces.WordEnd(public_tokenizers.path("word_bpe_49k.json"), by_count=True)
    for chunk in (32_768, 1000, 301):
        assert token_counts.count_huge(coder, text, chunk, 16) == len(word_tokenizer.encode(text, add_special_tokens=False).ids)


def test_token_counts_random(word_tokenizer):
    rng, coder = random.Random(6), pieces.WordEnd(public_tokenizers.path("word_bpe_49k.json"), by_count=True)
    parts = ["a", "The", "1", "42", "'", "'s", "!", "<|", "|>", "<|endoftext|>", "。", "日", "か", "゙", "́", "e", "İ", "Σ", ".", "क़", "가", "ᄀ", "ᅡ", "é", "½", " ", "\n"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(400))
        assert token_counts.count_huge(coder, text, 60, 8) == len(word_tokenizer.encode(text, add_special_tokens=False).ids), text


def test_long_words_take_time_in_proportion():
    """Characters encoded in all are a small multiple of the text's."""
    coder = pieces.WordEnd(public_tokenizers.path("word_bpe_49k.json"), by_count=True)

    class Counted:
        def __init__(self):
            self.n, self.to_str = 0, coder.tokenizer.to_str

        def encode(self, text, **options):
            self.n += len(text)
            return coder.tokenizer.encode(text, **options)

    class Own:
        tokenizer = Counted()

    for text, most in (("a" * 300_000, 8), ("今日は、晴れです。" * 30_000, 1.2)):
        Own.tokenizer.n = 0
        token_counts.count_huge(Own, text, 4096)
        assert Own.tokenizer.n < most * len(text)


@pytest.mark.parametrize("kind", ["string", "smallint", "decimal(20,0)", "date", "double", "binary"])
def test_token_files_of_any_id(spark, tmp_path, kind):
    made = [(i % 9, f"text number {i} " * (i % 5)) for i in range(60)] + [(None, "no id")]
    df = spark.createDataFrame(made, "k int, text string").select((F.date_add(F.lit("2024-01-01"), F.col("k")) if kind == "date" else F.col("k").cast("string").cast(kind) if kind == "binary" else F.col("k").cast(kind)).alias("doc_id"), "text")
    token_files.write_files(df, str(tmp_path / "f"), shards=4, file_tokens=20)
    found = token_files.read_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert len(found) == 61 and ids[0] is None and ids[1:] == sorted(ids[1:]) and [r.start for r in found] == list(np.cumsum([0, *(r.n_tokens for r in found)])[:-1])


def test_token_files(spark, docs, texts, odd, word_tokenizer, tmp_path):
    for k, (table, own) in enumerate(((docs, texts), (odd.where("doc_id > 1"), dict(enumerate(ODD)) | {20: "same words here and there " * 30, 21: "same words here and there " * 30}))):
        token_files.write_files(table, str(tmp_path / str(k)), shards=5, file_tokens=3000)
        found = token_files.read_files(spark, str(tmp_path / str(k)), with_ids=True).orderBy("doc_id").collect()
        start = 0
        assert len(found) == table.count()
        for r in found:
            ids = [*word_tokenizer.encode(own[r.doc_id] or "", add_special_tokens=False).ids, 2]
            assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    token_files.write_files(odd.limit(0), str(tmp_path / "none"))
    assert token_files.read_files(spark, str(tmp_path / "none")).count() == 0


def test_variable_length_coding():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([5]), rng.zipf(1.2, 5000) % 49_000, np.arange(70_000), rng.integers(0, 1 << 31, 9), np.array([1 << 20, 3, 3]), np.array([(1 << 20) - 1, 7, 7])):
        assert (token_files.unpack(token_files.pack(ids.astype("<u4"))) == ids).all()
    with pytest.raises(ValueError):
        token_files.unpack(b"????" + bytes(20))


# 3, 10


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, small, name):
    assert_same(spark, small, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_quality_cases(spark, odd):
    got = quality_rules.judged(odd)
    assert got.count() == odd.count() and quality_rules.judged(odd.limit(0)).count() == 0
    one = {r.doc_id: r for r in got.collect()}
    assert one[20].n_repeat_words == 150 and one[20].base_failed and one[9].n_words == 0
    made = [(i, "common line of text here\n" + f"own {i} words", "h") for i in range(60)] + [(100, "common line of text here\n" + " ".join(f"w{i}" for i in range(80)), "h"), (101, "common line of text here", "g")]
    r = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(made, "doc_id long, text string, source string"), max_docs=50).collect()}
    assert r[0].n_lost == 5 and not r[0].kept and r[100].kept and r[101].n_lost == 0


def test_quality_null_host_is_not_an_empty_one(spark):
    made = [(i, "the same line\nown words of text", None if i % 2 else "") for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    assert quality_rules.judged(df, max_docs=50).where("n_lost > 0").count() == 0
    assert quality_rules.judged(df, max_docs=29).where("n_lost = 7").count() == 60


def test_quality_counts_despite_colliding_hashes(docs):
    own = docs.where(F.length("text") < 20_000)
    got, few = (sorted(map(tuple, quality_rules.base_counts(own, hash_bits=b).collect())) for b in (64, 4))
    assert got == few and any(r[-1] for r in got)


def test_quality_removes_frequent_lines(spark, odd):
    made = [(i, f"Cookie notice \nown text of document {i}\n\n cookie NOTICE", "h", 1) for i in range(6)] + [(10, "cookie notice\nab", "h", 2), (11, "Cookie notice\nab", "g", 3), (12, None, "h", 4), (None, "cookie notice", "h", 5)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, n_chars long")
    done = quality_rules.cleaned(df, max_docs=5)
    got = {r.doc_id: r for r in done.collect()}
    assert done.columns == [*df.columns, "__n_removed"] and set(got) == {*range(6), 11, 12, None}  # 10 is depleted
    assert all((got[i].text, got[i]["__n_removed"], got[i].n_chars) == (f"own text of document {i}\n", 2, 1) for i in range(6))
    assert [(got[i].text, got[i]["__n_removed"]) for i in (11, 12, None)] == [("Cookie notice\nab", 0), (None, 0), ("cookie notice", 0)]
    judged = {r.doc_id: r.n_lost for r in quality_rules.judged(df, max_docs=5).collect()}
    assert judged == {r[0]: 2 if r[0] in (*range(6), 10) else 0 for r in made}
    assert quality_rules.cleaned(odd).count() == odd.count() and quality_rules.cleaned(odd.limit(0)).count() == 0


def test_line_dedup_of_long_lines(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcd ") for _ in range(40_000))
    edits = [base, base[:17] + "X" + base[18:], base[:39_990] + base[39_991:], base[:20_000] + "Y" + base[20_000:], base[:5] + "Z" + base[6:300] + "Z" + base[301:], base + "!"]
    df = spark.createDataFrame(list(enumerate(edits)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.removed_lines(df).collect()} == {1, 2, 3, 5}


def test_line_dedup_random(spark):
    rng = random.Random(2)

    def near(a, b):
        a, b = sorted((a, b), key=len)
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return len(b) - len(a) <= 1 and a[i + (len(a) == len(b)) :] == b[i + 1 :]

    def changed(s):
        for _ in range(rng.randrange(3)):
            i, k = rng.randrange(len(s) + 1), rng.randrange(3)
            s = s[:i] + ("" if k == 0 else rng.choice("abc")) + s[i + (k != 1) :]
        return s

    base = ["".join(rng.choice("aab c") for _ in range(rng.randrange(3, 14))) for _ in range(40)]
    made = [(d, "\n".join(changed(rng.choice(base)) for _ in range(rng.randrange(6)))) for d in range(120)] + [(500, None), (501, "")]
    lines = [(d, p, n) for d, t in made if t is not None for p, x in enumerate(t.split("\n")) if len(n := x.strip()) >= 2]
    expected = {(d, p) for i, (d, p, n) in enumerate(lines) if any(near(n, m) for _, _, m in lines[:i])}
    df = spark.createDataFrame([*made, (None, made[3][1])], "doc_id long, text string")
    assert {(r.doc_id, p) for r in line_dedup.removed_lines(df, min_chars=2).collect() for p in r.gone} == expected


@pytest.mark.parametrize("options", [{}, {"few": False}, {"few": False, "hot_rows": 100}, {"most": 3, "hot_rows": 1}])
def test_met_splits_common_keys(spark, options):
    """However few keys are broadcast, the join is whole."""
    df = spark.range(500).select((F.col("id") % F.when(F.col("id") < 300, 2).otherwise(40)).alias("k"), "id")
    keys = df.where("k <> 3").groupBy("k").count()
    got = common.met(df, keys, ["k"], "count", **options)
    assert got.columns == ["k", "id"] and sorted(r.id for r in got.collect()) == sorted(r.id for r in df.where("k <> 3").collect())


def test_line_dedup_of_short_lines(spark):
    """Equal lines go at any length; short ones that are only near stay."""
    made = [(0, "Menu\n\nHome | Login\n}\nx"), (1, " menu\n\nHome | Logis\n}\ny"), (2, "今日は晴れです。\n \nhome | login"), (3, "今日は晴れです。\n今日は雨です。\na line of twenty-one c")]
    df = spark.createDataFrame([*made, (4, "A line of twenty-one d")], "doc_id long, text string")
    assert {r.doc_id: r.gone for r in line_dedup.removed_lines(df).collect()} == {1: [0, 3], 2: [2], 3: [0], 4: [0]}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}[1] == "\nHome | Logis\ny"


def test_line_dedup_cases(odd):
    done = line_dedup.dedup_lines(odd)
    assert done.count() == odd.count() and done.columns[:-2] == odd.columns
    assert done.where("doc_id = 21").first().text == "" and line_dedup.dedup_lines(odd, drop_emptied=True).where("doc_id = 21").count() == 0
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# 4


def brute_substrings(made, size):
    first, words = {}, {d: space_words(t) for d, t in made}
    for d, own in words.items():
        for s in range(len(own) - size + 1):
            key = tuple(own[s : s + size])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, own in words.items():
        gone = {j for s in range(len(own) - size + 1) if first[tuple(own[s : s + size])] < d for j in range(s, s + size)}
        out[d] = (len(own), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(own) if i not in gone)).hexdigest())
    return out


def test_substring_dedup(docs, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(docs).collect()}
    assert got == brute_substrings(texts.items(), 50)


@pytest.mark.parametrize(("size", "gram"), [(50, 20), (12, 5), (6, 6)])
def test_substring_dedup_random(spark, size, gram):
    rng = random.Random(5)
    shared, made = [[f"p{rng.randrange(30)}" for _ in range(80)] for _ in range(6)], []
    for d in range(120):
        own = []
        for _ in range(rng.randrange(5)):
            a = rng.randrange(40)
            own += rng.choice(shared)[a : rng.randrange(a, 80)] + [f"u{rng.randrange(1000)}" for _ in range(rng.randrange(10))]
        made.append((d, " ".join(["buy"] * rng.randrange(200) if d % 20 == 3 else own)))
    df = spark.createDataFrame([*made, (500, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(df, window=size, gram=gram).collect()}
    assert got == brute_substrings([*made, (500, None)], size)


def test_substring_cases(odd):
    done = substring_dedup.digests(odd, with_text=True)
    assert done.count() == odd.count() and {r.doc_id: r.n_removed for r in done.collect()}[21] == 150
    assert substring_dedup.digests(odd.limit(0)).count() == 0


# 5


def brute_near(made, k, percent=80):
    sets = {}
    for d, t in made:
        own = lower(t).encode().split()
        n = min(k, len(own))
        sets[d] = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for d, s in sets.items():
        for e in s:
            holders.setdefault(e, []).append(d)
    for d in sorted(sets):
        for y, both in Counter(y for e in sets[d] for y in holders[e] if y < d).items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[y]) - both):
                a, b = sorted((find(d), find(y)))
                root[b] = a
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def near_rows(df, **params):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, **params).collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(docs, texts, k):
    assert near_rows(docs, shingle=k) == brute_near(texts.items(), k)


@pytest.mark.parametrize("percent", [80, 60])
def test_near_dedup_group_around_a_hub(spark, percent):
    rng = random.Random(3)
    base, made = [f"w{i}" for i in range(150)], []
    for d in range(300):
        own = list(base)
        for _ in range(rng.choice([0, 3, 6, 8, 9, 10, 12])):
            own[rng.randrange(150)] = f"x{rng.randrange(40)}"
        made.append((d, " ".join([f"q{d}"] * 3) if d % 97 == 0 else " ".join(own)))
    made += [(1000, None), (1001, ""), (1002, "one"), (1003, "One"), (1004, "a b")]
    assert near_rows(spark.createDataFrame(made, "doc_id long, text string"), shingle=2, percent=percent) == brute_near(made, 2, percent)


@pytest.mark.parametrize("members", [1, 7])
def test_near_dedup_deals_out_hot_pivots(spark, docs, texts, members):
    assert near_rows(docs, shingle=2, members=members) == brute_near(texts.items(), 2)


def test_near_dedup_of_shared_ids(spark):
    """All texts of an id count, and an id is one document."""
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    made = [(1, one), (2, one[:59] + ["x"]), (2, two), (3, [*two[:58], "y", two[59]]), (4, [f"c{i}" for i in range(60)]), (5, two), (6, []), (6, one)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in made], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, shingle=2).collect())
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False), (6, 6, True), (6, 1, False)])
    assert near_rows(spark.createDataFrame([(str(d), " ".join(w)) for d, w in made if d != 2], "doc_id string, text string"), shingle=2)["5"][1] == "3"


def test_near_dedup_shuffles_in_proportion(spark, monkeypatch):
    """Though the smaller input's keys are few enough to broadcast, and the larger one's aren't, shuffles grow as the input."""
    monkeypatch.setitem(common.met.__kwdefaults__, "most", 10_000)

    def written(n):
        rng = random.Random(n)
        own = [[f"w{rng.randrange(10**6)}" for _ in range(30)] for _ in range(n)]
        made = [(2 * i + k, " ".join([*words[: 30 - k], *["x"] * k])) for i, words in enumerate(own) for k in (0, 1)]
        df = spark.createDataFrame(made, "doc_id long, text string")
        before = shuffled()
        assert near_dedup.near_duplicates(df, shingle=2).where("kept").count() == n
        return shuffled() - before

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        time.sleep(1.5)  # the store's figures are brought up to date now and then
        spark.range(10).count()
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    few, many = written(150), written(750)
    assert 0 < many <= few * 5**1.15


def test_near_cases(odd):
    done = near_dedup.near_duplicates(odd)
    assert done.count() == odd.count()
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 21").count() == 0 and kept.where("doc_id IS NULL").count() == 1
    assert near_dedup.keep_one(odd.limit(0)).count() == 0


def test_workers_hold_states_of_one_operator(monkeypatch):
    for name in ("_fleetlens_state", "_fleetlens_operator"):
        monkeypatch.setattr(sys, name, None, raising=False)
        delattr(sys, name)

    def task(operator, key):
        def run(batches):
            yield common.worker_state(key, lambda: [key])

        run.__module__ = operator
        return list(common.freed(run)(iter([])))[0]

    coder, other = task("byte_bpe", "coder"), task("byte_bpe", "more")
    assert task("byte_bpe", "coder") is coder and task("byte_bpe", "more") is other
    task("near_dedup", "bytes")
    assert list(sys.__dict__["_fleetlens_state"]) == ["bytes"]
    assert task("byte_bpe", "coder") == coder


def test_word_hashes():
    """One hash a word, wherever it stands and however long it is; other words have others."""
    rng, seen, other = random.Random(8), {}, {}
    made = [b" " * 9, b"a", b"x" * (1 << 19), b"y" * ((1 << 19) + 1) + b" b", b"\t".join([b"z" * 300_000] * 5), " é 日本\x1c ".encode()]
    made += [b" ".join(bytes(rng.choice(b"ab\n\xc3") for _ in range(rng.randrange(5))) for _ in range(200_000))]
    for text in [*made, b" ".join(made), b"q" * 7 + b" " + b"x" * (1 << 19) + b" a"]:
        got, own = common.word_hashes(text).tolist(), text.split()
        assert len(got) == len(own)
        for w, h in zip(own, got):
            assert seen.setdefault(w, h) == h and other.setdefault(h, w) == w
    assert not len(common.word_hashes(None)) and not len(common.word_hashes(b""))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 62, 500).astype(np.uint64))
    b = np.concatenate([a[:400], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    s = near_dedup.sketches([a, b, a[:1], a[:0]], 400)
    assert (s[:3] != np.iinfo(np.uint64).max).all() and (s[3] == np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50), (60, 60)]
    found = {r.doc_id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 40}
    assert found == {r.doc_id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long"), most=0).collect()}


# 6


@pytest.mark.parametrize(("frequent", "buckets"), [(katz_lm.FREQUENT, None), (300, 64), (1, 500)])
def test_katz(spark, docs, texts, tmp_path, frequent, buckets):
    """Every training token is a word, however few are broadcast and however many buckets there are."""
    trained = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    tokens = {d: [*lower(t).encode().split(), b"\n"] for d, t in texts.items()}
    c = Counter(w for d, own in tokens.items() if trained(d) for w in own)
    total, pairs = sum(c.values()), Counter()
    for d, own in tokens.items():
        if trained(d):
            pairs.update(zip(["^", *own[:-1]], own))
    discount = katz_lm.discounts([sum(v == r for v in pairs.values()) for r in range(1, 7)])
    count, s, seen = Counter(), Counter(), Counter()
    for (h, w), v in pairs.items():
        count[h] += v
        s[h] += discount[min(v, 6)] * v
        seen[h] += c[w] / (total + 1)
    below = {h: count[h] + (s[h] >= count[h] - 1e-9) for h in count}
    alpha = {h: (1 - s[h] / below[h]) / (1 - seen[h]) for h in count}
    p = lambda h, w: discount[min(pairs[h, w], 6)] * pairs[h, w] / below[h] if pairs[h, w] else alpha.get(h, 1.0) * max(c[w], 1) / (total + 1)
    for h in [*count][:20]:  # a slot is left for tokens never seen
        assert sum(p(h, w) for w in c) + alpha[h] / (total + 1) == pytest.approx(1)
    marked = docs.select("doc_id", "text", (language_id.remainder(7) == 2).alias("held_out"))
    model = katz_lm.train(marked.where("NOT held_out"), str(tmp_path / "m"), frequent=frequent, buckets=buckets)
    for r in katz_lm.score(marked, model, "held_out").collect():
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), total)
        assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["^", *own[:-1]], own)))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in own))


def test_katz_cases(odd, tmp_path):
    model = katz_lm.train(odd, str(tmp_path / "a"))
    assert katz_lm.score(odd, model).count() == odd.count() and katz_lm.score(odd.limit(0), model).count() == 0
    untrained = katz_lm.train(odd.limit(0), str(tmp_path / "b"))
    assert katz_lm.score(odd, untrained).where("n_known = 0 AND train_tokens = 0").count() == odd.count()


def test_good_turing():
    d = katz_lm.discounts([100, 40, 20, 12, 8, 5])
    assert all(0 < x < 1 for x in d[1:6]) and d[6] == 1
    assert list(katz_lm.discounts([0] * 6))[1:6] == [(r - 0.5) / r for r in range(1, 6)]


def test_sparse_sums():
    rng = np.random.default_rng(1)
    docs, values = rng.integers(0, 60_000, 4000).astype("<u2"), -rng.random(4000) * 9
    got = np.ones(60_000)
    katz_lm.add_sums(katz_lm.sparse_sums(docs, values), got)
    assert np.allclose(got - 1, np.bincount(docs, values, 60_000), rtol=1e-7)
    katz_lm.add_sums(katz_lm.sparse_sums(docs[:0], values[:0]), got)


def test_packing():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * 2 + 1)
    assert (katz_lm.expand_sorted(katz_lm.squeeze_sorted(keys)) == keys).all()
    assert (katz_lm.expand(katz_lm.squeeze(keys)) == keys).all()


# 8


def test_language_id(spark, small, docs):
    found = queries.QUERIES["op8_language_id"](spark, small).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(held) and (held.lang_pred == held.lang).mean() > 0.9 and found.score.between(0, 1).all()


def test_language_id_against_a_plain_form(spark, small, docs):
    """Dictionaries from rows picked in plain Python, and sizes of whole compressions, choose the same languages with the same scores."""
    import zstandard

    table = [r for r in docs.select("doc_id", "lang", "text").collect()]
    learned, counts = {}, Counter()
    spark_hash = lambda x: int(np.uint64(xxhash.xxh64_intdigest(str(x).encode(), seed=42)).view(np.int64))
    for lang in sorted({r.lang for r in table if r.lang}):
        own = [r for r in table if r.lang == lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
        counts[lang] = len(own)
        own.sort(key=lambda r: (not 500 <= len(r.text.encode()) <= 8000, spark_hash(r.doc_id), r.doc_id))
        words = []
        for _, text in sorted((spark_hash(r.doc_id), r.text) for r in own[:64]):
            words += language_id.normal(text).split()
            if sum(map(len, words)) + len(words) >= 2 * 65_536:
                break
        words = [w for _, w in sorted(((xxhash.xxh3_64_intdigest(i.to_bytes(8, "little")), w) for i, w in enumerate(words)), key=lambda x: x[0])]
        learned[lang] = b" ".join(words)[:65_536]

    def size(data, dictionary):
        level, blocks = (12, [bytes(120) + b" " + data + b" "]) if len(data) < 256 else (5, [data[i : i + 4096] for i in range(0, len(data), 4096)])
        coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        return sum(len(coder.compress(b)) for b in blocks)

    found = {r.doc_id: r for r in queries.QUERIES["op8_language_id"](spark, small).collect()}
    for r in table:
        got = found[r.doc_id]
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got.lang_pred, got.score) == ("und", 0)
            continue
        sizes = sorted((size(language_id.normal(r.text), d), -counts[lang], lang) for lang, d in learned.items())
        assert (got.lang_pred, got.held_out) == (sizes[0][2], zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and got.score == pytest.approx((sizes[1][0] - sizes[0][0]) / sizes[1][0])


def test_language_cases(docs, odd):
    learned = language_id.dictionaries(docs)
    r = {r.doc_id: r for r in language_id.predict(odd, learned).collect()}
    assert r[0].lang_pred == r[4].lang_pred == r[9].lang_pred == "und" and r[0].rejected and r[20].lang_pred != "und"
    assert language_id.predict(odd, language_id.dictionaries(odd.limit(0))).where("lang_pred = 'und'").count() == odd.count()
    assert language_id.keep_known(odd).columns == odd.columns and language_id.keep_known(odd.limit(0)).count() == 0


# The pipeline


def test_pipeline(spark, small, docs, texts):
    con = connection(small)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    first = stage["language_id"](spark, docs, small).persist()
    assert first.columns == docs.columns and first.count() >= 0.97 * docs.count()
    second = stage["line_dedup"](spark, first, small).persist()
    con.register("documents", first.select("doc_id", "text").toPandas())
    expected = {r[0]: r[3] for r in con.execute("SELECT doc_id, n_lines, n_removed, kept_sha256 FROM (" + line_dedup.ORACLE + ")").fetchall()}
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == expected[r.doc_id] for r in second.collect())
    third = stage["near_dedup"](spark, second, small).persist()
    labels = brute_near([(r.doc_id, r.text) for r in second.collect()], 5)
    assert {r.doc_id for r in third.collect()} == {d for d, (_, _, kept) in labels.items() if kept}
    fourth = stage["decontaminate"](spark, third, small).persist()
    hits = brute_windows({r.doc_id: r.text for r in third.collect()}, [(r.item_id, r.text) for r in common.table(spark, small, "benchmark").collect()], 10)
    assert {r.doc_id for r in fourth.collect()} == {d for d, h in hits.items() if not h[4]} and fourth.columns == docs.columns
    last = {r.doc_id: r.decoded_sha256 for r in stage["byte_bpe"](spark, fourth, small).collect()}
    assert last == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in fourth.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, small).collect()} == last


def test_pipeline_cases(spark, small, odd):
    table = odd
    for _, f in corpus_pipeline.STAGES:
        table = f(spark, table, small)
    assert table.count() > 0
    table = odd.limit(0)
    for _, f in corpus_pipeline.STAGES:
        table = f(spark, table, small)
    assert table.count() == 0
