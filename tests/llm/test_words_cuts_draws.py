"""Operators 11 to 13 against the tokenizer library and plain versions, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatiotrack.llm import fill_in_middle, packing, resampling, textsplit, word_bpe
from spatiotrack.llm import queries as q

SCHEMA = "doc_id long, text string, lang string, ids string, n string, rank string"
LONG = "Lorem ipsum, dolor sit AMET! " * 20000
WORD = "antidisestablishmentarianism" * 400


def some(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(["the ", "of", " And", "é", "日本", "1", "\n", "  ", "'s", "<", "P>", "x<S", "Ünï ", ", ", "\t", "İ", "Σας ", "é", "\x1c", "\x00", "😀", " ", "can't "]) for _ in range(n))


ROWS = [(i, some(5 + i * 3, i), "en", "a", "b", "c") for i in range(60)]
ROWS += [(100, None, None, None, None, None), (101, "", "en", "", "", ""), (None, "no id here but some words", "en", "", "", ""), (102, LONG, "en", "", "", ""), (103, WORD, "en", "", "", ""), (104, "a <P> b", "en", "", "", ""), (105, " \n\t ", "en", "", "", "")]
ROWS += [(106, "x<|endoftext|>Y <|startoftext|><|endoftext|", "en", "", "", "")] + [(0, ROWS[0][1], "en", "a", "b", "c")] * 3 + [(200 + i, some(30, 7) if i % 2 else "copy " * 40, "en", "", "", "") for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.rank_path(word_bpe.VOCABULARY))


# 11
def test_words_equal_the_library(docs, none, library):
    got = word_bpe.encode_words(docs, decode_to="decoded").collect()
    assert len(got) == len(ROWS) and Counter(r.text for r in got) == Counter(r[1] for r in ROWS) and got[0].n is not None
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == want, r.doc_id
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    again = word_bpe.decode_words(word_bpe.encode_words(docs)).select("doc_id", "decoded").collect()
    assert Counter((r.doc_id, r.decoded) for r in again) == Counter((r.doc_id, r.decoded) for r in got)
    assert word_bpe.encode_words(none, decode_to="decoded").count() == 0


def test_every_character_is_cut_like_the_library(library):
    encoder = word_bpe.WordEncoder(packing.rank_path(word_bpe.VOCABULARY))
    for a in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}b{chr(c)} " for c in range(a, a + 64) if not 0xD800 <= c < 0xE000)
        assert list(np.frombuffer(encoder.encode(text), "<u4")) == library.encode(text, add_special_tokens=False).ids, hex(a)


def test_rank_arrays_and_heap_agree():
    merger = word_bpe._encoder(packing.rank_path(word_bpe.VOCABULARY)).merger
    rng = random.Random(3)
    for k in range(400):
        word = "".join(rng.choice("aeinorstlth" if k % 2 else "ab") for _ in range(rng.randint(1, 60)))
        assert merger.scan(merger.parts(word)) == merger.queue(merger.parts(word))


def test_caches_may_be_emptied(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(word_bpe, "BLOCK", 50)
    encoder = word_bpe.WordEncoder(packing.rank_path(word_bpe.VOCABULARY))
    for text in ("one two three four five six seven " * 9, WORD):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want and encoder.decode(encoder.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_blocks_are_cut_at_spaces():
    for text in ("", "abc", "ab cd  efghijkl m", " a b ", "abcdefghij"):
        for limit in (1, 2, 3, 100):
            parts = list(textsplit.blocks(text, " ", limit))
            assert " ".join(parts) == text and list(textsplit.blocks(text.encode(), b" ", limit)) == [p.encode() for p in parts]


# 12
def plain_middle(doc_id, text):
    tok = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest, n = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(tok)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tok[:a]), "".join(tok[a:b]), "".join(tok[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_middles_equal_plain_ones(docs, none):
    made = fill_in_middle.fill_in_middle(docs.withColumnsRenamed({"ids": "output", "rank": "form"}))
    got = made.withColumn("restored", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(ROWS) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text or ""), r.doc_id
        assert r.restored == (r.text or "")
    assert fill_in_middle.fill_in_middle(none).count() == 0


def test_units_start_where_a_plain_cut_does():
    rng = random.Random(5)
    for k in range(300):
        text = "".join(rng.choice(["ab", "Z", " ", "é", "日", "?", "1", "\n", "<P>", "[", "`", "{", "@"]) for _ in range(rng.randint(0, 12)))
        starts = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        units = fill_in_middle.Units(text)
        assert units.n == len(starts) and units.sentinel == ("<P>" in text) and [units.start(i) for i in range(units.n + 1)] == [*starts, len(text)], (k, text)


def test_parts_that_look_like_half_a_sentinel_are_restored(spark):
    rows = [(i, t) for i, t in enumerate(["a<<S b>P>", "<P<S<M", "P>S>M>", "<S <M> x"[:3], "<" * 30, "<P S>M>" * 5] * 30)]
    made = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r.text == r.restored for r in made.withColumn("restored", fill_in_middle.restore(F.col("output"), F.col("form"))).collect())


# 13
def plain_draw(rows, target, percent=25, least=20, buckets=10000, ngram=2, seed=7):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for i in range(len(w)) for k in range(1, ngram + 1) if i + k <= len(w)]

    own, other = [found(t) for _, t in rows], [found(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in other for b in f)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for (key, _), (n, f) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -math.inf if r[0] is None else r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


TARGET = ["The target says THE of and can't 1 x", None, "", "lorem ipsum dolor " * 9]


@pytest.mark.parametrize("ngram,buckets", [(2, 10000), (1, 50), (3, 100000)])
def test_draws_equal_plain_ones(spark, docs, ngram, buckets):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = resampling.importance_resample(docs.drop("rank"), target, ngram=ngram, buckets=buckets)
    got = Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect())
    assert got == plain_draw([r[:2] for r in ROWS], TARGET, ngram=ngram, buckets=buckets)
    assert any(r[5] == 1 for r in got)


def test_draws_do_not_depend_on_the_layout(spark, docs, none):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    results = []
    for n in (1, 7):
        out = resampling.importance_resample(docs.repartition(n), target, carry=["doc_id", "text", "lang"])
        assert out.columns[:3] == ["doc_id", "text", "lang"]
        results.append(Counter((r.doc_id, r.score, r["rank"]) for r in out.collect()))
    assert results[0] == results[1]
    assert resampling.importance_resample(none, target).count() == 0
    assert resampling.importance_resample(docs, none).count() == len(ROWS)
    with pytest.raises(ValueError):
        resampling.importance_resample(docs, target, carry=["rank"])


def test_ties_of_one_key_are_ranked_apart(spark):
    rows = [(5, "word " * 30)] * 400 + [(None, "other " * 25)] * 100
    out = resampling.importance_resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame([("word",)], "text string")).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 126)) and len({r.score for r in out if r["rank"]}) == 1


def test_the_ring_takes_long_texts_in_blocks(monkeypatch):
    want = resampling.text_buckets(LONG.encode())
    monkeypatch.setattr(resampling, "BLOCK", 37)
    got = resampling.text_buckets(LONG.encode())
    assert want[0] == got[0] == 100000 and (want[1] == got[1]).all()


# queries
def test_queries_have_the_contracts_columns(spark, sf):
    assert q.op11_word_bpe(spark, sf).dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert q.op12_fill_in_middle(spark, sf).dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    assert q.op13_importance_resampling(spark, sf).dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]


def test_query_of_words_equals_the_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in q.op11_word_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_importance_resampling"])
def test_queries_equal_their_sql(spark, sf, duck, name):
    rows, want = q.QUERIES[name](spark, sf), duck.sql(q.ORACLES[name])
    assert rows.columns == want.columns and sorted(map(tuple, rows.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_query_of_draws_equals_plain_ones(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = Counter((k, f, w, s, r) for k, _, f, w, s, r in plain_draw(rows, target).elements())
    assert Counter(map(tuple, q.op13_importance_resampling(spark, sf).collect())) == want
