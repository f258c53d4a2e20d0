"""The ten operators on small tables with nulls, empty and long texts, repeats, no rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spatiotrack.llm import bpe, chat_format, common, html_extract, license_scan, media_gif, near_dedup, packing, quality_classifier, quality_rules, sharding
from spatiotrack.llm import queries as q

LONG = "lorem ipsum dolor sit amet " * 20000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and to in is by with for that on are as was".split()) + rng.choice(["", "ing", "ed", "er"]) for _ in range(n))


BASE = [(i, words(40 + i % 30, i), "en", "s", 1) for i in range(30)]
ODD = [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "no id here at all but some words", "en", "s", 0), (102, LONG, "en", "s", 1), (103, BASE[0][1], "en", "s", 1), (104, "a  b\n\n\tc é 日本", "fr", "s", 1), (0, BASE[0][1], "en", "s", 1), (0, BASE[0][1], "en", "s", 1), (105, "x", "xx", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(BASE + ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


# 1
def test_shards_are_gapless_and_grow_by_one(spark, docs, none):
    out = sharding.shard_documents(clashing(docs, "shard", "slot", "bucket"), bucket_bytes=4096).collect()
    assert len(out) == len(BASE) + len(ODD)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.bucket == "clash"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter(r.text for r in out) == Counter(r[1] for r in BASE + ODD)
    again = {(r.doc_id, r.text): r.shard for r in sharding.shard_documents(docs.repartition(1)).collect()}
    assert again == {(r.doc_id, r.text): r.shard for r in out}
    assert sharding.shard_documents(none).count() == 0


def test_slots_depend_on_content_and_seed_alone(spark, docs):
    def slots(df, **how):
        return Counter((r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard_documents(df, bucket_bytes=4096, **how).collect())

    want = slots(docs)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert slots(docs.repartition(5)) == want and slots(docs.coalesce(1)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert slots(docs, seed=18) != want


def test_many_equal_records_are_scattered(spark):
    rows = [(None, None, "en", "s", 0)] * 2500 + [(i, words(20, i), "en", "s", 0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sharding.shard_documents(df.repartition(6), shards=2, bucket_bytes=256)
    got = out.collect()
    assert len(got) == len(rows) and Counter(r.text for r in got)[None] == 2500
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard_documents(df.coalesce(1), shards=2, bucket_bytes=256).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.shard, r.slot) for r in got)


def test_shards_are_written(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard_documents(docs, 4), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_a_long_text_packs_in_linear_time(spark):
    import time

    took = []
    for n in (1, 8):
        df = spark.createDataFrame([(1, "word and other things " * 50_000 * n)], "doc_id long, text string")
        start = time.perf_counter()
        pieces = packing.pack_documents(df).select("start", "length", "doc_tokens", F.octet_length("ids").alias("bytes")).collect()
        took.append(time.perf_counter() - start)
        assert sum(r.length for r in pieces) == pieces[0].doc_tokens and all(r.bytes == 4 * r.length for r in pieces)
    assert took[1] < 20 * took[0]


def test_one_long_labelled_text_leaves_the_rest_to_learn_from(spark):
    rows = [(i, ("good solid prose " if i % 2 else "buy now !!! ") * 6) for i in range(80)] + [(1000 + i, "x " * 3000) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = quality_classifier.fit_classifier(docs, labels, sample_bytes=16_000)
    assert len({round(r.score, 3) for r in quality_classifier.score_documents(docs, net).collect()}) > 1


# 2
PAGE = "<html><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>T {n}</h1><p>First &amp;  {n}\nline<p>Second {n}<br><div class=comments>nice!</div></article><aside>more</aside><footer>&copy; us</footer></body>"
BARE = "<body><div class=top><a href=/>Home</a></div><div><p>Welcome to the site</p></div><div class=text><p>Text number {n} with many words of its own, {n} times</p><p>And more of {n}</p></div></body>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_articles_without_their_surroundings(spark):
    rows = [(i, f"http://a.org/{i}", PAGE.replace("{n}", str(i))) for i in range(6)] + [(50, None, None), (51, "odd", ""), (52, "http://b.org/1", PAGE.replace("{n}", "9"))]
    got = {r.page_id: r.text for r in html_extract.extract_text(clashing(pages(spark, rows), "text")).collect()}
    assert got[3] == "T 3\nFirst & 3 line\nSecond 3" and got[52] == "T 9\nFirst & 9 line\nSecond 9" and got[50] == got[51] == ""
    assert html_extract.extract_text(pages(spark, [])).count() == 0


def test_template_text_is_dropped_where_no_article_is_marked(spark):
    rows = [(i, f"http://a.org/{i}", BARE.replace("{n}", str(i))) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert got[5] == "Text number 5 with many words of its own, 5 times\nAnd more of 5"


def test_template_text_is_dropped_inside_articles_whatever_its_length(spark):
    line = " ".join(f"boilerplate{i}" for i in range(90))
    page = "<body><nav><a href=/>Home</a></nav><article><p>Own words {n} of page {n}</p><p class=x>" + line + "</p><p>Share this</p><h2>Summary</h2><p>End {n}</p></article></body>"
    rows = [(i, f"http://a.org/{i}", page.replace("{n}", str(i)).replace("Summary", "Summary" if i % 4 else f"Other {i}")) for i in range(8)]
    # Copies of one page do not make its text a template.
    rows += [(100 + i, f"http://c.org/{i}", page.replace("{n}", "7")) for i in range(9)]
    got = {r.page_id: r.text for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert got[3] == "Own words 3 of page 3\nSummary\nEnd 3" and got[4] == "Own words 4 of page 4\nOther 4\nEnd 4"
    assert got[100] == f"Own words 7 of page 7\n{line}\nShare this\nSummary\nEnd 7"


def test_names_that_only_hold_a_listed_word_stay(spark):
    six = "<article><header><h1>Headline {n}</h1></header><p>Intro {n}</p><div class='comment-on-law'><p>Real paragraph {n}</p></div><section id='share-prices'><p>Prices rose {n}.</p></section><p class='notice-period'>Period {n}</p><div class='related-work'>Work {n}</div><div class='reader_comments'>me too {n}</div><footer>tags {n}</footer></article>"
    rows = [(i, f"http://a.org/{i}", "<header>Site</header>" + six.replace("{n}", str(i))) for i in range(6)] + [(50, "http://b.org", six.replace("{n}", "9"))]
    got = {r.page_id: r.text for r in html_extract.extract_text(pages(spark, rows)).collect()}
    for k, n in ((3, 3), (50, 9)):
        assert got[k] == f"Headline {n}\nIntro {n}\nReal paragraph {n}\nPrices rose {n}.\nPeriod {n}\nWork {n}"


def test_hidden_is_an_attribute_not_a_word():
    assert html_extract.extract("<div title='hidden gem'>seen</div><div hidden>not</div><p style='display: none'>nor this</p>", set(), set()) == "seen"


def test_templates_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        parts = ["<nav><ul><li>Home</li><li>News</li></ul></nav>", f"<div class=main><h1>Title {i}</h1><p>{words(30, i)}</p></div>", "<div class=foot><p>Imprint</p></div>"]
        if rng.random() < 0.3:
            parts.insert(1, "<section><p>Now and then</p></section>")
        if rng.random() < 0.5:
            parts[-2], parts[-1] = parts[-1], parts[-2]
        rows.append((i, f"http://h{i % 3}.org/{i}", "<body>" + "".join(parts) + "</body>"))
    got = {(r.host, r.token): r["rank"] for r in html_extract.template_tokens(pages(spark, rows)).collect()}
    want = {}
    for k in range(3):
        per_page = [{t[0]: t for t in html_extract.page_tokens(h)} for _, u, h in rows if u.startswith(f"http://h{k}")]
        vectors = {}
        for t in set().union(*per_page):
            vector = tuple(p[t][6] if t in p else 0 for p in per_page)
            sample = next(p[t] for p in per_page if t in p)
            share = html_extract.ARTICLE_SHARE if sample[2] and sample[3] else html_extract.SHARE
            if sum(map(bool, vector)) >= max(html_extract.LEAST_PAGES, share * len(per_page)):
                vectors.setdefault(vector, []).append(t)
        for members in vectors.values():
            ranks = {t: set() for t in members}
            for p in per_page:
                for r, t in enumerate(sorted((t for t in members if t in p), key=lambda t: p[t][4])):
                    ranks[t].add(r + 1)
            ordered = {(f"h{k}.org", t): min(r) for t, r in ranks.items() if len(r) == 1}
            if len(ordered) > 1:
                want.update(ordered)
    assert got == want and len(want) > 10


def test_deep_pages_take_linear_time():
    deep = "<div>" * 100_000 + "<p>text" + "</b>" * 100_000
    assert html_extract.extract(deep, {1}, {2}) == "text" and len(html_extract.page_tokens(deep)) == 100_002


def test_broken_markup_never_fails():
    for p in ("<", "<p", "a < b", "<!-- open", "<script>x", "</p></div>", "<p class='x", "<div><p>a</div>b", "\0<b>"):
        assert isinstance(html_extract.extract(p, set(), set()), str)
    assert html_extract.extract("<p>a &lt; b&nbsp;c</p>", set(), set()) == "a < b c"


# 3
def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(runs)
    covered = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts_equal_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é\n\t #|日") for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["", None, "x y\nx y\n x y", "a b " * 50, LONG]
    f = quality_rules.text_features(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(f[k][i]) for k in quality_rules.FEATURES) == base_counts(t)


def test_model_sums_to_one_and_backs_off():
    rng = np.random.default_rng(0)
    raw = rng.choice(np.frombuffer(b"abcd ", np.uint8), 3000)
    keys, _ = quality_rules.grams(raw, np.array([0, len(raw)]), 3)
    k, n = np.unique(keys, return_counts=True)
    model = quality_rules.KneserNey(k, n, 3)
    context = int(k[0]) >> 8
    every = np.array([context << 8 | b for b in range(256)], np.uint64)
    assert np.exp(model.log_probability(every).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    unseen = np.array([0x7A7A00 | b for b in range(256)], np.uint64)
    assert np.exp(model.log_probability(unseen).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_rules_give_a_verdict_for_every_row(spark, docs, none):
    out = quality_rules.quality_rules(clashing(docs, "n_words", "kept")).collect()
    assert len(out) == docs.count()
    for r in out:
        n = base_counts(r.text)
        assert (r.n_words, r.n_repeat_words) == (n[0], n[4])
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(none).count() == 0


def test_bands_are_exact_and_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(2.0, 0.3, 20_000)
    rows = [("en", i.to_bytes(4, "big"), float(v), 99) for i, v in enumerate(values)] + [("fr", b"x", 1.5, 99), ("fr", b"x", 1.5, 99), ("de", b"y", None, 99)]
    df = spark.createDataFrame(rows, "lang string, same binary, nats double, n_words long")
    found = [sorted(map(tuple, quality_rules.bands(df.repartition(n), "same").collect())) for n in (1, 8, 64)]
    assert found[0] == found[1] == found[2] and [r[0] for r in found[0]] == ["en", "fr"]
    order = np.sort(values)
    q1, q2, q3 = (order[int(np.ceil(p * len(order))) - 1] for p in (0.25, 0.5, 0.75))
    assert abs(found[0][0][1] - q2) <= quality_rules.GRAIN and abs(found[0][0][2] - (q3 - q1) / 1.349) <= 2 * quality_rules.GRAIN


def test_odd_texts_leave_the_bands(spark):
    rows = [(i, words(200, i), "en", "s", 1) for i in range(200)] + [(900, "".join(random.Random(5).choice("qxzjkvw#$%7 ") for _ in range(1500)), "en", "s", 1)]
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not out[900] and sum(out.values()) >= 195


def test_nats_equal_one_model_of_all_grams_in_any_layout(spark):
    rows = [(i, words(30 + i, i % 20), ["en", "de", None][i % 3], "s", 1) for i in range(60)] + [(90, "only one short text", "xx", "s", 1)]
    rows += [(100 + i, rows[0][1], "en", "s", 1) for i in range(20)] + [(200, "abc", "en", "s", 1), (201, None, None, "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for lang in {r[2] for r in rows}:
        texts = sorted({r[1] or "" for r in rows if r[2] == lang})
        made = [quality_rules.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), quality_rules.ORDER)[0] for t in texts]
        model = quality_rules.KneserNey(*np.unique(np.concatenate(made), return_counts=True), quality_rules.ORDER)
        want.update({(lang, t): -model.log_probability(k).astype(float).mean() if len(k) else None for t, k in zip(texts, made, strict=True)})
    for layout in (1, 5):
        got = quality_rules.quality_rules(df.repartition(layout)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.nats == (None if want[r.lang, r.text or ""] is None else pytest.approx(want[r.lang, r.text or ""], abs=1e-5))


# 4
def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts):
    bags = [bag(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both, total = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (total and both / total >= 0.8) or (texts[i] or "") == (texts[j] or ""):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def near_copies():
    rng, texts = random.Random(8), []
    for k in range(25):
        base = words(120, 1000 + k).split()
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    return texts + [None, "", "two words", "two words", "one", texts[0], " ".join(texts[0].split() * 2)]


def test_classes_equal_brute_force(spark):
    texts = near_copies()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(clashing(df, "node", "bands")).collect()}
    want = classes(texts)
    least = {}
    for i, c in enumerate(want):
        least.setdefault(c, i)
    assert got == {i: least[c] for i, c in enumerate(want)}


def test_one_of_each_class_stays(spark, docs, none):
    out = near_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len([r for r in rows if r.text == BASE[0][1]]) == 1 and len([r for r in rows if not r.text]) == 1
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.deduplicate(none).count() == 0


def test_unlike_texts_of_one_id_stay(spark):
    texts = [words(60, 5000 + i) for i in range(5)]
    rows = [(None, texts[0], "en", "s", 0), (None, texts[1], "en", "s", 0), (7, texts[2], "en", "s", 0), (7, texts[3], "en", "s", 0), (8, texts[3], "en", "s", 0), (9, texts[4], "en", "s", 0), (9, texts[4], "en", "s", 0)]
    out = near_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter({(None, texts[0]): 1, (None, texts[1]): 1, (7, texts[2]): 1, (7, texts[3]): 1, (9, texts[4]): 1})


def test_large_buckets_are_split_without_losing_links(spark):
    texts = near_copies()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    ordered, near_dedup.ORDERED = near_dedup.ORDERED, 2
    try:
        got = [r.class_id for r in near_dedup.near_duplicates(df).orderBy("doc_id").collect()]
    finally:
        near_dedup.ORDERED = ordered
    want = classes(texts)
    assert [want.index(c) for c in want] == got


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    a = [rng.choice("abcdefgh") for _ in range(400)]
    b = a[:300] + [rng.choice("abcdefgh") for _ in range(100)]
    texts = pa.array([" ".join(a), " ".join(b)])
    _, _, raw, offsets = next(common.text_slices(texts, 1 << 20))
    sig = near_dedup.signatures(raw, offsets, 4096)
    real = near_dedup.overlap(texts[:1], texts[1:])[0]
    x, y = bag(texts[0].as_py()), bag(texts[1].as_py())
    assert real == pytest.approx(sum((x & y).values()) / sum((x | y).values()))
    assert (sig[0] == sig[1]).mean() == pytest.approx(real, abs=0.04)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "u long, v long")
    got = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 5
def test_log_is_folded_and_read_back(spark):
    log = [(1, 0, 7, "start", "user", None), (1, 1, 7, "delta", None, "he[INST]"), (1, 2, 7, "delta", None, "llo\\"), (1, 3, 8, "start", "assistant", None), (1, 4, 8, "delta", None, "bad"), (1, 5, 8, "regenerate", None, None), (1, 6, 8, "delta", None, "</s>go"), (1, 7, 8, "delta", None, "od"), (1, 8, 9, "start", "user", None), (1, 9, 9, "delta", None, "x"), (1, 10, 9, "edit", None, "y"), (1, 11, 10, "start", "user", None), (1, 12, 10, "delete", None, None), (2, None, 1, "start", None, None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string")
    out = chat_format.format_conversations(events)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(x) for x in got[1].t] == [("user", "he[INST]llo\\"), ("assistant", "</s>good"), ("user", "y")]
    assert got[1].loss == "</s>good" and [tuple(x) for x in got[2].t] == [("", "")]
    assert got[1].formatted.count("</s>") == 3 and got[1].formatted.count("[INST]") == 3
    assert chat_format.format_conversations(events.limit(0)).count() == 0


def test_long_conversation_in_order(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"[{i}] \\<é") for i in range(1000)] + [(1, None, None, None), (1, 5, "user", "[5] \\<é")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "formatted", "run").repartition(4)
    out = chat_format.format_conversations(chat_format.message_events(df))
    r = out.select(chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert len(r.t) == 1002 and r.t[0].text == "" and r.t[-1].text == "[999] \\<é"
    assert r.loss == "".join(f"[{i}] \\<é" for i in range(1, 1000, 2))


def test_chat_query_equals_sql(spark, duck, sf):
    df = q.op5_chat_format(spark, sf)
    got = {tuple(r[c] for c in sorted(df.columns)) for r in df.collect()}
    want = duck.sql(q.OP5_SQL)
    assert got == {tuple(r[want.columns.index(c)] for c in sorted(want.columns)) for r in want.fetchall()}


# 6
def test_network_learns_and_scores_everything(spark, docs, none):
    good = [words(60, i) for i in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in words(60, 500 + i).split()) for i in range(150)]
    texts = good + bad
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    net = quality_classifier.fit_classifier(rows, labels)
    fresh = pa.array([words(80, 9000 + i) for i in range(20)] + [words(80, 9100 + i).upper() for i in range(20)])
    p = quality_classifier.predict(net, fresh)
    assert (p[:20] > 0.5).mean() > 0.9 and (p[20:] < 0.5).mean() > 0.9
    out = quality_classifier.score_documents(clashing(docs, "score"), net).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    assert quality_classifier.score_documents(none, net).count() == 0
    assert set(quality_classifier.predict(quality_classifier.fit_classifier(none, labels), fresh)) == {0.5}


def test_pooling_equals_a_plain_convolution():
    """Responses, chunk maxima, mean and maximum, one place at a time."""
    rng = np.random.default_rng(5)
    net = quality_classifier.Network(rng.normal(0, 1, (quality_classifier.WIDTH, 256, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32), rng.normal(0, 1, 6), 0.3)
    half = quality_classifier.HALF
    for n in (0, 1, 4, half - 4, half, 3 * half + 17, 40 * half):
        raw = bytes(rng.integers(97, 123, n).tolist())
        halves = max(-(-(n + quality_classifier.WIDTH - 1) // half), 1)
        tops = []
        for h in range(halves):
            best = np.zeros(3)
            for at in range(h * half, min((h + 1) * half, n)):
                near = [raw[at + k] if at + k < n else 0 for k in range(quality_classifier.WIDTH)]
                best = np.maximum(best, sum(net.tables[k][b].astype(float) for k, b in enumerate(near)) + net.bias)
            tops.append(best)
        chunks = [np.maximum(a, b) for a, b in zip(tops[:-1], tops[1:], strict=True)] or tops
        want = 1 / (1 + np.exp(-(np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.weights + net.offset)))
        assert quality_classifier.predict(net, pa.array([raw.decode()]))[0] == pytest.approx(want, abs=1e-5)


def test_sample_is_bounded_by_bytes(spark):
    rows = spark.createDataFrame([(i, "good words " * 50 if i % 2 else "BAD!! " * 90, "en", "s", 0) for i in range(200)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    seen = []
    whole = quality_classifier.train
    quality_classifier.train = lambda texts, labels, seed: seen.append((sum(map(len, texts)), {len(t) for t in texts})) or whole(texts, labels, seed)
    try:
        quality_classifier.fit_classifier(rows, labels, sample_bytes=20_000)
    finally:
        quality_classifier.train = whole
    assert 15_000 < seen[0][0] <= 20_000 and seen[0][1] == {540, 550}


def test_scores_read_the_whole_text():
    net = quality_classifier.train([b"aaaa " * 30, b"zzzz " * 30] * 40, np.array([1.0, 0.0] * 40))
    a, b = "aaaa " * 3000, "aaaa " * 3000 + "zzzz " * 300
    p = quality_classifier.predict(net, pa.array([a, b]))
    assert p[1] < p[0]


# 7
def test_gif_round_trip_and_frames():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 5000, 65536, 70000, 140000):
        for letters in (1, 2, 256):
            data = bytes(rng.randrange(letters) for _ in range(n))
            image = media_gif.read_gif(media_gif.to_gif(data))
            assert image["payload"] == data + b"\0" * (-n % 64 or (0 if n else 64))
            assert sum(f["histogram"].sum() for f in image["frames"]) >= n


def test_gif_disposal_transparency_and_interlace():
    lzw = lambda b: bytes([8]) + media_gif._blocks(media_gif.lzw_encode(b))
    palette = bytes(x for i in range(256) for x in (i, 255 - i, 7))
    control = lambda disposal, clear: b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0]) + b"\0"
    frame = lambda x, y, w, h, flags, data: b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, flags]) + lzw(data)
    gif = b"GIF89a" + bytes([4, 0, 4, 0, 0xF7, 0, 0]) + palette
    gif += control(1, None) + frame(0, 0, 4, 4, 0, bytes([9] * 16))
    gif += control(2, 5) + frame(1, 1, 2, 2, 0, bytes([5, 6, 7, 5]))
    gif += control(0, None) + frame(0, 0, 4, 4, 0x40, bytes([1] * 4 + [3] * 4 + [2] * 4 + [4] * 4)) + b"\x3b"
    shown = [c.copy() for _, _, c in media_gif.frames(gif)]
    assert shown[1][1, 1, 0] == 9 and shown[1][1, 2, 0] == 6 and shown[1][0, 0, 0] == 9
    assert [int(shown[2][r, 0, 0]) for r in range(4)] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        media_gif.read_gif(b"not a gif at all")


def plain_lzw(data, bits):
    """One code at a time, with a table of byte strings."""
    clear, stop = 1 << bits, (1 << bits) + 1
    number, at, out = int.from_bytes(data, "little"), 0, b""
    table, width, before = [], bits + 1, None
    while True:
        code = number >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
            continue
        if code == stop or at > 8 * len(data):
            return out
        word = table[code] if code < len(table) else before + before[:1]
        if before is not None and len(table) < 4096:
            table.append(before + word[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out, before = out + word, word


def plain_frames(gif):
    """Canvases of a GIF, pixel by pixel."""
    wide, high, flags = gif[6] | gif[7] << 8, gif[8] | gif[9] << 8, gif[10]
    at, common = 13, None
    if flags & 128:
        common = gif[at : at + 3 * (2 << (flags & 7))]
        at += len(common)
    canvas = [[(0, 0, 0)] * wide for _ in range(high)]
    disposal, clear, out = 0, None, []
    while gif[at] != 0x3B:
        if gif[at] == 0x21:
            if gif[at + 1] == 0xF9:
                disposal, clear = gif[at + 3] >> 2 & 7, gif[at + 6] if gif[at + 3] & 1 else None
            at += 2
            while gif[at]:
                at += gif[at] + 1
            at += 1
            continue
        x, y, w, h = (gif[at + k] | gif[at + k + 1] << 8 for k in (1, 3, 5, 7))
        flags, palette = gif[at + 9], common
        at += 10
        if flags & 128:
            palette = gif[at : at + 3 * (2 << (flags & 7))]
            at += len(palette)
        bits, data, at = gif[at], b"", at + 1
        while gif[at]:
            data += gif[at + 1 : at + 1 + gif[at]]
            at += gif[at] + 1
        at += 1
        samples = plain_lzw(data, bits)
        lines = [r for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, s)] if flags & 64 else list(range(h))
        saved = [list(row) for row in canvas]
        for k, r in enumerate(lines):
            for c in range(w):
                v = samples[k * w + c]
                if v != clear and y + r < high and x + c < wide:
                    canvas[y + r][x + c] = tuple(palette[3 * v : 3 * v + 3])
        out.append([list(row) for row in canvas])
        if disposal == 2:
            for r in range(y, min(high, y + h)):
                for c in range(x, min(wide, x + w)):
                    canvas[r][c] = (0, 0, 0)
        elif disposal == 3:
            canvas = saved
        disposal, clear = 0, None
    return out


def random_gif(rng):
    palette = lambda: bytes(rng.randrange(256) for _ in range(768))
    gif = b"GIF89a" + bytes([9, 0, 11, 0, 0xF7, 0, 0]) + palette()
    for _ in range(6):
        w, h, x, y = rng.randint(1, 9), rng.randint(1, 11), rng.randint(0, 4), rng.randint(0, 4)
        local, clear = rng.random() < 0.4, rng.randrange(4)
        gif += b"\x21\xf9\x04" + bytes([rng.randrange(4) << 2 | rng.randrange(2), 5, 0, clear]) + b"\0"
        gif += b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, (0x87 if local else 0) | (0x40 if rng.random() < 0.4 else 0)])
        gif += (palette() if local else b"") + bytes([8]) + media_gif._blocks(media_gif.lzw_encode(bytes(rng.randrange(4) for _ in range(w * h))))
    return gif + b"\x3b"


def test_frames_and_histograms_equal_a_plain_decoder():
    rng = random.Random(21)
    for _ in range(40):
        gif = random_gif(rng)
        want = plain_frames(gif)
        assert [c.tolist() for _, _, c in media_gif.frames(gif)] == [[[list(p) for p in row] for row in c] for c in want]
        for f, c in zip(media_gif.read_gif(gif)["frames"], want, strict=True):
            counts = Counter((r >> 6) << 4 | (g >> 6) << 2 | b >> 6 for row in c for r, g, b in row)
            assert {i: int(n) for i, n in enumerate(f["histogram"]) if n} == counts
    data = bytes(rng.randrange(3) for _ in range(20000)) + bytes(rng.randrange(256) for _ in range(20000))
    assert plain_lzw(media_gif.lzw_encode(data), 8) == data


def test_bad_media_give_a_null_and_a_reason(spark):
    rng = random.Random(22)
    gif = random_gif(rng)
    bad = [gif[:n] for n in range(0, len(gif) - 1, 7)] + [b"not a gif", b"GIF89a\xff\xff\xff\xff\0\0\0;", bytes(rng.randrange(256) for _ in range(200))]
    bad += [bytes(b ^ (rng.randrange(256) if rng.random() < 0.02 else 0) for b in gif) for _ in range(60)]
    rows = [(i, m) for i, m in enumerate([gif, None, *bad])]
    got = {r.id: r for r in media_gif.read_media(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert len(got) == len(rows) and got[0].image is not None and got[0].image_error is None
    assert got[1].image is None and got[1].image_error is None
    assert all((r.image is None) == (r.image_error is not None) for i, r in got.items() if i != 1)
    assert got[3].image is None and sum(r.image is None for r in got.values()) > 20


def test_media_query(spark, docs, none):
    out = media_gif.read_media(media_gif.store_text(clashing(docs, "image"))).collect()
    for r in out:
        raw = (r.text or "").encode()
        assert r.image.payload[: len(raw)] == raw and len(r.image.payload) % 64 == 0
    assert media_gif.read_media(media_gif.store_text(none)).count() == 0


# 8
def test_licenses_inside_texts(spark, none):
    notice = dict((a, c) for a, _, c in license_scan.TEMPLATES)
    rows = [(1, words(50, 1) + ". " + notice["mit-line"], "en", "s", 0), (2, words(30, 2) + " " + notice["mit-notice"].upper() + " " + words(30, 3), "en", "s", 0), (3, notice["apache-notice"].replace("obtain", "get"), "en", "s", 0), (4, words(100, 4), "en", "s", 0), (5, None, None, None, None), (6, "four words only here", "en", "s", 0), (1, words(50, 1) + ". " + notice["mit-line"], "en", "s", 0), (None, notice["cc-by-nc-line"], "en", "s", 0)]
    out = license_scan.scan_licenses(clashing(spark.createDataFrame(rows, SCHEMA), "sh", "level")).collect()
    found = Counter((r.doc_id, r.template) for r in out)
    assert found[1, "mit-line"] == 2 and found[2, "mit-notice"] == 1 and found[3, "apache-notice"] == 1 and found[None, "cc-by-nc-line"] == 1
    assert not [k for k in found if k[0] in (4, 5, 6)]
    assert next(r for r in out if r.doc_id == 1).first_word == 50
    assert license_scan.scan_licenses(none).count() == 0


def test_a_large_library_gives_the_same_licenses(spark):
    notice = dict((a, c) for a, _, c in license_scan.TEMPLATES)
    rng = random.Random(31)
    rows = [(i, words(rng.randint(0, 60), i) + " " + rng.choice(list(notice.values())) + " " + words(rng.randint(0, 60), i + 500), "en", "s", 0) for i in range(60)] + [(100, None, None, None, None), (101, "x", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    small = license_scan.scan_licenses(df).collect()
    table = spark.createDataFrame([(a, b, c) for a, b, c in license_scan.TEMPLATES], "template string, license string, text string")
    large = license_scan.scan_licenses(df, table, small_library=0).collect()
    assert Counter(small) == Counter(large) and len(small) >= 60


def test_a_full_license_text_is_found_and_its_windows_are_small(spark):
    rng = random.Random(4)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    long = " ".join(rng.choice(vocabulary) for _ in range(5600))
    templates = spark.createDataFrame([("full", "X-1.0", long), ("other", "Y-1.0", words(300, 5))], "template string, license string, text string")
    shingles = license_scan.template_shingles(spark, templates)
    windows = license_scan.template_windows(shingles).collect()
    assert sum(len(str(tuple(r))) for r in windows) < 10 << 20 and "t_sh" not in windows[0].asDict()
    altered = [" ".join(w if rng.random() > share / 5 else "zz" for w in long.split()) for share in (0.05, 0.15)]
    rows = [(0, "before " * 40 + long + " after" * 40), (1, altered[0]), (2, altered[1]), (3, " ".join(long.split()[:2000])), (4, words(400, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{(r.doc_id, r.template, round(r.containment, 6), r.first_word) for r in license_scan.scan_licenses(docs, templates, small_library=n).collect()} for n in (20_000, 0)]
    assert found[0] == found[1] and {x[0] for x in found[0]} == {0, 1, 2}


def test_license_matches_equal_brute_force(spark):
    """Every template whose shingles a text contains to 0.8 within a window of its length is found, and no other."""
    rng = random.Random(32)

    def shingles(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    rows, want = [], set()
    for i in range(80):
        name, _, notice = rng.choice(license_scan.TEMPLATES)
        w = notice.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(1000)}"
        text = words(30, i) + " " + " ".join(w) + " " + words(30, i + 900)
        rows.append((i, text, "en", "s", 0))
        have = set(shingles(text))
        for other, _, body in license_scan.TEMPLATES:
            t = set(shingles(body))
            if t and len(t & have) >= 0.8 * len(t):
                want.add((i, other))
    got = {(r.doc_id, r.template) for r in license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


# 9 and 10
def tiktoken_of(name):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=packing.load_ranks(packing.rank_path(name)), special_tokens={})


def test_ids_equal_the_library():
    rng = random.Random(1)
    letters = "ab  \n\t'st.,é日本#1x　\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, " " * 500, "ab" * 999, None, "", "<|endoftext|>"]
    texts += ["".join(rng.choice("aab") for _ in range(rng.randint(5, 40))) for _ in range(2000)]
    enc = tiktoken_of(bpe.VOCABULARY)
    got = bpe._codec(packing.rank_path(bpe.VOCABULARY)).encode_texts(pa.array(texts))
    assert all(np.frombuffer(g, "<i4").tolist() == enc.encode_ordinary(t or "") for g, t in zip(got, texts, strict=True))


def test_ids_of_a_whole_corpus_equal_the_library_in_any_slices(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["", "a", "the", "don't", "x,y", "été", "\n", "  q", "1234", "\x00", "日本語"]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "a" * 3000, " ".join(["same"] * 5000)] + ["copy of a text"] * 200
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, slice string").repartition(3)
    enc = tiktoken_of(bpe.VOCABULARY)
    for limit in (200, 1 << 20):
        got = bpe.encode_documents(clashing(df, "ids", "stem"), slice_bytes=limit, decode_to="decoded").collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.ids == enc.encode_ordinary(texts[r.doc_id] or "") and r.slice == "kept" and r.stem == "clash"
            assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_pieces_that_are_in_no_list_are_encoded_on_the_spot(spark):
    cache = bpe.PieceCache(bpe._codec(packing.rank_path(bpe.VOCABULARY)).encode, remember=None)
    got = cache.look_up(pa.array(["never listed before", None, "x" * 100 + " y"]))
    enc = tiktoken_of(bpe.VOCABULARY)
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [enc.encode_ordinary(t) for t in ("never listed before", "", "x" * 100 + " y")]


def test_decoded_bytes_are_the_text(spark, docs, none):
    for r in bpe.decode_ids(bpe.encode_documents(clashing(docs, "ids", "decoded"))).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.decode_ids(bpe.encode_documents(none)).count() == 0


def test_pieces_cover_all_ids(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    pieces = packing.pack_documents(clashing(docs, "start", "length")).collect()
    want = Counter(tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in BASE + ODD)
    by = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        by.setdefault(p.sequence_id, []).append(p)
        assert len(p.ids) == 4 * p.length
    flat = []
    for k, v in sorted(by.items()):
        assert [p.offset for p in v] == list(np.cumsum([0] + [p.length for p in v])[:-1])
        assert sum(p.length for p in v) == packing.LENGTH or k == max(by)
        flat += [(p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens) for p in v]
    docs_seen, now = [], []
    for start, ids, total in flat:
        assert start == len(now)
        now += ids
        if len(now) == total:
            docs_seen.append(tuple(now))
            now = []
    assert Counter(docs_seen) == want and not now
    assert packing.pack_documents(none).count() == 0


def test_added_tokens_have_the_ids_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = ["".join(rng.choice(["<|endoftext|>", " ", "  ", "\n", "a", "b's", "é", "<|", "|>"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "", None, "<|endoftext|><|endoftext|>"]
    got = packing._cache(packing.VOCABULARY).encode_texts(pa.array(texts))
    assert np.frombuffer(got[3000], "<u4").tolist() == [64, 220, 50256, 275]
    assert all(np.frombuffer(g, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids for g, x in zip(got, texts, strict=True))


def test_sequences_are_padded(spark, docs):
    seqs = packing.sequences(packing.pack_documents(docs)).collect()
    assert all(len(s.ids) == 4 * packing.LENGTH or s.used & (s.used - 1) == 0 for s in seqs)


# queries and the pipeline
def test_digests_of_the_queries(spark, sf):
    texts = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = tiktoken_of(bpe.VOCABULARY)
    for r in q.op9_bpe(spark, sf).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    for r in q.op7_media_gif(spark, sf).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    for r in q.op1_sharding(spark, sf).collect():
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1


def test_pipeline_keeps_columns_and_one_of_each_class(spark, sf):
    import corpus_pipeline as cp

    start = spark.read.parquet(f"{sf}/documents.parquet")
    docs = start
    for name, stage in cp.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, sf), "test")
        assert out.columns == start.columns and 0 < out.count() <= docs.count(), name
        docs = out
    texts = [r.text for r in docs.collect()]
    assert len(set(classes(texts))) == len(texts)
    pieces = cp.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_on_odd_tables(spark, sf, docs, none):
    import corpus_pipeline as cp

    odd = clashing(docs, "score", "kept", "n_words", "node")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all((r.score, r.kept, r.n_words, r.node) == ("clash",) * 4 for r in rows), name
        assert stage(spark, none, sf).count() == 0, name
    kept = cp.rules(spark, docs, sf).collect()
    assert all(len((r.text or "").split()) >= 20 for r in kept) and len([r for r in kept if r.text == BASE[0][1]]) == 4
    assert {r.doc_id for r in cp.packing(spark, docs, sf).select("doc_id").distinct().collect()} == {r[0] for r in BASE + ODD}
    assert cp.packing(spark, none, sf).count() == 0


def test_null_and_empty_languages_are_two(spark):
    rows = [(i, words(60, i), None if i % 2 else "", "s", 1) for i in range(40)]
    together = {r.doc_id: r.nats for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    apart = {r.doc_id: r.nats for r in quality_rules.quality_rules(spark.createDataFrame([r for r in rows if r[2] is None], SCHEMA)).collect()}
    assert all(together[k] == pytest.approx(v, abs=1e-9) for k, v in apart.items())
