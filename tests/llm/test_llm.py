import gzip
import hashlib
import random
import tracemalloc
import zipfile
from collections import defaultdict
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import _io, decontaminate, dedup, langid, licenses, quality, sentencepieces, sharding, toxicity, urls, warc
from twinframe.llm import queries as llm

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", "en", "s", 4), (4, "one two", "en", "s", 7), (4, "one two", "en", "s", 7), (5, "x" * 70000, "en", "s", 70000), (6, "12 34 !?", None, "s", 8), (7, "the end of the thing " * 4000, "en", "s", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(llm.oracles()))
def test_against_sql(spark, name):
    df = llm.queries()[name](spark, SF)
    con, cols = duckdb.connect(), sorted(df.columns)
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(llm.oracles()[name])
    names = [d[0] for d in rel.description]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())


def test_pieces_equal_the_library_and_come_back(spark, docs, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    hard = [(k, t) for k, t in enumerate(["=" * 900, " " * 700, "thethethe" * 120, "漢" * 400, "a▁b  c" * 150, "é=\x00 " * 200])]
    some = docs.select("doc_id", "text")
    for df, chunk, library in ((some, 700, True), (some, 5000, False), (spark.createDataFrame(hard, "doc_id bigint, text string"), 128, True), (spark.createDataFrame(hard, "doc_id bigint, text string"), 128, False)):
        rows = sentencepieces.encode(df, "doc_id", "text", chunk_chars=chunk, library=library).collect()
        assert len(rows) == df.count() and max(r["n_chunks"] for r in rows) > 1
        assert all(r["ids"] == sp.encode(r["text"]) for r in rows)
    clash = sentencepieces.encode(odd.limit(0).withColumns({"IDS": F.lit(1), "n_ids": F.lit("x"), "__row": F.lit(2)}), "doc_id", "text")
    assert clash.count() == 0 and [c for c in clash.columns if c.lower() in ("ids", "n_ids", "n_chunks", "__row")] == ["__row", "ids", "n_ids", "n_chunks"]
    got = {r["doc_id"]: r for r in sentencepieces.summary(sentencepieces.encode(odd, "doc_id", "text"), "doc_id", "text").collect()}
    assert got[1]["n_ids"] is None and got[2]["n_ids"] == 0 and got[5]["n_chunks"] == 3 and all(r["round_trip"] for r in got.values())


def test_long_texts_without_a_key_or_with_a_repeated_one(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    a, b = "the end of the thing " * 4000, "another one " * 7000
    rows = [(None, a, "p"), (None, b, None), (3, a, "q"), (3, b, "q"), (3, b, "q"), (None, "short", "r"), (4, a, "s")]
    got = sentencepieces.encode(spark.createDataFrame(rows, "doc_id bigint, text string, __row string").repartition(3), "doc_id", "text").collect()
    assert sorted(map(repr, rows)) == sorted(repr((r["doc_id"], r["text"], r["__row"])) for r in got)
    assert all(r["ids"] == sp.encode(r["text"]) and r["n_ids"] == len(r["ids"]) and r["n_chunks"] == (1 if r["text"] == "short" else 3) for r in got)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\n", "same"), (2, None, "same"), (3, "http://b", None), (4, "http://b", ""), (5, "u", "é" * 10), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    archives = warc.write_archives(pages, "page_id", "url", "html")
    got = {r["record"]: r for r in warc.read_archives(spark, archives.select("path")).collect()}
    assert {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in got.items()} == {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 20), None: ("revisit", 2, 4)}
    assert got[5]["payload"].decode() == "é" * 10
    assert all(r[0] == "response" for r in warc.read_archives(spark, warc.write_archives(pages, "page_id", "url", "html", min_bytes=5).select("path")).select("record_type").collect())
    assert warc.write_archives(pages.limit(0), "page_id", "url", "html").count() == 0
    # ZIP64: the same members, every size and offset moved into the extra field
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(3):
            with z.open(zipfile.ZipInfo(f"m{k}"), "w", force_zip64=True) as m:
                m.write(b"x" * (k + 1))
    raw = bytearray(path.read_bytes())
    end = raw.rfind(b"PK\5\6")
    start = int.from_bytes(raw[end + 16 : end + 20], "little")
    wide = b"PK\6\6" + (44).to_bytes(8, "little") + b"\0" * 12 + (3).to_bytes(8, "little") * 2 + (end - start).to_bytes(8, "little") + start.to_bytes(8, "little")
    locator = b"PK\6\7" + b"\0" * 4 + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    tail = b"PK\5\6" + b"\0" * 4 + b"\xff" * 12 + b"\0\0"
    (tmp_path / "w.zip").write_bytes(bytes(raw[:end]) + wide + locator + tail)
    f = warc.RangeFile(str(tmp_path / "w.zip"))
    d = warc.directory(f)
    assert [f.read(*warc.stored_range(f, d[f"m{k}"])) for k in range(3)] == [b"x", b"xx", b"xxx"]


def _record(kind, body, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC_Type": kind, **fields, "Content_Length": len(body)}.items())
    return gzip.compress(f"WARC/1.0\r\n{head}\r\n".encode() + body + b"\r\n\r\n")


@pytest.mark.parametrize("index", ["cdxj", None])
def test_foreign_archives(spark, tmp_path, index):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body"
    records = [
        _record("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:uuid:1>", Content_Type="application/warc-fields"),
        _record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:uuid:2>", Content_Type="application/http;msgtype=request"),
        _record("response", page, WARC_Record_ID="<urn:uuid:3>", Content_Type="application/http;msgtype=response", WARC_Target_URI="http://a/"),
        _record("revisit", b"", WARC_Record_ID="<urn:uuid:4>", WARC_Refers_To="<urn:uuid:3>", Content_Type="application/http;msgtype=response"),
    ]
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("pages/pages.jsonl", "{}")
        z.writestr("archive/one.warc.gz", b"".join(records[:2]))
        z.writestr("archive/two.warc.gz", b"".join(records[2:]))
        if index:
            places = [("one.warc.gz", 0, len(records[0])), ("one.warc.gz", len(records[0]), len(records[1])), ("two.warc.gz", 0, len(records[2])), ("two.warc.gz", len(records[2]), len(records[3]))]
            z.writestr("indexes/index.cdxj", "".join(f'com,a)/ 2020 {{"offset": "{o}", "length": "{n}", "filename": "{f}"}}\n' for f, o, n in places))
    got = {r["record_id"]: r for r in warc.read_archives(spark, spark.createDataFrame([(str(path),)], "path string")).collect()}
    assert [(k[-1], got[k]["record_type"], got[k]["record"]) for k in sorted(got)] == [("1", "warcinfo", None), ("2", "request", None), ("3", "response", None), ("4", "revisit", None)]
    three, four = got["urn:uuid:3"], got["urn:uuid:4"]
    assert three["payload"] == b"<p>body" and three["payload_digest"] == warc.digest_text(hashlib.sha1(b"<p>body").digest()) and four["refers_to_id"] == "urn:uuid:3" and four["payload"] is None


def test_long_payloads_and_many_tasks(spark):
    rows = [(k, "u", "é" * 2_000_000 if k == 1 else "x" * k) for k in range(40)] + [(7, "v", "x" * 7)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), "page_id", "url", "html")
    found = warc.read_archives(spark, archives.select("path"))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = [(r["record"], r["record_type"], bytes(r["payload"]).decode()) for r in found.collect()]
    assert sorted(got) == sorted((k, "response", t) for k, _, t in rows)  # rows that repeat the largest number are responses both


def test_language(spark, docs, odd):
    rows = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    model = langid.train(_io.train_rows(docs))
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3, 6)) and got[7]["lang_pred"] == "en"
    assert langid.predict(odd.limit(0), langid.train(odd.limit(0))).count() == 0
    more = spark.createDataFrame([(1, "½ ② Ⅷ 12"), (2, "½the thing"), (3, "the thing"), (3, "the thing"), (4, "the" * 9000)], "doc_id bigint, text string").withColumns({"LANG_PRED": F.lit("x"), "score": F.lit(7)})
    rows = langid.predict(more, model).collect()
    assert [r["lang_pred"] for r in rows] == ["und", "en", "en", "en", rows[4]["lang_pred"]] and rows[2] == rows[3] and "LANG_PRED" not in rows[0]
    tie = langid.Model(["b", "c"], ["▁a"], np.array([[0.5, 0.5]]))
    assert tie.predict(["a"])[0] == ["b"]
    # the forward recursion against all cuts of a word, and of a long one against the sum by hand
    small = langid.Model(["x"], ["▁a", "b", "▁ab", "bb", "c"], np.array([[0.3], [0.2], [0.1], [0.25], [0.15]]))
    cuts = 0.3 * 0.2 * 0.2 * 0.15 + 0.3 * 0.25 * 0.15 + 0.1 * 0.2 * 0.15
    assert np.isclose(small.word_scores(["abbc"])[0, 0], np.log(cuts), atol=1e-6)
    word, table = "ab" * 40 + "bbc" * 30, {p: Decimal(float(x)) for p, x in zip(small.vocabulary, small.p[:, 0])}
    marked, unknown = "▁" + word, Decimal(langid.UNKNOWN)
    total = [Decimal(1)] + [Decimal(0)] * len(marked)
    for end in range(1, len(marked) + 1):
        total[end] = total[end - 1] * unknown + sum(total[k] * table.get(marked[k:end], 0) for k in range(max(0, end - 3), end))
    assert np.isclose(small.word_scores([word])[0, 0], float(total[-1].ln()), atol=1e-6)


def test_toxicity(spark, odd):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.query(base, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9
    m = toxicity.Model({" idiot ": 5.0}, ["idiot proof"], (-5.0, 1.0, 2.0))
    assert m.measure("an 1D10T!")[0] == 5 and m.measure("іdіоt")[0] == 5 and m.measure("idiot$$$ x")[0] == 5
    assert m.measure("idiot proof")[0] == 0 and m.measure("idiotic")[0] == 0 and m.measure(None) == (0.0, 0)
    assert m.measure("1d!0t")[0] == 5 and m.measure("$$$ idiot")[0] == 5 and toxicity.fold("a$$et @ss $tupid") == "asset ass stupid"
    clash = toxicity.score(odd.withColumns({"SCORE": F.lit("x"), "n_words": F.lit(None).cast("int")}), m)
    assert clash.count() == len(ODD) and "SCORE" not in clash.columns and toxicity.score(odd.limit(0), m).count() == 0
    # the automaton against a search for every entry at every word
    rnd = random.Random(2)
    parts = ["ab", "abc", "cab", "bca", "c", "abca", "a"]
    entries = {" ab ": 2.0, " abc": 3.0, " c ": 1.0, " bca ": 4.0, " ca": 2.5}
    own = toxicity.Model(entries, ["abc c", "bca"], (0.0, 1.0, 1.0))
    for _ in range(200):
        words = rnd.choices(parts, k=rnd.randint(0, 9))
        line, total = f" {' '.join(words)} ", 0.0
        spared = {k for p in own.exceptions for k in range(len(line)) if any(line.startswith(f" {p} ", j) and j <= k < j + len(p) + 1 for j in range(len(line)))}
        for k in range(len(line)):
            if line[k] == " " and k not in spared:
                total += max([w for e, w in entries.items() if line.startswith(e, k)], default=0.0)
        assert own.raw(words) == total
    assert toxicity.score(odd, m).count() == len(ODD)
    assert toxicity.train(odd, labels.limit(0)).entries == {}


def test_decontamination(spark, docs, odd):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: " ".join(decontaminate.words_of(r["text"])) for r in benchmark.collect()}
    texts = {r["doc_id"]: f" {' '.join(decontaminate.words_of(r['text']))} " for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, w in items.items() if f" {w} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark).collect()}
    assert want and want <= got
    own = items[0].split()
    own[3::5] = ["changed"] * len(own[3::5])
    extra = spark.createDataFrame([(900, "filler words here " * 30 + " ".join(own) + " more filler" * 30)], "doc_id bigint, text string")
    found = decontaminate.matches(docs.select("doc_id", "text").unionByName(extra), benchmark).where("doc_id = 900").collect()
    assert [r["item_id"] for r in found] == [0]
    assert decontaminate.mark(odd, benchmark).where("n_items > 0").count() == 0
    assert decontaminate.matches(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.lcs(list("abcde"), list("xaxcxe"))[0] == 3


def test_items_without_their_rarest_words_are_found(spark):
    own = [f"t{j:02}" for j in range(40)]  # each is in some 3 % of the documents
    texts = [" ".join([f"f{d}n{i}" for i in range(20)] + [w for j, w in enumerate(own) if (d * 7 + j * 13) % 33 == 0]) for d in range(200)]
    changed = " ".join(["filler"] * 20 + ["other"] * 8 + own[8:] + ["filler"] * 20)  # equally rare: the first in order count as the rarest
    docs = spark.createDataFrame(list(enumerate([*texts, changed])), "doc_id bigint, text string")
    got = decontaminate.matches(docs, spark.createDataFrame([(1, " ".join(own))], "item_id bigint, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(200, 1)]


def test_paraphrases_and_slices(spark, docs):
    """Items between other words, with three in ten words replaced and others put in; and the same items in several slices."""
    rnd = random.Random(4)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    pool = [f"w{rnd.randrange(900)}" for _ in range(5000)]
    rows = []
    for r in benchmark.collect():
        own = [rnd.choice(pool) if rnd.random() < 0.3 else w for w in decontaminate.words_of(r["text"])]
        own = [x for w in own for x in ([w, rnd.choice(pool)] if rnd.random() < 0.1 else [w])]
        rows.append((1000 + r["item_id"], " ".join(rnd.choices(pool, k=70) + own + rnd.choices(pool, k=70))))
    clean = [(5000 + k, " ".join(rnd.choices(pool, k=300))) for k in range(200)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows + clean, "doc_id bigint, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(every, benchmark).collect()}
    assert sum((d, d - 1000) in found for d, _ in rows) >= 0.9 * len(rows)
    assert all(d < 5000 and (d < 1000 or d - 1000 == i) for d, i in found)
    cut = decontaminate.Settings(max_items=9)
    parts = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(every, benchmark, settings=cut).collect()}
    assert len(parts ^ found) <= 0.05 * len(found)  # each slice has a latent space of its own
    n = {r["doc_id"]: r["n_items"] for r in decontaminate.mark(every.withColumn("N_items", F.lit("x")), benchmark, settings=cut).collect()}
    assert all(n[d] == sum(x == d for x, _ in parts) for d in n)
    twice = benchmark.unionByName(benchmark.withColumn("item_id", F.lit(None).cast("bigint")))
    assert {(d, i) for d, i in found} <= {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(every, twice).collect()}


def test_items_word_for_word_are_found_among_any_words(spark, tmp_path):
    """Items of 1 to 90 words between words that are rarer than theirs, which make the passage unlike the item."""
    import corpus_pipeline

    rnd = random.Random(8)
    common, rare = [f"c{i}" for i in range(120)], [f"r{i}" for i in range(600)]
    items = [[rnd.choice(common) for _ in range(n)] + [f"own{k}"] for k, n in enumerate([0, 1, 2, 3, 5, 6, 7, 8, 9, 12, 20, 33, 40, 47, 48, 60, 90] * 3)]
    glossary = [rare[k : k + 30] for k in range(0, 600, 30)]  # items as well, so that their words count
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([*items, *glossary])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    around = lambda: rnd.sample(rare, rnd.randrange(20, 60))
    holding = [(k, " ".join(around() + w + around())) for k, w in enumerate(items)]
    clean = [(1000 + k, " ".join(around() + around())) for k in range(40)] + [(2000 + k, " ".join(rnd.choices(common, k=80) + [f"own{k}"] * (k > 8))) for k in range(300)]
    docs = spark.createDataFrame(holding + clean, "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).where("doc_id < 1000").collect()}
    assert [k for k, _ in holding if (k, k) not in found] == []
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).collect()}
    assert not kept & {k for k, _ in holding} and kept >= {k for k, _ in clean if k < 2000}


def test_sharing_pairs_against_counting():
    """The pairs that the list of items gives, against all pairs of passages and items."""
    rnd = random.Random(6)
    items = [(k, [f"t{rnd.randrange(60)}" for _ in range(rnd.choice([1, 5, 30, 130]))], [], None) for k in range(25)]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, own, *_ in items for w in own}))}
    index = decontaminate.Index(decontaminate.Settings(), vocabulary, np.ones(len(vocabulary)), np.eye(len(vocabulary), 8), items)
    texts = [[f"t{rnd.randrange(90)}" if rnd.random() < 0.3 else "other" for _ in range(rnd.choice([0, 3, 40, 200]))] for _ in range(12)]
    segments = [-(-len(w) // 16) for w in texts]
    first = np.concatenate([[0], np.cumsum(segments)]).astype(int)
    at = [(vocabulary[w], first[k] + j // 16) for k, own in enumerate(texts) for j, w in enumerate(own) if w in vocabulary]
    doc_of = np.repeat(np.arange(len(texts)), segments)
    got = set(zip(*map(list, index._sharing(np.array([i for i, _ in at]), np.array([p for _, p in at]), doc_of))))
    terms_of = [set(vocabulary[w] for w in own[a : a + 48]) for _, own, *_ in items for a in range(0, max(1, len(own) - 24), 48)]
    want = set()
    for k, own in enumerate(texts):
        for p in range(segments[k]):
            held = [vocabulary[w] for w in own[16 * p : 16 * p + 48] if w in vocabulary]
            want |= {(first[k] + p, c) for c, own_terms in enumerate(terms_of) if sum(h in own_terms for h in held) >= min(2, len(own_terms))}
    assert got == want


def test_quality(spark, odd):
    got = {r["doc_id"]: r for r in quality.judge(odd).collect()}
    assert (got[1]["n_words"], got[1]["base_failed"], got[1]["kept"]) == (0, True, False) and got[7]["n_repeat_words"] == 20000
    assert quality.judge(odd.limit(0)).count() == 0
    clash = quality.judge(odd.withColumns({"N_WORDS": F.lit("x"), "kept": F.lit(3), "rejected_by": F.lit(None).cast("int")}))
    assert {r["doc_id"]: (r["n_words"], r["kept"]) for r in clash.collect()} == {k: (r["n_words"], r["kept"]) for k, r in got.items()}
    tests = quality.base_rules() | quality.rules()
    found = quality.measure(odd.select("text"), tests)
    assert {r["rule"] for r in found} == set(tests) == set(quality.INPUTS) and next(r for r in found if r["rule"] == "short")["rejects"] == 0.875


def test_sharding(spark):
    names = ["a", "b", "c", "d"]
    t = sharding.lookup_table(names, 101)
    assert {t.count(k) for k in range(4)} <= {25, 26}
    left = sharding.lookup_table(names[:3], 101)
    assert sum(x != y for x, y in zip(t, left) if x != 3) < 30
    df = spark.createDataFrame([("k", 1), (None, 2)], "key string, slot int")
    assert sharding.place(df, "key", names, 101).columns.count("slot") == 1
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_urls(spark):
    rows = [(1, None), (2, "no host"), (3, "HTTP://A.Example.COM/en/7x?y"), (4, "http://a.com/en/1"), (5, "http://xcom/en/"), (6, "x://example.net/de/8"), (7, "x://b.example.net/de/9#f"), (8, "x://o.org/es/")]
    want = {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "block"}
    for words in (urls.MAX_WORDS, 1):
        assert {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), max_words=words).collect()} == want
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    for words in (urls.MAX_WORDS, 4):
        assert urls.build(keys, words).listed(keys.withColumnRenamed("listed", "want"), "key").where("listed <> want").count() == 0


def test_licenses(spark, odd):
    assert licenses.scan(odd).where("license is not null or licenses <> ''").count() == 0
    text = "Hello.\nLicensed under the MIT license.  Other text here. RELEASED under the MIT License!"
    assert tuple(licenses.scan(spark.createDataFrame([(text,)], "text string")).first()) == (text, 2, "MIT", "MIT")


MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
'''
BSD = '''Copyright (c) 2020, Some Owner.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE.
'''
GPL = '''    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
'''


def test_wrapped_licenses(spark):
    want = {"MIT": (MIT, 2), "BSD": (BSD, 3), "GPL-3.0": (GPL, 5), "Apache-2.0": (APACHE, 4)}
    ways = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */", lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n"))]
    rows = [(f(t), n, k) for k, (t, n) in want.items() for f in ways]
    # a line's end still ends a sentence; a blank line, or more words on a line, is no part of one
    rows += [("My tool\nReleased under the MIT License\nby me", 1, "MIT"), ("Released under\nthe MIT License", 1, "MIT"), ("Released under\n\nthe MIT License", 0, None), ("It is not released under\nthe MIT License", 0, None), ("Released under the MIT License of\nsome", 0, None), ('Licensed under the Apache License, Version 2.0\n(the "License").', 1, "Apache-2.0")]
    got = licenses.scan(spark.createDataFrame(rows, "text string, want_n int, want string")).collect()
    assert [(r["license_sentences"], r["license"], r["licenses"]) for r in got] == [(r["want_n"], r["want"], r["want"] or "") for r in got]


NOTICES = {
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages.""",
    "BSL-1.0": "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file)",
}


def test_more_notices(spark, odd):
    three = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS SOFTWARE IS"
    rows = [*NOTICES.items(), ("BSD-3-Clause", BSD.replace("THIS SOFTWARE IS", three)), ("BSD", BSD), ("GPL-3.0", GPL)]
    df = spark.createDataFrame([(w, "x", 1, "# " + t.replace("\n", "\n# ")) for w, t in rows], "license string, __ids string, __sentences int, text string").withColumnRenamed("license", "want")
    got = licenses.scan(df).collect()
    assert [r["license"] for r in got] == [r["want"] for r in got] and {r["__ids"] for r in got} == {"x"}
    assert licenses.scan(odd.limit(0)).count() == 0


def _brute(texts):
    sets = {}
    for k, t in texts.items():
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for a in sorted(sets):
        seen, todo = {a}, [a]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[a] = (len(sets[a]), min(seen))
    return out


def test_join_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    shared = " ".join(rnd.choices(words, k=60))
    for _ in range(12):
        base = rnd.choices(words, k=rnd.randint(3, 160))
        for _ in range(rnd.randint(1, 8)):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts[k] = (" ".join(copy) + (" " + shared if rnd.random() < 0.3 else "")).title() if k % 3 else " ".join(copy)
            k += 1
    texts |= {k: None, k + 1: "", k + 2: " \n", k + 3: "one two", k + 4: "ONE  two", k + 5: "é" * 10}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    want = _brute(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.components(df).collect()} == want
    assert dedup.components(df.limit(0)).count() == 0
    # rows that repeat a key, rows without one (a link between two others may lead over them), other columns
    base = [f"w{i}" for i in range(60)]
    one, two = base[:50] + ["x"] * 2 + base[52:], base[:48] + ["x"] * 4 + base[52:]
    rows = [(5, " ".join(base), "p", 1), (None, " ".join(one), None, 2), (9, " ".join(two), "q", 3), (5, " ".join(base), "p", 4), (None, None, "r", 5), (None, "alone here", "r", 6)]
    got = dedup.components(spark.createDataFrame(rows, "doc_id bigint, text string, r0 string, n_shingles int")).collect()
    assert sorted((r["doc_id"] or 0, r["r0"] or "", r["component_id"] or 0) for r in got) == [(0, "", 5), (0, "r", 0), (0, "r", 0), (5, "p", 5), (5, "p", 5), (9, "q", 5)]
    long = "x " * 900000
    assert [len(s) for s in dedup.shingle_sets([long, "y", long])] == [1, 1, 1]


def test_join_of_groups_around_the_threshold(spark):
    """Copies that change so much that some pairs of a group are links and some are not, chains, and words of any length."""
    rnd = random.Random(11)
    texts, k = {}, 0
    for _ in range(5):
        base = [f"b{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 120))]
        for _ in range(24):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = f"c{rnd.randrange(10**6)}"
            cut = rnd.randint(0, 12)
            texts[k] = " ".join(copy[cut:] if rnd.random() < 0.5 else copy[: len(copy) - cut])
            k += 1
    chain = [f"d{i}" for i in range(100)]
    for step in range(0, 60, 3):
        texts[k] = " ".join([f"e{i}" for i in range(step)] + chain[step:])
        k += 1
    texts |= {k: "a" * 4096 + "b" * 4096, k + 1: "b" * 4096 + "a" * 4096, k + 2: "a" * 4096 + "B" * 4096, k + 3: "x" * 65, k + 4: "x" * 64 + "y"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.components(df).collect()} == _brute(texts)


def test_long_texts_among_short_ones():
    words = [f"w{k * 7919 % 90001}" for k in range(700_000)]
    for k in (5, 300_000):
        words[k] = "ab" * 1_500_000
    long, short = "\t ".join(words), ["a b c d e f", None, "", "x"] * 300
    tracemalloc.start()
    got = dedup.shingle_sets([*short, long, *short])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20  # 500 MB when all of a long text is hashed at a time
    hashes = dedup._words(" ".join(words).encode() + b" ")[1]
    assert np.array_equal(got[len(short)], dedup._set(hashes, dedup.WORDS))
    assert [x.tolist() for x in got[: len(short)]] == [x.tolist() for x in got[len(short) + 1 :]] == [x.tolist() for x in dedup.shingle_sets(short[:4])] * 300


def test_classes(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [tuple(rnd.sample(range(200, 260), 2)) for _ in range(25)] + [(7, 7)]
    parent = {x: x for e in links for x in e}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["root"] for r in dedup.classes(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: r for x, r in parent.items() if x != r}


def test_pipeline(spark, docs):
    import corpus_pipeline

    stages, labels = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    ids = lambda df: sorted(r["doc_id"] or 0 for r in df.collect())
    # each stage against plain Python, or against its operator's answer for each text by itself
    model = langid.train(_io.train_rows(docs))
    langs, shares = model.predict([r["text"] for r in rows])
    assert ids(stages["language"](spark, docs, SF)) == sorted(r["doc_id"] for r, x, p in zip(rows, langs, shares) if x != "und" and p >= corpus_pipeline.LEAST_LANGUAGE_SCORE)
    lexicon = toxicity.train(docs, _io.train_rows(labels))
    calm = sorted(r["doc_id"] for r in rows if lexicon.score(*lexicon.measure(r["text"])) < 0.7)
    assert ids(stages["toxicity"](spark, docs, SF)) == calm
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert np.mean([marked[r["doc_id"]] == (r["doc_id"] not in calm) for r in rows if r["doc_id"] in marked]) > 0.8  # learned from some sixty texts
    extra = spark.createDataFrame([(None, rows[5]["text"], "en", "s", 1), (None, "alone " * 9, "en", "s", 1), (rows[5]["doc_id"], "other " + "words " * 9, "en", "s", 1), (rows[5]["doc_id"], rows[5]["text"], "en", "s", 1), (10**9, None, None, None, None)], DOC)
    every = [*rows, *extra.collect()]
    groups = defaultdict(list)
    for k, (_, c) in _brute({k: r["text"] for k, r in enumerate(every)}).items():
        groups[c].append(k)
    first = [min(g, key=lambda k: (every[k]["doc_id"] is None, every[k]["doc_id"] or 0)) for g in groups.values()]
    assert ids(stages["near_duplicates"](spark, docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra), SF)) == sorted(every[k]["doc_id"] or 0 for k in first)
    benchmark = [f" {' '.join(decontaminate.words_of(r['text']))} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = ids(stages["decontamination"](spark, docs, SF))
    holds = {r["doc_id"] for r in rows if any(b in f" {' '.join(decontaminate.words_of(r['text']))} " for b in benchmark)}
    found = {r["doc_id"] for r in decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert holds and not holds & set(clean) and set(clean) == {r["doc_id"] for r in rows} - found
    coded = stages["tokens"](spark, docs, SF).collect()
    assert len(coded) == len(rows) and all(r["round_trip"] for r in coded)
    kept = ids(corpus_pipeline.run(spark, SF))
    assert kept and set(kept) <= set(calm) & set(clean) and len(set(kept)) == len(kept)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert Path(corpus_pipeline.__file__).exists()


def test_documents_that_name_no_language_stay(spark, odd):
    import corpus_pipeline

    kept = dict(corpus_pipeline.STAGES)["language"](spark, odd.withColumn("lang", F.lit(None).cast("string")), SF)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 4, 5, 7]


def test_stages_give_heap_back(spark, docs):
    import corpus_pipeline

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())

    few = docs.limit(60)
    for name, stage in corpus_pipeline.STAGES:
        before = collections()
        stage(spark, few, SF)
        assert collections() > before, name  # none when heaps keep the size that earlier stages have grown them to
    size = spark._jvm.java.lang.Runtime.getRuntime().totalMemory
    spark.range(0, 2_000_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 512).alias("v"), F.pmod("id", F.lit(97)).alias("k")).groupBy("k").agg(F.collect_list("v").alias("x")).write.format("noop").mode("overwrite").save()
    grown = size()
    _io.collect_garbage(spark)
    assert size() < grown
