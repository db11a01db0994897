"""Operators on small tables: edge cases, brute force and round trips."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from scholium.llm import decontaminate, exact_dedup, html_text, jaccard_join, language, packing, pii, quality, token_files, warc
from scholium.llm.tokens import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, kept boolean, start long, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei", "uno", "dos"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(400))
    near = long.replace("alpha", "omega", 3)
    texts = [(1, "same text"), (2, "same text"), (2, "same text"), (3, None), (4, ""), (5, long), (6, near), (7, "x"), (8, "a b c d"), (None, "same text"), (None, None), (9, "word " * 20_000), (10, "The quick brown fox jumps"), (1 << 60, long)]
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, "s", 0, 7, True, 3, "d") for k, (i, t) in enumerate(texts)], SCHEMA).repartition(3)


def same(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return t.encode(text or "", add_special_tokens=False).ids


def test_exact_dedup(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = exact_dedup.exact_dedup(spark, docs).collect()
    assert same([r["doc_id"] for r in rows], [r["doc_id"] for r in got])
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    by = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in got:
        g = by[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == max((i for i in g if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_copies(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def shingles(text):
    w = [bytes(x).lower() for x in (text or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(root(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in low[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def test_jaccard_join(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in jaccard_join.jaccard_components(spark, docs).collect()]
    assert same(got, brute_components(rows))


@pytest.mark.parametrize("most", [4096, 3])
def test_jaccard_join_near_copies(spark, most):
    """Families of near copies, also when regions must be split in distributed pivot steps."""
    rng = random.Random(10)
    rows = []
    for family in range(4):
        base = [f"w{family}_{i}" for i in range(60)]
        for c in range(8):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(60)] = f"e{rng.randint(0, 10**6)}"
            rows.append((family * 100 + c, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.jaccard_components(spark, df, most=most, chunk=2).collect()]
    assert same(got, brute_components(rows))


def test_token_files_round_trip(spark, docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, expected = 0, []
    for i, t in rows:
        ids = np.array([*ids_of(t), 0], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.token_files(spark, docs).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected


def test_packing_covers_every_id(spark, docs):
    got = packing.pack(spark, docs).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    rows = docs.select("doc_id", "text").collect()
    assert sum(n for p in pieces.values() for _, n in p) == sum(len(ids_of(r["text"])) + 1 for r in rows)
    ids = np.array([*ids_of("The quick brown fox jumps"), 1], "<u4")
    for r in got:
        if r["doc_id"] == 10:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_warc_round_trip(spark):
    rows = [(1, "http://a.org/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b.org/ y", None), (3, "http://b.org/ y", None), (4, "", ""), (None, "http://a.org/1", "<p>x</p>"), (5, "http://a.org/1", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, key int").repartition(3)
    got = warc.archive_round_trip(spark, pages).collect()
    assert len(got) == len(rows)
    for r in got:
        body = next(h or "" for i, _, h in rows if i == r["page_id"]).encode() if r["page_id"] else b"<p>x</p>"
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == warc.sha1_base32(body)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [("1", "response", None), ("2", "revisit", 1), ("3", "response", None), ("3", "revisit", 3), ("4", "revisit", 3), ("5", "response", None), ("None", "revisit", 1)]


def test_html_language_quality_edges(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "start")
    assert html_text.extract(spark, pages).count() == docs.count()
    got = language.identify(spark, docs).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4)} == {"und"}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(spark, docs, labels).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.5}
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, None), (None, "same text"), (3, "..."), (4, "same text")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark, docs, bench).collect()}
    assert got == {(10, 1), (1, 4), (2, 4), (None, 4)}
    assert decontaminate.leaks(spark, docs, bench.limit(0)).count() == 0


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    made = [exact_dedup.exact_dedup(spark, none), jaccard_join.jaccard_components(spark, none), token_files.token_files(spark, none), packing.pack(spark, none), warc.archive_round_trip(spark, pages), html_text.extract(spark, pages), language.identify(spark, none), quality.quality(spark, none, labels), decontaminate.leaks(spark, none, bench), pii.digest(pii.find_pii(none))]
    assert [df.count() for df in made] == [0] * 10


def test_pii_edges(spark):
    texts = ["", None, "a@b.c.d_e@f.gh é mail x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4539 1488 0343 6467", "4539148803436468", "+1 (555) 555-5555, +123", "x@" + "a." * 5000 + "b", "1 " * 9000, "9" * 50_000, "IBAN DE89 3704 0044 0532 0130 00", "a@b.cc@d.e", "+1234567-", chr(0xE000) + "x@y.z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(df)).collect()}
    con = duckdb.connect()
    con.register("t", df.toPandas())
    con.execute("CREATE VIEW documents AS SELECT doc_id, text FROM t")
    res = con.execute(pii.SQL)
    names = [d[0] for d in res.description]
    for row in res.fetchall():
        assert dict(zip(names, row, strict=True)) == got[row[0]].asDict()
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["n_card"] == 1 and got[5]["n_card"] == 0
    assert got[10]["n_iban"] == 1 and got[3]["n_ip"] == 3


@pytest.mark.parametrize("name", ["op1_pii", "op3_warc", "op5_exact_dedup", "op6_jaccard_join"])
def test_queries_match_duckdb(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    res = con.execute(entry.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(res.description)}
    assert sorted(at) == columns
    assert same([tuple(r[c] for c in columns) for r in df.collect()], [tuple(r[at[c]] for c in columns) for r in res.fetchall()])


def test_held_out_accuracy(spark, sf):
    """Held-out accuracy on the tables themselves."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.quality(spark, docs, labels).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.93


def test_pipeline_against_brute_force(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [d for d in docs if any(c.isalpha() for c in d["text"] or "")]
    last = {d["text"]: d["doc_id"] for d in kept}
    kept = [d for d in kept if last[d["text"]] == d["doc_id"]]
    low = {i: c for i, _, c in brute_components([(d["doc_id"], d["text"]) for d in kept])}
    kept = [d for d in kept if low[d["doc_id"]] == d["doc_id"]]

    def leaks(text):
        words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
        for item in bench:
            p = "".join(c.lower() if c.isalnum() else " " for c in item).split()
            if p and set(p) & set(words):
                row = [0] * (len(words) + 1)
                for i, x in enumerate(p):
                    new = [i + 1]
                    for j, w in enumerate(words):
                        new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != w)))
                    row = new
                if min(row) <= int(0.2 * len(p) + 1e-9):
                    return True
        return False

    suspects = [d for d in kept if d["n_chars"] < 3000]
    expected = {d["doc_id"] for d in suspects if not leaks(d["text"])}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert got <= {d["doc_id"] for d in kept}
    assert {i for i in got if i in {d["doc_id"] for d in suspects}} == expected
    assert os.path.isdir(sf)
