"""Units of the operators against plain Python."""

import html
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

from scholium.llm import decontaminate, html_text, jaccard_join, language, packing, pii, warc
from scholium.llm.exact_dedup import CuckooIndex
from scholium.llm import quality as quality_module
from scholium.llm.quality import features, fit_quality
from scholium.llm.quality import quality as score_quality
from scholium.llm.tokens import encoder, vocabulary_path


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    plain.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = "ab'stmdrevl  \n\t .,-12éß²½ª\xa0\x85\x1c_'日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", "'s", "<|endoftext|>", "x" * 70_000, "a"]
    assert [x.tolist() for x in encoder().encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert encoder().encode([]) == []


def test_cuckoo_insert_delete_resize():
    rng = random.Random(2)
    index, live = CuckooIndex(4), {}
    keys = [rng.randbytes(32) for _ in range(3000)]
    for k in keys + rng.choices(keys, k=2000):
        if k in live and rng.random() < 0.5:
            assert index.delete(k)[1] == live.pop(k)
        elif k not in live:
            live[k] = rng.random()
            index.insert(k, live[k])
    assert index.resizes > 3 and index.size == len(live)
    assert all((index.get(k) or [None, None])[1] == live.get(k) for k in keys)
    assert index.delete(b"\0" * 32) is None


@pytest.mark.parametrize("count", [1, 2, 3, 40, 400])
def test_packing_windows(count):
    rng = random.Random(count)
    for most in (20, 700, 2048):
        sizes = [rng.randint(1, most) for _ in range(count)]
        bins = packing.pack_pieces(sizes, 2048, 8)
        assert max(sum(b - a for _, a, b in members) for members in bins) <= 2048
        at = [0] * count
        for i, a, b in sorted(p for members in bins for p in members):  # every id once
            assert a == at[i] and b > a
            at[i] = b
        assert at == sizes
        assert len(bins) <= -(-sum(sizes) // 2048) + 1 and sum(map(len, bins)) <= count + 3 * len(bins)
    assert packing.pack_pieces([], 2048, 8) == [] and packing.pack_pieces([5], 2048, 8) == [[(0, 0, 5)]]
    assert len(packing.pack_pieces([2048] * 3, 2048, 8)) == 3
    loads = sorted(sum((8, 7, 6, 5, 4)[i] for i in b) for b in packing.differencing([8, 7, 6, 5, 4], 2))
    assert loads == [14, 16]  # Karmarkar and Karp's own example


def test_encoder_tells_words_of_one_hash_apart():
    """Thue-Morse words and their complements collide under any polynomial hash modulo a power of two."""
    from tokenizers import Tokenizer

    word = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    plain = Tokenizer.from_file(vocabulary_path())
    texts = [word, other, f"x {other} y {word}", other]
    for some in (texts, texts[1:], texts[:1]):
        assert [x.tolist() for x in encoder().encode(some)] == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]


def brute_edits(pattern, text):
    best = (len(pattern), 0)
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (p != c)))
        row = new
    return min(min(row), best[0])


def test_semi_global():
    rng = np.random.default_rng(4)
    for _ in range(200):
        p, t = rng.integers(0, 4, rng.integers(1, 8)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint64)
        assert decontaminate.semi_global(p, t)[0] == brute_edits(p.tolist(), t.tolist())


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1])
def test_leak_recall(share):
    """Edited passages inside other text are found, against brute force."""
    rng = np.random.default_rng(5)
    items = [(k, rng.integers(1, 1 << 60, n).astype(np.uint64)) for k, n in enumerate(rng.integers(6, 60, 40))]
    plan = decontaminate.Plan(items, 0.8, 4, decontaminate._repeats(4, 0.6, 0.99), 7)
    texts, planted = [], []
    for k, words in items:
        words = words.copy()
        n = int(share * len(words))
        for at in rng.choice(len(words), n, replace=False):
            words[at] = rng.integers(1, 1 << 60)
        if n:
            words = np.delete(words, 0)
            n += 1
        planted.append(n <= plan.edits(len(items[k][1])))
        texts.append(np.concatenate([rng.integers(1, 1 << 60, 50).astype(np.uint64), words, rng.integers(1, 1 << 60, 30).astype(np.uint64)]))
    found = plan.matches(texts)
    expected = [(k, brute_edits(items[k][1].tolist(), texts[k].tolist())) for k in range(len(items))]
    assert all(d <= plan.edits(len(items[k][1])) for (k, d), p in zip(expected, planted, strict=True) if p)
    hits = sum(any(m[0] == k for m in found[k]) for k, p in enumerate(planted) if p)
    assert hits >= 0.95 * sum(planted)
    assert all(m[1] == dict(expected)[m[0]] for k in range(len(items)) for m in found[k] if m[0] == k)
    assert plan.matches([rng.integers(1, 1 << 60, 500).astype(np.uint64), np.zeros(0, np.uint64)]) == [[], []]


@pytest.mark.parametrize("kind", ["deletions", "insertions", "substitutions"])
@pytest.mark.parametrize("n", [16, 40, 58, 100, 200])
def test_leak_recall_at_the_limit(n, kind):
    """Items with as many edits as the operator allows are found, against brute force."""
    rng = np.random.default_rng([n, len(kind)])
    items = [(k, rng.integers(1, 1 << 60, n).astype(np.uint64)) for k in range(60)]
    plan = decontaminate.Plan(items, 0.8, 4, 64, 7)
    edits, texts = plan.edits(n), []
    for _, words in items:
        if kind == "deletions":
            words = np.delete(words, rng.choice(n, edits, replace=False))
        elif kind == "insertions":
            words = np.insert(words, np.sort(rng.integers(0, n + 1, edits)), rng.integers(1, 1 << 60, edits).astype(np.uint64))
        else:
            words = words.copy()
            words[rng.choice(n, edits, replace=False)] = rng.integers(1, 1 << 60, edits)
        texts.append(np.concatenate([rng.integers(1, 1 << 60, 70).astype(np.uint64), words, rng.integers(1, 1 << 60, 50).astype(np.uint64)]))
    for k in range(0, len(items), 20):
        assert brute_edits(items[k][1].tolist(), texts[k].tolist()) <= edits
    hits = sum(any(m[0] == k for m in found) for k, found in enumerate(plan.matches(texts)))
    assert hits >= 0.98 * len(items)


def test_region_links_connect_what_brute_force_connects():
    rng = random.Random(6)
    sets = []
    for _ in range(6):
        base = rng.sample(range(1, 10_000), 60)
        for _ in range(12):
            drop = rng.sample(base, rng.randint(0, 12))
            sets.append(np.array(sorted(set(base) - set(drop) | set(rng.sample(range(10_000, 20_000), rng.randint(0, 8)))), np.uint64))

    def components(links):
        c = jaccard_join.Components(len(sets))
        for a, b in links:
            c.join(a, b)
        return [c.root(k) for k in range(len(sets))]

    every = [(a, b) for a, b in combinations(range(len(sets)), 2) if jaccard_join.linked(sets[a], sets[b], 80)]
    assert 0 < len(every)
    assert components(jaccard_join.region_links(sets, 80)) == components(every)


def test_main_text():
    page = "<html><head><title>x</title></head><body><header>Top</header><nav><p>Menu text</p></nav><div class='cookie'>c</div><article><h1>A&amp;B</h1><p>one <b>two</b>\n three<p>five</p><div class='ad'>buy</div></article><section class='comments'><p>nice</p></section><footer>f</footer>"
    assert html_text.main_text(page) == "A&B\n\none two three\n\nfive"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""
    assert html_text.main_text("<p>" + "a " * 50_000) == ("a " * 50_000).strip()


def test_warc_record_and_keys():
    body = "<p>é</p>".encode()
    fields, http, payload = warc.parse_record(warc.make_record(7, "http://A.example.org:80/x y?q=1", body, warc.sha1_base32(body), None, False, "2000-01-01T00:00:00Z", 0))
    assert payload == body and fields["X-Page-Id"] == "7" and http["Content-Length"] == str(len(body))
    assert warc.url_key("http://A.example.org:80/x?q=1") == "org,example,a:80)/x?q=1"
    assert warc.url_key(None) == "-" and warc.url_key("http://[bad") == "http://[bad"


def test_quality_ranking():
    good, bad = ["This is a plain sentence with words. Another one follows here."] * 20, ["x x x x x x x x"] * 20
    x = np.stack([features(t) for t in good + bad]).astype(float)
    model = fit_quality(x, np.array([1] * 20 + [0] * 20), 0.5, pairs=500, steps=50)
    assert model.score(good[:1])[0] > 0.5 > model.score(bad[:1])[0]
    assert fit_quality(x, np.ones(40), 0.0).score(["", "a"]).tolist() == [0.5, 0.5]
    assert np.isfinite(features("")).all()


def test_pipeline_decides_by_row(spark):
    """Null and shared ids: clean rows stay beside leaking and near-copy rows, and one row of a component stays."""
    rng = random.Random(8)

    def text(n=40):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))

    item, near, alike, shared = text(20), text(), text(), text()
    clean = [(None, text()), (7, text()), (9, text()), (None, ""), (None, "")]
    rows = [
        *clean,
        (None, text(10) + " " + item), (7, item),  # leaks beside clean rows of the same id
        (3, near), (None, near + " end"), (9, near + " stop"),  # near copies: id 3 stays
        (None, alike), (None, alike + " end"), (None, alike + " stop"),  # one of them stays
        (5, shared), (5, shared + " end"),  # one of them stays
        (6, "same row " + alike[:9]), (6, "same row " + alike[:9]),  # equal in id and text: one stays
    ]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(rows, schema)
    got = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_representatives(spark, docs).collect()]
    for row in [*clean, rows[5], rows[6], (3, near), rows[15]]:
        assert got.count(row) == (2 if row == (None, "") else 1), row
    assert sum(i is None and t.startswith(alike) for i, t in got) == 1
    assert sum(i == 5 for i, _ in got) == 1
    assert len(got) == 11
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in decontaminate.drop_leaks(spark, docs, bench).collect()]
    assert sorted(left, key=str) == sorted((r for r in rows if item not in r[1]), key=str)


def test_every_language_is_learned(spark):
    names = [f"l{k}" for k in range(70)]
    rows = [(100 * k + j, f"text of {n}", n) for k, n in enumerate(names) for j in range(8 if k < 64 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.training_sample(docs, 210)[1]) == set(names)
    assert set(language.training_sample(docs, 10)[1]) == set(names)


def test_uncertain_languages_go_and_unlabelled_corpora_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert language.keep_identified(spark, docs).count() == docs.count()  # clean documents stay
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(spark, bare).count() == docs.count()
    model = language.fit_languages(*language.training_sample(docs, 2000))
    rng = random.Random(2)
    junk = ["".join(rng.choice("qxzjkvwyñéß ") for _ in range(60)) for _ in range(3000)]
    score = model.decide(junk, language.Grams())[1]
    sure, unsure = [t for t, s in zip(junk, score) if s >= 0.3], [t for t, s in zip(junk, score) if s < 0.3]
    assert sure and unsure
    rows = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(unsure + sure)], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang").unionByName(rows, allowMissingColumns=True)
    assert language.keep_identified(spark, both).count() == docs.count() + len(sure)


def test_all_articles_of_a_page_are_its_text():
    one, two, three = ("The first part is told here at some length. " * 3).strip(), "A short second part.", ("And more of it follows in the third. " * 5).strip()
    page = f"<body><nav>Home</nav><article><p>{one}</p></article><article><p>{two}</p></article><p>outside</p><article><p>{three}</p></article><footer>end</footer></body>"
    assert html_text.main_text(page) == "\n\n".join([one, two, three])
    page = f"<body><nav>Home</nav><main><p>{two}</p><article><p>{one}</p></article><aside>see also</aside><p>{three}</p></main></body>"
    assert html_text.main_text(page) == "\n\n".join([two, one, three])


def test_training_takes_long_texts_and_one_text_of_an_id(spark):
    rows = [(1, "a " * 60_000, "l1"), (3, "b c", "l2"), (3, "b a", "l2"), (3, "b a", "l2"), (None, "z", "l2"), (4, None, "l3"), (5, "12", "l4")]
    x, langs = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100)
    assert langs == ["l1", "l2"] and x.shape[0] == 2
    expected = next(language.gram_counts(["b a"]))
    assert x[1].nonzero()[0].tolist() == expected[0].tolist()


def test_one_versus_one_votes():
    """The vote's winner against counting by hand."""
    rng = np.random.default_rng(3)
    labels = ["a", "b", "c", "d"]
    pairs = list(combinations(range(4), 2))
    vote = language.Vote(labels, pairs, list(range(6)))
    for _ in range(50):
        chance = rng.random(6)
        got = {k: 0.0 for k in range(4)}
        for (i, j), p in zip(pairs, chance):
            got[i] += p
            got[j] += 1 - p
        best = max(got, key=lambda k: (got[k], -k))
        assert language.LanguageModel._best(vote, chance) == (labels[best], pytest.approx(got[best] / 3))


def test_quality_threshold_is_the_quantile():
    """At the threshold, as large a share of the training rows is below as label 0 has."""
    rng = np.random.default_rng(4)
    y = np.repeat([1, 0], [60, 40])
    x = rng.normal(size=(100, 5)) + y[:, None]
    model = fit_quality(x, y, 0.4, pairs=2000, steps=60)
    assert abs((model.strength(x) < model.threshold).mean() - 0.4) <= 0.02
    same = fit_quality(np.ones((10, 3)), np.array([1, 0] * 5), 0.5, pairs=50, steps=5)  # ties only
    assert np.isfinite(same.strength(np.ones((1, 3)))).all()


def test_quality_of_repeated_ids(spark):
    rows = [(k, f"This is sentence {k} of a text. It ends here.") for k in range(0, 60)] + [(0, "x x x x")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = [r["score"] for r in score_quality(spark, docs, labels).filter("doc_id = 0").collect()]
    assert len(got) == 51 and len(set(got)) <= 2  # equal texts, equal scores


def test_quality_learns_from_every_labelled_row(spark):
    """5000 labelled rows, more than any bucket or former sample: the model has the means of all, and the optimum over pairs."""
    rows = [(k, ("This is a plain sentence. " if k % 3 else "x | x ") * (1 + k % 7)) for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    labels = spark.createDataFrame([(k, int(k % 3 > 0) if k % 10 else k % 2, 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    described = docs.mapInPandas(quality_module._featurize, "doc_id long, held_out boolean, x binary")
    model = quality_module.fit_from_labels(spark, described, labels, size=500)
    own = [(features(t).astype(float), int(k % 3 > 0) if k % 10 else k % 2) for k, t in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    x, y = np.array([f for f, _ in own]), np.array([q for _, q in own])
    assert len(x) > 4000 and model.mean == pytest.approx(x.mean(0), rel=1e-5, abs=1e-6)
    s = np.sort(model.strength(x))
    k = int((y == 0).sum())
    assert model.threshold == pytest.approx((s[k - 1] + s[k]) / 2, abs=1e-6)
    n, _, gradient, _ = quality_module.pair_sums(quality_module.expand((x - model.mean) * model.scale), y, model.weights)
    assert np.abs(gradient / n + 3e-3 * model.weights).max() < 0.02  # of all pairs; buckets take their own


def test_quality_passes_over_many_partitions(spark):
    """61 shuffle partitions that stay apart, as on a cluster: each pass is one job, not one for each partition, and the model is the same."""
    rows = [(k, ("This is a plain sentence. " if k % 3 else "x | x ") * (1 + k % 7)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    labels = spark.createDataFrame([(k, int(k % 3 > 0) if k % 10 else k % 2, 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    described = docs.mapInPandas(quality_module._featurize, "doc_id long, held_out boolean, x binary")
    few = quality_module.fit_from_labels(spark, described, labels, size=50)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("many", "passes over 61 partitions")
    try:
        many = quality_module.fit_from_labels(spark, described, labels, size=50)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("many")) < 110  # up to 30 passes, 2 jobs each with a shuffle
    assert many.weights == pytest.approx(few.weights, abs=1e-6) and many.threshold == pytest.approx(few.threshold, abs=1e-6)


def test_quality_of_large_groups_of_equal_rows(spark):
    """Two ids of 3000 equal rows each, in six buckets: every bucket gets rows of both, whichever the hashes are."""
    one, *others = [k for k in range(12) if zlib.crc32(str(k).encode()) % 3 != 1]
    for other in others[:3]:
        docs = spark.createDataFrame([(one, "A plain text. It ends.")] * 3000 + [(other, "x | x")] * 3000, "doc_id long, text string")
        labels = spark.createDataFrame([(one, 1, 0), (other, 0, 0)], "doc_id long, quality int, toxic int")
        got = score_quality(spark, docs, labels).groupBy("doc_id", "predicted").count().collect()
        assert {tuple(r) for r in got} == {(one, 1, 3000), (other, 0, 3000)}


def test_sums_of_many_tasks(spark):
    """Sums of one task, of a few and of many, some of them empty."""
    rows = spark.range(300).select(F.col("id").cast("double").alias("x"))

    def sums(batches):
        import pandas as pd

        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"sums": [np.array([len(batch), batch["x"].sum()]).tobytes()]})

    for tasks in (1, 16, 17, 70):
        assert quality_module._summed(rows.repartition(tasks).mapInPandas(sums, "sums binary"), tasks).tolist() == [300, 44850]


def plain_article(page):
    """Words of the article by cutting strings: marked elements out, tags out, references decoded."""
    body = re.search(r"<article[^>]*>(.*?)</article>", page, re.S).group(1)
    body = re.sub(r"<!--.*?-->", " ", body, flags=re.S)
    for name in ("script", "style", "nav", "aside", "form", "footer"):
        body = re.sub(rf"<{name}\b.*?</{name}>", " ", body, flags=re.S)
    body = re.sub(r'<(div|section|ul|p)\b[^>]*class="[^"]*\b(ad|ads|comments?|share|related|newsletter|cookie|sidebar)\b[^"]*"[^>]*>.*?</\1>', " ", body, flags=re.S)
    inline = re.compile(r"</?(?:a|b|i|em|strong|span|code|u|s|small|sub|sup|mark)\b[^>]*>")
    return html.unescape(re.sub(r"<[^>]*>", " ", inline.sub("", body))).split()


def test_main_text_of_every_page_against_string_cutting(sf):
    import pyarrow.parquet as pq

    for page in pq.read_table(f"{sf}/pages.parquet", columns=["html"])["html"].to_pylist():
        if page:
            assert html_text.main_text(page).split() == plain_article(page)


STORY = "".join(f"<p>{'The story goes on with many plain words here. ' * 3}</p>" for _ in range(6))
TEASERS = "".join("<article><h2><a href='/x'>More</a></h2><ul><li><a>a</a></li><li><a>b</a></li></ul></article>" for _ in range(8))


def test_ratios_choose_the_region(monkeypatch):
    """Teasers in article elements lose to a dense story outside; without the ratios they win."""
    page = f"<body><div id='story'><h1>Title</h1>{STORY}</div><div>{TEASERS}</div></body>"
    text = html_text.main_text(page)
    assert text.startswith("Title\n\nThe story") and "More" not in text
    with monkeypatch.context() as m:
        m.setattr(html_text, "smoothed_ratios", lambda lines: np.array([float("story" not in x.text) for x in lines]))
        assert "More" in html_text.main_text(page) and "story" not in html_text.main_text(page)


def test_pages_cost_in_proportion_to_their_depth():
    began = time.process_time()
    assert html_text.main_text("<div>x" * 20_000).count("x") >= 18_000  # the region holds nine tenths
    html_text.main_text("<b>" * 20_000 + "<h1>a</h1>" * 20_000)
    html_text.main_text("<td><b>x</i><p>" * 20_000)
    assert time.process_time() - began < 40


def test_pii_context_decides_and_dense_texts_are_linear(spark):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = {
        1: "iban DE89370400440532013000 OK", 2: "pay DE89 3704 0044 0532 0130 00 PLEASE PAY NOW",
        3: "for example DE89370400440532013000 here", 4: "example bank account DE89370400440532013000", 5: "iban DE89370400440532013001",
        6: "ssn 123-45-6789 and 666-11-1111", 7: "no. 123-45-6789", 8: f'token = "{token}"', 9: f"commit {token}",
        10: "IMEI 490154203237518 or 490154203237519", 11: "example a@b.cd",
    }
    dense = " ".join(f"user{i}@mail{i}.example.com" for i in range(20_000))
    df = spark.createDataFrame([*texts.items(), (0, dense)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(df)).collect()}
    assert time.time() - began < 90
    spans = {k: r["spans"] for k, r in got.items() if k}
    assert spans == {1: "iban:5:27", 2: "iban:4:31", 3: "", 4: "iban:21:43", 5: "", 6: "ssn:4:15", 7: "", 8: "secret:9:49", 9: "", 10: "imei:5:20", 11: "email:8:14"}
    assert got[0]["n_email"] == 20_000
    start, end = map(int, got[0]["spans"].rsplit(":", 2)[1:])
    assert dense[start:end] == "user19999@mail19999.example.com"


def families(rng, count, size, words=60):
    sets = []
    for _ in range(count):
        base = rng.sample(range(1, 10**6), words)
        for _ in range(size):
            drop = rng.sample(base, rng.randint(0, words // 5))
            sets.append(np.array(sorted(set(base) - set(drop) | set(rng.sample(range(10**6, 10**7), rng.randint(0, words // 8)))), np.uint64))
    return sets


def test_linked_sets_meet_in_a_voronoi_cell():
    rng = random.Random(12)
    sets = families(rng, 5, 12)
    for pivots in (sets[::7], sets[:3], sets[:1], [np.array([1], np.uint64)]):
        far, cells = jaccard_join.voronoi(sets, pivots, 80)
        held = {}
        for k, p in cells:
            held.setdefault(k, set()).add(p)
        assert set(held) == set(range(len(sets)))
        for a, b in combinations(range(len(sets)), 2):
            d = 1 - len(set(sets[a].tolist()) & set(sets[b].tolist())) / len(set(sets[a].tolist()) | set(sets[b].tolist()))
            if d <= 0.2:
                assert held[a] & held[b]
        both = [len(set(x.tolist()) & set(pivots[0].tolist())) for x in sets]
        assert far.tolist() == pytest.approx([1 - n / (len(x) + len(pivots[0]) - n) for n, x in zip(both, sets)])


@pytest.mark.parametrize("size", [4, 16])
def test_large_regions_split_into_cells(spark, size):
    """One region of many families: cells for those apart, balls for dense ones, and the links of brute force."""
    rng = random.Random(size)
    texts = []
    for family in range(48 // size):
        base = [f"w{family}x{i}" for i in range(40)]
        texts += [" ".join(f"e{rng.randrange(10**6)}" if rng.random() < 0.012 else w for w in base) for _ in range(size)]
    texts = list({jaccard_join.fingerprint(x): t for x, t in zip(jaccard_join.shingle_sets(texts), texts)}.values())  # a node is one set
    sets = list(jaccard_join.shingle_sets(texts))
    nodes = [jaccard_join.fingerprint(x) for x in sets]
    members = spark.createDataFrame([(1, n, t) for n, t in zip(nodes, texts)], "region long, node long, text string")
    links, left = jaccard_join._large_regions(spark, members, 80, 10, 16)
    assert left.groupBy("region").count().agg(F.max("count")).first()[0] <= 10
    found = [(r["u"], r["v"]) for df in links for r in df.collect()]
    for r in left.groupBy("region").agg(F.collect_list("node").alias("nodes")).collect():
        own = [nodes.index(n) for n in r["nodes"]]
        found += [(nodes[own[a]], nodes[own[b]]) for a, b in jaccard_join.region_links([sets[k] for k in own], 80)]

    def components(pairs):
        c = jaccard_join.Components(len(sets))
        for a, b in pairs:
            c.join(a, b)
        return [c.root(k) for k in range(len(sets))]

    at = {n: k for k, n in enumerate(nodes)}
    every = [(a, b) for a, b in combinations(range(len(sets)), 2) if jaccard_join.linked(sets[a], sets[b], 80)]
    assert components((at[u], at[v]) for u, v in found) == components(every)


def test_dense_region_gives_up_many_balls_a_round(spark, monkeypatch):
    """Thirty tight families that no cells part: few rounds, so that the driver plans few jobs, and no link is lost."""
    common, texts = [f"c{i}" for i in range(160)], []
    for family in range(30):
        base = common + [f"w{family}x{i}" for i in range(60)]
        texts += [" ".join([*base, f"e{family}x{k}"]) for k in range(6)]
    sets = list(jaccard_join.shingle_sets(texts))
    nodes = [jaccard_join.fingerprint(x) for x in sets]
    rounds, assign = [], jaccard_join._assign
    monkeypatch.setattr(jaccard_join, "_assign", lambda percent: rounds.append(1) or assign(percent))
    members = spark.createDataFrame([(1, n, t) for n, t in zip(nodes, texts)], "region long, node long, text string")
    links, left = jaccard_join._large_regions(spark, members, 80, 20, 64)
    assert len(rounds) <= 8  # one ball a round: 27
    c, at = jaccard_join.Components(len(sets)), {n: k for k, n in enumerate(nodes)}
    for u, v in [(r["u"], r["v"]) for df in links for r in df.collect()]:
        c.join(at[u], at[v])
    for r in left.groupBy("region").agg(F.collect_list("node").alias("nodes")).collect():
        own = [at[n] for n in r["nodes"]]
        for a, b in jaccard_join.region_links([sets[k] for k in own], 80):
            c.join(own[a], own[b])
    every = jaccard_join.Components(len(sets))
    for a, b in combinations(range(len(sets)), 2):
        if jaccard_join.linked(sets[a], sets[b], 80):
            every.join(a, b)
    assert [c.root(k) for k in range(len(sets))] == [every.root(k) for k in range(len(sets))]


def test_patterned_words_have_different_hashes():
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = jaccard_join.shingle_sets([word, other])
    assert a[0] != b[0]
