"""Brute force, edge cases and the guarantees that small tables don't show by themselves."""

import hashlib
import itertools
import os
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_training_operators import PATH, by_id, crc, frame, plain_ids  # noqa: F401

import corpus_pipeline
from rollweave.llm import chat, common, decontam, exact_dedup, html_extract, licences, oracles, packing, quality, queries, repair, simhash, toxicity

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


# -- scratch tables and batches -----------------------------------------------------------------------------------------


def test_scratch_tables_go_with_their_block(spark):
    def there(df):
        return os.path.isdir(df._stored_at.removeprefix("file://"))

    with common.temporary():
        outer = common.store(spark.range(3), "t")
        with common.temporary():
            inner, kept = common.store(spark.range(4), "t"), common.store(spark.range(5), "t", keep=True)
            assert there(inner)
        assert not there(inner) and there(kept) and kept.count() == 5
    assert not there(outer) and not there(kept)
    with pytest.raises(ZeroDivisionError), common.temporary():
        failed = common.store(spark.range(3), "t")
        1 / 0
    assert not there(failed)
    with common.temporary():
        with common.temporary():
            again = common.keep(common.store(spark.range(6), "t"), "t")
            other = common.keep(spark.range(7), "t")
        assert there(again) and there(other) and again.count() == 6
    left = common.store(spark.range(3), "t")
    common.discard(spark.range(2))
    assert there(left)
    common.discard(left)
    assert not there(left)
    common.store(spark.range(3), "t")
    common.release(spark)
    assert common._blocks == [[]]


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    hinted = lambda df, *of: "Broadcast" in spark.range(9).hint("merge").join(common.small(df, *of), "id")._jdf.queryExecution().analyzed().toString().replace("strategy=broadcast", "Broadcast")
    df = common.store(spark.range(1000), "t")
    assert hinted(df) and hinted(df.withColumn("x", F.lit(1)), df)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 999)
    assert not hinted(df)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    assert not hinted(df)


def test_chunks():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 100})
    sizes = lambda *batches, **limits: [c.num_rows for c in common.chunks(batches, **limits)]
    assert sizes(batch, rows=30) == [30, 30, 30, 10] and sizes(batch, batch, rows=150) == [150, 50]
    assert sizes(batch, size=10_500)[:2] == [10, 10] and sizes(batch, size=1) == [1] * 100
    assert sizes(batch.slice(0, 0)) == [] and sizes(batch.slice(0, 3), batch.slice(0, 0), batch.slice(3, 4)) == [7]
    assert pa.Table.from_batches(common.chunks([batch.slice(0, 41), batch.slice(41)], rows=17)).to_pydict() == batch.to_pydict()


def test_session_settings_stay(spark):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    simhash.components(frame(spark, ["a b", "c"])).collect()
    packing.pack_documents(frame(spark, ["a b", "c"]), PATH).collect()
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


# -- toxicity and quality -----------------------------------------------------------------------------------------------


def plain_risk(w, pos, unl, prior, decay):
    """The objective whose slope the gradient is, by loops over texts: the non-negative risk, or the part that climbs."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    sp = [sigmoid(w[-1] + sum(w[f] for f in t)) for t in pos]
    su = [sigmoid(w[-1] + sum(w[f] for f in t)) for t in unl]
    mean = lambda xs: sum(xs) / len(xs)
    negative = mean(su) - prior * mean(sp)
    ridge = decay * prior * sum(x * x for x in w[:-1]) / 2 / max(1, len(w) - 1)
    return negative, (prior * mean([1 - s for s in sp]) + negative if negative >= 0 else -negative) + ridge


def test_gradient_of_the_non_negative_risk():
    rng = np.random.default_rng(5)
    signs = set()
    for bias, prior in itertools.product((-3.0, 0.5, 2.0), (0.1, 0.6)):
        pos = [list(rng.choice(6, rng.integers(0, 5), replace=False)) for _ in range(7)]
        unl = [list(rng.choice(6, rng.integers(0, 3), replace=False)) for _ in range(20)]
        if prior > 0.5:
            unl = [[] for _ in unl]
        w = np.append(rng.normal(1, 1, 6), bias)
        pairs = [(np.repeat(np.arange(len(x)), [len(t) for t in x]), np.array([f for t in x for f in t], int)) for x in (pos, unl)]
        got = toxicity.gradient(w, pairs[0], len(pos), pairs[1], len(unl), prior, 0.01)
        signs.add(plain_risk(w, pos, unl, prior, 0.01)[0] >= 0)
        for i in range(7):
            step = np.eye(7)[i] * 1e-6
            slope = (plain_risk(w + step, pos, unl, prior, 0.01)[1] - plain_risk(w - step, pos, unl, prior, 0.01)[1]) / 2e-6
            assert got[i] == pytest.approx(slope, abs=1e-6)
    assert signs == {True, False}


def test_features_are_counted_over_all_texts(spark):
    texts = ["Bad badly badge", "bad", None, "", "xbad badminton", "bad " * 50_000]
    index = {"bad": 0, "badl-": 1, "badm-": 2, "badmi-": 3, "none": 4}
    counts, n = toxicity.feature_counts(frame(spark, texts * 3).repartition(4), index)
    want = [sum(f in toxicity.features(t) for t in texts) * 3 for f in index]
    assert counts.tolist() == want == [9, 3, 3, 3, 0] and n == 18
    assert toxicity.feature_counts(frame(spark, texts).limit(0), index)[1] == 0


@needs_data
def test_toxicity_query_against_its_model(spark):
    docs = queries.table(spark, SF, "documents")
    model = toxicity.learn(docs, queries.table(spark, SF, "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op1_toxicity(spark, SF).collect():
        found = toxicity.features(text[r.doc_id])
        logit = model.bias + sum(x for f, x in model.weights.items() if f in found)
        assert r.score == pytest.approx(1 / (1 + np.exp(-logit))) and r.predicted == (r.score >= 0.7)


def posteriors(rows, parent_mean, key, parent):
    """Shrunk rates of groups: moments by loops. ``rows``: (p, host, path); ``parent``: a group's parent rate."""
    groups = {}
    for p, *names in rows:
        groups.setdefault(key(names), []).append(p)
    total = sum(map(len, groups.values()))
    between = sum(len(g) * (sum(g) / len(g) - parent(k)) ** 2 for k, g in groups.items()) / total
    within = sum(max(0.0, sum(x * x for x in g) / len(g) - (sum(g) / len(g)) ** 2) for g in groups.values()) / total
    spread = between - within
    strength = min(max(parent_mean * (1 - parent_mean) / spread - 1 if spread > 0 else 1e6, 1.0), 1e6)
    return {k: (strength * parent(k) + sum(g)) / (strength + len(g)) for k, g in groups.items()}


@needs_data
def test_quality_query_against_loops(spark):
    docs = {r.doc_id: (r.source or "", r.lang or "") for r in queries.table(spark, SF, "documents").collect()}
    got = by_id(queries.op7_quality(spark, SF))
    rows = [(1 / (1 + np.exp(-r.evidence)), *docs[d]) for d, r in got.items()]
    mean = sum(p for p, *_ in rows) / len(rows)
    hosts = posteriors(rows, mean, lambda n: n[0], lambda k: mean)
    paths = posteriors(rows, mean, lambda n: tuple(n), lambda k: hosts[k[0]])
    logit = lambda p: np.log(p / (1 - p))
    for d, r in got.items():
        assert r.host_rate == pytest.approx(hosts[docs[d][0]]) and r.path_rate == pytest.approx(paths[docs[d]])
        score = 1 / (1 + np.exp(-(r.evidence - logit(mean) + logit(paths[docs[d]]))))
        assert r.score == pytest.approx(score) and r.keep == (r.score >= 0.5)


def test_hosts_and_paths_of_urls(spark):
    urls = {
        "https://www.Example.org:8080/News/2024?x=1": ("example.org", "News"), "http://user:pw@a.b/": ("a.b", ""), "https://a.b": ("a.b", ""),
        "ftp://a.b/c#d": ("a.b", "c"), "no url": ("", ""), "": ("", ""), None: (None, None),
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").coalesce(1)
    assert [tuple(r) for r in df.select(quality.host_of(F.col("u")), quality.path_of(F.col("u"))).collect()] == list(urls.values())
    docs = df.select(F.monotonically_increasing_id().alias("doc_id"), F.lit("some text").alias("text"), "u").union(spark.createDataFrame([(9, "t " * 90_000, None), (9, None, "x")], "a long, b string, c string"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, none, quality.host_of(F.col("u")), quality.path_of(F.col("u"))).count() == 9


# -- pages --------------------------------------------------------------------------------------------------------------


class Article(HTMLParser):
    """Blocks of the one article of a test page, by the standard library's parser."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "ol", "div", "section", "article", "blockquote", "pre", "table", "tr", "td", "th", "figure", "figcaption"}
    OUT = {"script", "style", "nav", "aside", "header", "footer", "form", "button"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.text, self.blocks = 0, 0, "", []

    def flush(self):
        if text := " ".join(self.text.split()):
            self.blocks.append(text)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        bad = tag in self.OUT or dict(attrs).get("class") == "ad"
        if tag == "article" and not self.out:
            self.depth += 1
        if self.out or bad:
            self.out += tag not in ("br", "img", "input", "meta", "link", "hr")
        if tag in self.BLOCKS or bad:
            self.flush()
        elif tag == "br":
            self.text += " "

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        if self.out:
            self.out -= 1
        elif tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.out:
            self.text += data


@needs_data
def test_pages_against_the_standard_parser(spark):
    got = {r.page_id: r for r in queries.op6_main_text(spark, SF).collect()}
    pages = queries.table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = Article()
        article.feed(r.html or "")
        article.close()
        assert got[r.page_id].text == "\n".join(article.blocks) and got[r.page_id].n_chars == len(got[r.page_id].text)


@needs_data
def test_regions_decide_on_every_page(spark, monkeypatch):
    pages = [r.html for r in queries.table(spark, SF, "pages").collect()]
    texts = [html_extract.main_text(h) for h in pages]
    monkeypatch.setattr(html_extract, "regions", lambda lengths, *_: [])
    assert sum(html_extract.main_text(h) != t for h, t in zip(pages, texts)) > 0.9 * len(pages)
    monkeypatch.setattr(html_extract, "regions", lambda lengths, *_: [(0, len(lengths))])
    # what only the sums leave out: three left-out elements in a row end the text of a page
    page = f"<article><p>{'word ' * 50}</p>{'<div class=ad>Buy</div>' * 3}<p>Tags: a</p></article>"
    assert html_extract.main_text(page).endswith("Tags: a")
    monkeypatch.undo()
    assert html_extract.main_text(page) == ("word " * 50).strip()


def test_regions_against_plain_sums():
    rng = np.random.default_rng(7)
    for _ in range(400):
        lengths = [int(x) for x in rng.choice([0, 0, 5, 30, 90], rng.integers(0, 25))]
        block, surge = int(rng.integers(1, 5)), int(rng.choice([1, 40, 80, 10**6]))
        sums = [sum(lengths[i : i + block]) for i in range(len(lengths))]
        level = min(surge, max([1, *sums])) if sums and max(sums) < surge else surge
        kept, inside = set(), False
        for i, s in enumerate(sums):
            inside = s >= level or inside and s > 0
            if inside:
                kept.add(i)
        for i in sorted(kept):  # short lines that touch a region belong to it
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(lengths) and lengths[j]:
                    kept.add(j)
                    j += step
        got = {i for first, last in html_extract.regions(lengths, block, surge) for i in range(first, last)}
        assert {i for i in got if lengths[i]} == {i for i in kept if lengths[i]}, (lengths, block, surge)


def test_names_that_only_look_like_boilerplate():
    long = "word " * 60
    for name in ("share-price", "related-work", "notice-period", "banner-year"):
        page = f"<body><article><p>{long}</p><div class='{name}'>A fact.</div><p class='{name}'>Another.</p></article></body>"
        assert html_extract.main_text(page).split("\n") == [long.strip(), "A fact.", "Another."]
    for name in ("ad", "ad-slot", "cookie-notice", "share-buttons", "related-posts", "site sidebar", "newsletter-signup-box"):
        page = f"<body><article><p>{long}</p><div class='{name}'>Not this. {long}</div></article></body>"
        assert html_extract.main_text(page) == long.strip(), name
    assert html_extract.main_text(f"<body><div class='related-work'><p>{long}</p></div><p>{long}</p></body>") == long.strip()


def test_empty_and_hopeless_pages():
    assert html_extract.regions([5, 5, 0, 0, 0, 90, 30, 0, 40, 0, 0, 0, 5]) == [(3, 9)]  # a region begins where the sum surges, be it on blank lines
    assert html_extract.main_text("a<articl") == "a" and html_extract.main_text("a < articl") == "a < articl"
    assert html_extract.main_text("<p>" + "<b>" * 5000 + "deep") == "deep"


# -- packing and token files --------------------------------------------------------------------------------------------


def test_packing_closes_bins_and_wastes_little(spark):
    """The settings of the query: a bound that binds, and not a task for each wave."""
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(6.6, 1.0, 70_000), 2, 2048).astype(int).tolist()
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "uid long, length long")
    rows = packing.pack(pieces).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 for v in used.values())
    assert len(used) <= 1.001 * -(-sum(lengths) // 2048) + 2
    waves = -(-sum(n < 2048 for n in lengths) // packing.WAVE_PIECES)
    assert packing.pack(pieces).where("length < 2048").rdd.getNumPartitions() <= max(4, waves // packing.STREAM_WAVES) + 4
    bins = packing.OpenBins(packing.CAPACITY, packing.OPEN_BINS)
    small = [n for n in lengths if n < 2048]
    for at in range(0, len(small), packing.WAVE_PIECES):
        for n in sorted(small[at : at + packing.WAVE_PIECES], reverse=True):
            bins.place(n)
            assert bins.open <= packing.OPEN_BINS
    assert bins.closed > 1000


def test_encoder_memo_is_bounded(monkeypatch):
    from rollweave.llm.encode import Encoder

    monkeypatch.setattr("rollweave.llm.encode.MEMO", 50)
    enc = Encoder(PATH)
    for i in range(20):
        enc.encode(pa.array([" ".join(f"w{i}x{k}" for k in range(40))]), 0)
        assert len(enc.memo) <= 50 + 100
        assert len(enc.ends) == len(enc.memo) + 1 and enc.ends[-1] == len(enc.pool)


# -- decontamination ----------------------------------------------------------------------------------------------------


def test_proximity_against_loops(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcde"), rng.integers(0, 30))) for _ in range(25)] + [None, "", "a " * 3000 + "b"]
    asked = [("one", ["a"]), ("two", ["a", "b"]), ("three", ["c", "a", "e", "a"]), ("none", ["zz", "a"]), ("empty", []), ("null", None), ("gap", ["a", None])]
    docs, wanted = frame(spark, texts).repartition(3), spark.createDataFrame(asked, "query string, terms array<string>")
    index = decontam.build_index(docs.unionByName(docs.limit(3)))
    for slop in (1, 2, 5):
        want = set()
        for (q, terms), (d, t) in itertools.product(asked, enumerate(texts)):
            words = (t or "").split()
            for last in range(len(words)) if terms else ():
                if None not in terms and words[last] in terms:
                    at = [max((i for i in range(last + 1) if words[i] == x), default=-1) for x in terms]
                    if min(at) >= 0 and last - min(at) < slop:
                        want.add((q, d, min(at), last))
        got = decontam.proximity_matches(index, wanted, slop).collect()
        assert {(r.query, r.doc_id, r["first"], r["last"]) for r in got} == want and len(got) == len(want)
    assert decontam.proximity_matches(index.limit(0), wanted, 2).count() == 0
    assert decontam.proximity_matches(index, wanted.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        decontam.proximity_matches(index, wanted, 0)


def test_contamination_of_very_long_and_repeating_texts(spark):
    item = " ".join(f"k{i}" for i in range(15))
    texts = ["x " * 40_000 + item, (item + " ") * 300, "t1 " * 2_000, item.upper() * 1]
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(1, item), (2, "t1 " * 14)], "item_id long, text string").withColumn("words", F.lit(0))
    got = by_id(decontam.contamination(docs, bench))
    assert [(got[i].n_words, len(got[i].places), got[i]["items"], got[i].contaminated) for i in range(4)] == [
        (40_015, 15, ["1"], False), (4_500, 4_500, ["1"], True), (2_000, 2_000, ["2"], True), (15, 15, ["1"], True),
    ]


def test_candidates_carry_no_words(spark, monkeypatch):
    """With every broadcast refused, joins shuffle and the report is the same."""
    item = " ".join(f"k{i}" for i in range(15))
    docs, bench = frame(spark, [item, "clean words", item + " more " * 400, None]), spark.createDataFrame([(7, item)], "item_id long, text string")
    first = sorted(map(str, decontam.contamination(docs, bench).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert sorted(map(str, decontam.contamination(docs, bench).collect())) == first
    index = decontam.build_index(docs)
    items = decontam.item_words(bench)
    found = decontam.phrase_candidates(index, decontam.window_anchors(items, decontam.term_counts(index)))
    assert not any(isinstance(f.dataType, (T.StringType, T.ArrayType)) for f in found.schema.fields)


# -- chat, licences, duplicates -----------------------------------------------------------------------------------------


def test_layouts_beside_clashing_columns(spark):
    df = spark.createDataFrame([("q", "a", "mine", 1, 2)], "prompt string, response string, fingerprint string, layout int, turns int")
    out = chat.canonical(df, ["prompt", "response"])
    assert out.columns == [*df.columns, "layout_", "turns_", "fingerprint_"] or set(out.columns) == {*df.columns, "layout_", "turns_", "fingerprint_"}
    r = out.first()
    assert (r.fingerprint, r.layout, r.turns, r.layout_, [tuple(t) for t in r.turns_]) == ("mine", 1, 2, "prompt and response", [("user", "q"), ("assistant", "a")])


def test_very_long_turns(spark):
    text = "<|end|> x " * 30_000
    out = chat.format_rows(spark.createDataFrame([(1, 0, "assistant", text), (1, 0, "assistant", text)], "conv_id long, turn int, role string, text string"))
    r = out.select(chat.loss_text(F.col("formatted"), F.col("loss")).alias("t"), F.size(chat.turns_of(F.col("formatted"))).alias("n")).first()
    assert r.t == text * 2 and r.n == 2


def test_equivalent_spellings_side_by_side(spark):
    pairs = [("the licence licence text", "the license license text"), ("Favour favour FAVOUR", "favor favor favor"), ("whilst labour centre", "while labor center"), ("5 percent percent", "5 per cent per cent")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b in df.select(licences.canonical(F.col("a")), licences.canonical(F.col("b"))).collect():
        assert a == b
    texts = [*itertools.chain(*pairs), "", None, "...", "copyright holders of the 2010 foundation", "Copyright 2020 A\rB\nrest", "x " * 100_000, "© me\nyou", "(c) 2020\n(c) the third point"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", licences.canonical(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c or "" for r in rows] == [oracles.plain_canonical(t or "") for t in texts]


def test_planted_licences_against_plain_digests(spark):
    known = {}
    for n, t in licences.all_known():
        if c := oracles.plain_canonical(t):
            known[c] = min(n, known.get(c, n))
    base = dict(reversed(licences.full_texts()))
    texts = [*base.values(), *(re.sub(r"\bLICENSE\b", "LICENCE", t.upper()) for t in base.values()), *(t + " more" for t in base.values()), "", None, "prose. " * 50_000]
    docs = frame(spark, texts).unionByName(frame(spark, texts[:3]))
    got = licences.scan(docs).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        text = texts[r.doc_id] or ""
        c = oracles.plain_canonical(text)
        assert r.licence == known.get(c) and r.text_sha256 == (hashlib.sha256(c.encode()).hexdigest() if c else None)
        assert r.notices == sorted(known[x] for x in map(oracles.plain_canonical, text.split("\n")) if x in known)
    assert sum(r.licence is not None for r in got) >= 2 * len(base)


def test_long_and_repeated_texts_of_dedup(spark):
    long = "word " * 60_000
    docs = frame(spark, [long, long + " ", long[:-5] + "else", long]).unionByName(frame(spark, [long]))
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(0, 1, 4, False), (0, 1, 4, False), (1, 1, 4, True), (2, 2, 1, True), (3, 1, 4, False)]
    same = simhash.components(docs).collect()
    assert {r.component_id for r in same} == {0} and len({r.fp for r in same if r.doc_id != 2}) == 1


def test_dedup_without_broadcasts(spark, monkeypatch):
    texts = ["a b", "ab", "c", None, "", "d" * 100, "d" * 100, "d" * 99 + "e"] + ["hot text"] * 40
    docs = frame(spark, texts).repartition(4)
    report, kept = (lambda: sorted(map(tuple, exact_dedup.exact_groups(docs, digest=True).collect()))), (lambda: sorted(r.doc_id for r in exact_dedup.deduplicate(docs).collect()))
    first = report(), kept()
    assert first[1] == [0, 2, 3, 5, 7, 8]
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert (report(), kept()) == first


def test_large_component_of_near_copies(spark):
    """One component of hundreds of distinct fingerprints, whose name is joined back without a broadcast too."""
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    fps = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)})
    rows = common.store(spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, first long"), "t")
    named = simhash._first_of_each(rows, "fp", F.col("first"), 4).collect()
    assert len(named) == len(fps) and {r["first"] for r in named} == {0}


# -- the pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_on_odd_tables(spark, tmp_path):
    item = " ".join(f"k{i}" for i in range(20))
    texts = ["some clean words of a text", "some  clean words of a text", None, "", " ", item, "long " * 9000, "a", "a"]
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)] + [(7, "a", "s", "x"), (None, "no id at all here", None, None)], "doc_id long, text string, source string, _fp string")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    for name, df in (("documents", docs), ("benchmark", bench), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {1, 4, 6, 7, None}  # of equal texts the longest row stays; 5 is the item
    assert sum(r.length for r in rows if r.doc_id == 6) == sum(r.length for r in packing.tokenised_pieces(docs.where("doc_id = 6"), PATH).collect())
    for name in ("documents", "benchmark", "labels"):
        docs_, path = docs, tmp_path / "none"
        {"documents": docs_, "benchmark": bench, "labels": labels}[name].limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@needs_data
def test_pipeline_leaves_no_tables_of_its_stages(spark):
    common.release(spark)
    out = corpus_pipeline.run(spark, SF)
    assert [p for _, p in common._blocks[0]] == [out._stored_at]


@needs_data
def test_stages_delete_what_the_ones_before_left(spark):
    common.release(spark)
    docs, sizes = queries.table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)  # not written in between: what it reads has to stay
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        left = len(common._blocks[0])
        docs = common.store(stage(spark, docs, SF), "written")
        assert docs.count() > 0 and len(common._blocks[0]) <= left + 4, name
    corpus_pipeline.drop_exact(spark, queries.table(spark, SF, "documents"), SF)
    assert [p for _, p in common._blocks[0] if "pieces" in p or "not-toxic" in p or "near-copies" in p] == []
    common.release(spark)


@needs_data
def test_pipeline_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    text = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    sequences = {}
    for r in rows:
        ids = [*t.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert crc(ids[r.start : r.start + r.length]) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


@needs_data
def test_token_file_query_against_plain_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    start, want = 0, []
    for r in queries.table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op3_token_ids(spark, SF).collect()) == want


@needs_data
def test_packing_query_against_plain_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    pieces, used = set(), {}
    for r in queries.op4_best_fit(spark, SF).collect():
        pieces.add((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = set()
    for r in queries.table(spark, SF, "documents").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want |= {(r.doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))}
    assert pieces == want
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    assert len(used) <= -(-sum(w[3] for w in want) // 2048) + 2


@needs_data
def test_near_copies_query_against_loops(spark):
    from test_training_operators import plain_components, plain_fingerprint

    rows = queries.table(spark, SF, "documents").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = [(r.doc_id, f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, plain_components(fps))]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF).collect()) == want


def test_fixed_values_have_no_chains():
    found = {a for a, _ in licences.SPELLINGS}
    assert not found & set(" ".join(b for _, b in licences.SPELLINGS).split()) and all(re.fullmatch("[a-z]+", a) for a in found)
    assert repair.LEAST_COUNT == 16
