"""Columns with clashing names, nulls, empty tables, repeated rows; and queries against brute force where SQL can't say them."""

import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import exact_dedup, fingerprints, html_extract, jaccard_join, langid, licence_sentences, licenses, mixing, packing, quality, warc
from graphloom.llm import queries as Q
from graphloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use, or might.
NAMES = ["_id", "_ID_", "_digest", "_nth", "_got", "_lang", "_rate", "_host", "_at", "_low", "_row", "_stay", "_own", "_metadata", "lang_pred",
         "score", "training_position", "digest", "key", "size", "before", "tie", "nth", "pass", "uses", "rank", "target", "block", "slice", "n",
         "row", "got", "a.b", "id", "y", "half", "payload", "chunk", "component_id", "kept", "quality", "with `quote`", "Text2"]
ROWS = [(1, "one two three four five six", "en", "s", 1), (2, "one two three four five six", "en", "s", 2), (3, None, None, None, None),
        (None, "one  two three four five six", "en", "t", 3), (None, None, None, None, None), (4, "", "en", "t", 0), (5, "lone words here", "fr", None, 4),
        (5, "lone words here", "fr", None, 4), (6, "x " * 3000, "fr", "t", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every kind, and a column of each of NAMES that says which row it is."""
    df = spark.createDataFrame(ROWS, DOCS).coalesce(1)
    mark = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("-")))
    return df.select("*", *[mark.alias(n) for n in NAMES]).cache()


def marks(df, but=()):
    """Each row's mark, after a look that the row's other marks are the same."""
    out = []
    for r in df.collect():
        d = r.asDict()
        seen = {d[n] for n in NAMES if n in d and n not in but}
        assert len(seen) == 1
        out.append(seen.pop())
    return sorted(out)


def test_names_in_stages(odd):
    stay = exact_dedup.drop_copies(odd)
    assert stay.columns == odd.columns and len(marks(stay)) == 4  # one of: six words, empty, lone words, x
    near = jaccard_join.keep_one(odd)
    assert near.columns == odd.columns and "2/one two three four five six" not in marks(near)
    mixed = mixing.mix(odd)
    assert sorted(mixed.columns) == sorted(odd.columns) and mixed.where("training_position < 0 or training_position > 1").count() == 0
    assert set(marks(mixed, ("training_position",))) <= {f"{'-' if r[0] is None else r[0]}/{r[1]}" for r in ROWS if r[1]}
    pieces = packing.pack(odd, tokenizer_path())
    assert pieces.where("start = 0").count() == len(ROWS)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(odd.sparkSession, odd, SF)
        assert name == "packing" or sorted(out.columns) == sorted(odd.columns)
        assert out.count() > 0


def test_names_in_other_operators(spark, odd):
    model = langid.learn(odd)
    assert model.langs == ["en", "fr"]
    got = langid.identify(odd, model)
    assert len(set(got.columns)) == len(got.columns) == len(odd.columns) and len(marks(got, ("lang_pred", "score"))) == len(ROWS)
    assert {r["lang_pred"] for r in got.where("text is null or text = ''").collect()} == {"und"}
    learned = quality.learn(odd.withColumn("quality", F.when(F.col("doc_id") > 3, 1).otherwise(0)))
    assert odd.select(quality.score(odd, learned).alias("p")).where("p between 0 and 1").count() == len(ROWS)
    assert licenses.scan(odd).count() == len(ROWS) and fingerprints.fingerprint_edits(odd).count() == len(ROWS)
    assert mixing.schedule(odd).count() == len(ROWS)
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), F.col("text").alias("text"), *[F.col(f"`{n.replace('`', '``')}`") for n in NAMES])
    found = html_extract.extract(pages)
    assert found.columns.count("text") == 1 and len(marks(found)) == len(ROWS)
    assert warc.summary(warc.read(warc.write(warc.plan_records(pages)))).count() == len(ROWS)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert [f(none).count() for f in (exact_dedup.drop_copies, jaccard_join.keep_one, mixing.mix, licenses.scan, fingerprints.fingerprint_edits,
                                      fingerprints.near_duplicates, exact_dedup.resolve, mixing.schedule)] == [0] * 8
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")), SF).count() == 0


def test_nulls_through_the_pipeline(spark, tmp_path):
    (tmp_path / "x").mkdir()
    spark.createDataFrame(ROWS, DOCS).write.parquet(f"file://{tmp_path}/x/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/x/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/x")
    assert "sequence_id" in got.columns and got.count() > 0


def test_sequences_follow_the_curriculum(spark, tmp_path):
    """Of two documents far apart in training, the earlier one lies in an earlier sequence; shares change along the way."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 400)), "en", "ab"[i % 2], 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    mixed = mixing.mix(docs)
    position = mixed.groupBy("doc_id").agg(F.min("training_position").alias("p"), F.count(F.lit(1)).alias("n"))
    position = {r["doc_id"]: r["p"] for r in position.collect() if r["n"] == 1}
    one_file = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(one_file, "false")  # several files of so few rows
    mixing.mix(docs).write.parquet(f"file://{tmp_path}/mixed")
    spark.conf.unset(one_file)
    back = spark.read.parquet(f"file://{tmp_path}/mixed").drop("training_position")
    files = len(list((tmp_path / "mixed").glob("*.parquet")))
    pieces = corpus_pipeline.pack_sequences(spark, back, SF).collect()
    first = {}
    for p in pieces:
        if p["start"] == 0:
            first[p["doc_id"]] = p["sequence_id"]
    pairs = sorted((position[d], first[d]) for d in position)
    rank = np.argsort(np.argsort([s for _, s in pairs], kind="stable"))
    assert np.corrcoef(rank, np.arange(len(pairs)))[0, 1] > 0.9 and files > 1
    last = max(p["sequence_id"] for p in pieces)
    share = lambda k: np.mean([p["source"] == "a" for p in pieces for _ in range(p["length"] // 50) if abs(p["sequence_id"] / last - k) < 0.15])
    assert share(0.1) > share(0.9) + 0.2  # the first source fades, the second grows


# --------------------------------------------------------------------------------------------------- brute force


def plain_rows(sql):
    return duckdb.sql(sql).fetchall()


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op3_against_brute_force(spark):
    """The same with sets of n-grams instead of filters: false positives, corrected for, change nothing but the score's
    last digits."""
    docs = plain_rows(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'")
    count = defaultdict(Counter)
    for i, text, lang in docs:
        if not held(i) and lang is not None and text is not None:
            data = (" " + text.lower() + " ").encode()
            count[lang].update(data[k : k + 5] for k in range(len(data) - 4))
    known = {lang: {g for g, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.GRAMS] if n > 1} for lang, c in count.items()}
    got = {r["doc_id"]: r for r in Q.op3_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    same = 0
    for i, text, _ in docs:
        assert got[i]["held_out"] == held(i)
        if text is None or not any(map(str.isalpha, text)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            same += 1
            continue
        data = (" " + text.lower() + " ").encode()
        grams = [data[k : k + 5] for k in range(len(data) - 4)]
        hits = {lang: sum(g in s for g in grams) for lang, s in known.items()}
        best = max(sorted(hits), key=hits.get)
        same += got[i]["lang_pred"] == best
        if hits[best]:
            assert abs(got[i]["score"] - hits[best] / sum(hits.values())) < 0.05 + 2 / len(grams)
    assert same >= 0.99 * len(docs)


def test_language_grams_are_the_most_frequent_ones(spark, monkeypatch):
    """An exact top-k even if one hashed part holds most of it."""
    monkeypatch.setattr(langid, "GRAMS", 50)
    text = " ".join(f"{'abcdefgh'[k % 8] * 5}{k % 40:02d}" for k in range(2000))
    model = langid.learn(spark.createDataFrame([(i, text, "xx", "", 0) for i in range(3)], DOCS))
    data = langid.folded(text)
    want = Counter(data[k : k + 5] for k in range(len(data) - 4))
    least = sorted(want.values(), reverse=True)[49]
    top = np.array([int.from_bytes(g, "big") for g, n in want.items() if n > least], np.uint64)
    assert model.counts(top).tolist() == [len(top)]


def test_op6_against_brute_force(spark):
    """The style tree by counting in plain Python over all pages of a host, and the texts that it leaves."""
    sf = "/root/testdata/sf0.01"
    pages = plain_rows(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'")
    host = lambda u: (re.match(r"(?:[^/?#]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", u or "") or [None, ""])[1].lower()
    texts, shapes, marked = defaultdict(Counter), defaultdict(Counter), {}
    parsed = {}
    for i, url, page in pages:
        parsed[i] = blocks, children = html_extract.parse(page or "")
        nodes = defaultdict(lambda: True)
        for b in blocks:
            for p in b.paths:
                texts[host(url), p][b.text] += 1
                nodes[p] &= b.dropped
        for p, m in nodes.items():
            shapes[host(url), p][children.get(p, ())] += 1
            marked[host(url), p] = marked.get((host(url), p), True) and m
    importance = {}
    for node, c in shapes.items():
        m = sum(c.values())
        if m < 2:
            one, two = 1.0, 1.0
        else:
            one = -sum(k / m * math.log(k / m) for k in c.values()) / math.log(m)
            two = sum(k * (1 - min(1.0, math.log(k) / math.log(m))) for k in texts[node].values()) / sum(texts[node].values())
        importance[node] = (0.1 * one + 0.9 * two) * (0.25 if marked[node] else 1.0), m
    tree = html_extract.style_tree(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(tree) == len(importance) > 200
    for r in tree:
        value, m = importance[r["host"], r["node"]]
        assert r["pages"] == m and r["importance"] == pytest.approx(value) and r["marked"] == marked[r["host"], r["node"]]
    low = {n for n, (v, m) in importance.items() if v < 0.3 and m >= 10 and not marked[n]}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in Q.op6_html_text(spark, sf).collect()}
    for i, url, _ in pages:
        blocks = [b for b in parsed[i][0] if not b.dropped]
        kept = [b for b in blocks if not any((host(url), p) in low for p in b.paths)] or blocks
        assert got[i] == ("\n".join(b.text for b in kept), len("\n".join(b.text for b in kept)))


def test_html_pages_of_the_review():
    text = lambda page: html_extract.main_text(html_extract.parse(page)[0])
    assert text('<body class="home has-sidebar"><main><p>Hello world</p></main></body>') == "Hello world"
    assert text('<article class="post header-large"><p>Hello world</p></article>') == "Hello world"
    assert text("<p>a</p><div hidden>b</div><div class=x hidden data-y='1'>c</div><div title='is hidden here' data-z=hidden>d</div><div HIDDEN=''>e</div>") == "a\nd"
    assert text("<article><p>so <math><mi>x</mi></math> and <button>go</button> on</p><dialog>d</dialog><object>o</object></article>") == "so x and on\nd\no"
    assert text("<p>a <button>b</button> c</p><dialog>d</dialog><nav><p>n <b>m</b></p></nav>") == "a c"


def test_pages_at_the_least_number(spark):
    """A repeated block goes at LEAST_PAGES pages of a host and stays below."""
    def rows(n):
        return [(i, f"http://h{n}/", f"<div class=p><p>Same words here</p></div><div class=q><p>own {i} {n}</p></div>") for i in range(n)]

    pages = spark.createDataFrame(rows(html_extract.LEAST_PAGES) + rows(html_extract.LEAST_PAGES - 1), "page_id long, url string, html string")
    got = {(r["url"], r["page_id"]): r["text"] for r in html_extract.extract(pages).collect()}
    assert got[f"http://h{html_extract.LEAST_PAGES}/", 3] == f"own 3 {html_extract.LEAST_PAGES}"
    assert got[f"http://h{html_extract.LEAST_PAGES - 1}/", 3] == f"Same words here\nown 3 {html_extract.LEAST_PAGES - 1}"


def test_op7_against_brute_force(spark):
    """Every score from the lowest difference of the whole text's pieces, and the curve by its definition."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = Q.learn_quality(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"))
    coders = [[zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=quality.as_dictionary(p[i]), write_content_size=False, write_dict_id=False) for p in model.pairs] for i in (0, 1)]
    bare = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False)
    got = {r["doc_id"]: r for r in Q.op7_quality(spark, SF).collect()}
    for i, text in plain_rows(f"SELECT doc_id, text FROM '{SF}/documents.parquet'"):
        data, cuts, at = (text or "").encode(), [], 0
        while at < len(data):
            end = at + quality.PIECE if len(data) - at >= quality.PIECE * 3 / 2 else len(data)
            cuts.append(data[at:end])
            at = end
        size = lambda cs, x: np.mean([len(c.compress(x)) for c in cs])
        apart = [(size(coders[1], x) - size(coders[0], x)) / len(bare.compress(x)) for x in cuts]
        want = float(np.interp(min(apart, default=0.0), model.at, model.share))
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["predicted"] == (want >= 0.3) and got[i]["held_out"] == held(i)


def test_curve_is_the_best_rising_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * x))).astype(float)
    at, share = quality.fit_curve(x, y)
    assert (np.diff(share) >= 0).all() and (np.diff(at) > 0).all() and 0 < share[0] and share[-1] < 1
    sorted_y = y[np.argsort(x)]
    # the min-max formula of isotonic regression
    fit = [max(min(sorted_y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    blocks = sorted(set(np.round(fit, 9)))
    assert len(blocks) == len(share)


def test_long_labelled_texts_count_whole(spark):
    """Junk behind the first 100,000 characters of labelled texts is learned from, and found in others."""
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"{'bcdfghklm'[a]}{'aeiou'[b]}{'nrst'[c]}e" for a, b, c in zip(rng.integers(0, 9, n), rng.integers(0, 5, n), rng.integers(0, 4, n)))
    junk = lambda n: " ".join(f"{k}@@{k}##" for k in rng.integers(0, 30, n))
    rows = [(i, prose(25_000) + (" " + junk(600) if i % 2 else ""), "", "", 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).withColumn("quality", (F.col("doc_id") % 2 == 0).cast("int"))
    model = quality.learn(df.where("doc_id < 44"))
    got = {r["doc_id"]: r["p"] for r in df.where("doc_id >= 44").select("doc_id", quality.score(df, model).alias("p")).collect()}
    assert all((p > 0.5) == (i % 2 == 0) for i, p in got.items())


def test_whole_licence_texts(spark):
    """Each text of the table, wrapped as in files and in capitals, is one match of its licence, and nothing is left over."""
    rows, want = [], {}
    for k, (name, sentences) in enumerate(licence_sentences.TEXTS):
        text = ". ".join(s[0].upper() + s[1:] for s in sentences).replace(":. ", ":\n\n") + "."
        fill = lambda width: "\n\n".join(textwrap.fill(part, width) for part in text.split("\n\n"))  # noqa: B023, E731
        rows += [(3 * k, "Intro line.\n\n" + fill(78) + "\n\nThe end", "", "", 0), (3 * k + 1, text.upper(), "", "", 0),
                 (3 * k + 2, "\n".join(f" * {x}" for x in fill(72).split("\n")), "", "", 0)]
        want |= {3 * k + j: name for j in range(3)}
    got = {r["doc_id"]: (r["licenses"], r["n_matches"], r["unmatched"]) for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (name, 1, 0) for i, name in want.items()}
    assert all(re.search(licenses.ANY_HINT, x) and any(w in x for w in licenses.WORDS) for x in licenses.KNOWN)
