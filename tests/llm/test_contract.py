"""The contract queries against their SQL, and the pipeline against its stages done by hand."""

import math
import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import queries as Q
from graphloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "nan"):
            return "null"
        return repr(float(x)) if hasattr(x, "__float__") else str(x)

    return sorted(df.columns), sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, oracle, name):
    assert plain(Q.QUERIES[name](spark, SF).toPandas()) == plain(oracle.sql(Q.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL) - {"fingerprint_links"}))
def test_rows(spark, oracle, name):
    table = "pages" if name == "op6_html_text" else "documents"
    n = oracle.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    got = Q.QUERIES[name](spark, SF)
    assert got.select("page_id" if table == "pages" else "doc_id").distinct().count() == n
    if name != "op1_pack":
        assert got.count() == n


def test_fingerprint_links(spark):
    got = Q.fingerprint_links(spark, SF).collect()
    assert got and all(r["doc_id"] > r["match_id"] and r["jaccard"] >= 0.8 for r in got)


def test_held_out_quality(spark, oracle):
    got = Q.op7_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9 and held[held.quality == 1].predicted.mean() > 0.97


def test_pipeline(spark, oracle, tmp_path):
    """Each stage's rows from its predecessor's, worked out in plain Python."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        path = f"file://{tmp_path}/{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert i == 4 or docs.columns == columns
        seen.append(docs.collect())
    good, exact, near, mixed, packed = seen
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet' WHERE quality IN (0, 1)").fetchall())
    first = {r["doc_id"] for r in good}
    assert sum(labels[i] == 1 and i not in first for i in labels) == 0
    bad = [i for i in labels if labels[i] == 0]
    assert sum(i not in first for i in bad) > 0.5 * len(bad)

    best = {}
    for r in good:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    assert {r["doc_id"] for r in exact} == {i for _, i in best.values()}

    from tests.llm.test_operators import brute_components, words

    comp = brute_components([(r["doc_id"], r["text"]) for r in exact])
    assert {r["doc_id"] for r in near} == {c for _, c in comp.values()}

    sizes, used = defaultdict(int), defaultdict(int)
    for r in near:
        sizes[r["source"]] += len(words(r["text"]))
    for r in mixed:
        used[r["source"]] += len(words(r["text"]))
    longest = max(len(words(r["text"])) for r in near)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    assert all(used[s] <= 2 * sizes[s] for s in sizes) and abs(sum(used.values()) - 1.5 * sum(sizes.values())) < len(sizes) * longest

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    total = sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r["length"] for r in packed) == total
    assert len({r["sequence_id"] for r in packed}) == -(-total // 4096)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
