"""Tables, streaming and the batch pipeline, end to end."""

import io
import json
import subprocess
import sys
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest

from graphloom.operators import paths
from graphloom.plans import pipeline, serve
from graphloom.plans.progress import Progress, duration
from graphloom.sources.catalog import SCHEMAS, Catalog
from graphloom.streaming import crawl, fetch


def lines(batch, pages):
    found = {str(i): {"title": t, "links": [{"ns": 0, "title": x} for x in out], "categories": [{"title": f"Category:{c}"} for c in cats]}
             for i, (t, out, cats) in enumerate(pages)}
    return json.dumps({"batch": batch, "titles": [t for t, *_ in pages], "response": {"query": {"pages": found}}, "error": None})


def names(catalog, table):
    """The table's rows without the times at which they were stored."""
    df = catalog.read(table)
    return {tuple(r) for r in df.drop(*[c for c in df.columns if c.endswith("_at")]).collect()}


def test_stream_equals_batch_and_pipeline(spark, tmp_path):
    ring = lambda p: [(f"{p}{i}", [f"{p}{(i + k) % 6}" for k in (1, 2)], ["Ships" if p == "a" else "Trains"]) for i in range(6)]
    files = [lines(1, ring("a")), lines(2, [*ring("b"), ("b9", ["a0", "b0"], [])]), json.dumps({"batch": 3, "titles": ["bad"], "error": "down"})]
    (tmp_path / "in").mkdir()
    one = Catalog(spark, f"file://{tmp_path}/one")
    for i, f in enumerate(files):
        (tmp_path / "in" / f"{i}.json").write_text(f)
        crawl.start(spark, f"file://{tmp_path}/in", one, f"file://{tmp_path}/check", once=True).awaitTermination()
    two = Catalog(spark, f"file://{tmp_path}/two")
    crawl.apply_batch(two, spark.read.schema(crawl.LINE).json(f"file://{tmp_path}/in"))
    for t in crawl.TABLES:
        assert names(one, t) == names(two, t), t
    assert names(one, "failed_pages") == {("bad", "down")} and len(names(one, "searched_pages")) == 13
    crawl.apply_batch(one, spark.read.schema(crawl.LINE).json(f"file://{tmp_path}/in"), 0)  # a replay
    assert len(names(one, "page_links")) == 26

    titles = one.read("pages").select("page_title")
    one.replace({"discovered_pages": titles})
    pipeline.canonicalise(one)
    out = f"file://{tmp_path}/out"
    pipeline.run_pipeline(one, out)
    assert len(names(one, "nodes_layout")) == 13
    by = dict(names(one, "cluster_assignments"))
    assert {by[f"a{i}"] for i in range(6)}.isdisjoint({by[f"b{i}"] for i in range(6)})
    assert {r[2] for r in names(one, "cluster_colors")} >= {"Ships", "Trains"}
    assert list((tmp_path / "out/tiles_edges/0").rglob("*.png")) and list((tmp_path / "out/z6").glob("nodes_*.json"))
    node = json.loads(next((tmp_path / "out/z7").glob("nodes_*.json")).read_text())[0]
    assert node["label"] == node["id"] and "cluster_name" in node
    index = json.loads((tmp_path / "out/search_index.json").read_text())
    assert [n["id"] for n in index] == sorted((n["id"] for n in index), key=str.lower) and len(index) == 13
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert set(manifest) == {"bounds", "zoom_levels", "zoom_config", "label_min_zoom", "interactive_min_zoom", "adjacency"}
    assert manifest["zoom_levels"]["7"]["included_nodes"] == 13
    (tmp_path / "out/z6/nodes_99_99.json").write_text("old")
    pipeline.build_chunks(one, out)
    assert not (tmp_path / "out/z6/nodes_99_99.json").exists()
    got = pipeline.adjacency(one, " a0 ")
    assert got["out"] == ["a1", "a2"] and "b9" in got["in"] and pipeline.adjacency(one, "nobody") is None


def test_catalog_migration(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}")
    catalog.replace({"cluster_colors": spark.createDataFrame([(1, "#000000")], "cluster_id long, cluster_color string")})
    assert names(catalog, "cluster_colors") == {(1, "#000000", None)}
    catalog.clear("cluster_colors")
    assert names(catalog, "cluster_colors") == set() and set(SCHEMAS) >= set(crawl.TABLES)


def test_interrupted_changes_leave_the_old_state(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, f"file://{tmp_path}")
    rows = lambda *ts: spark.createDataFrame([(t, 0, 0, None) for t in ts], SCHEMAS["pages"])
    catalog.replace({"pages": rows("a")}, 4)
    real = catalog._point

    def stop(state):
        raise KeyboardInterrupt

    monkeypatch.setattr(catalog, "_point", stop)
    with pytest.raises(KeyboardInterrupt):  # new files are there, nothing points to them
        catalog.replace({"pages": rows("b")}, 5)
    assert names(catalog, "pages") == {("a", 0, 0, None)} and catalog.last_batch() == 4
    (tmp_path / "state/000000000009").write_text('{"tables": {"pa')  # cut off while it was written
    assert names(catalog, "pages") == {("a", 0, 0, None)} and catalog.last_batch() == 4
    monkeypatch.setattr(catalog, "_point", real)
    catalog.replace({"pages": rows("c")}, 6)
    assert names(catalog, "pages") == {("c", 0, 0, None)} and catalog.last_batch() == 6
    for t in "defg":
        catalog.replace({"pages": rows(t)})
    catalog.vacuum()
    assert names(catalog, "pages") == {("g", 0, 0, None)} and len(list((tmp_path / "pages").iterdir())) == 3


def test_micro_batch_rewrites_touched_buckets_only(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}", buckets=8)
    of = lambda text: spark.read.schema(crawl.LINE).json(spark.sparkContext.parallelize(text))
    crawl.apply_batch(catalog, of([lines(1, [(f"t{i}", ["x"], []) for i in range(60)])]), 0)
    before = catalog._state()["tables"]["pages"]
    crawl.apply_batch(catalog, of([lines(2, [("t1", ["y"], ["k"])])]), 1)
    after = catalog._state()["tables"]["pages"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert {("t1", "x"), ("t1", "y"), ("t2", "x")} <= names(catalog, "page_links") and len(names(catalog, "pages")) == 60
    assert catalog.read("searched_pages").where("searched_at is null").count() == 0
    # one title in two batches of a micro-batch: the later one holds, whatever the order of lines
    good, bad = lines(5, [("t1", ["z"], [])]), json.dumps({"batch": 6, "titles": ["t1"], "error": "down"})
    crawl.apply_batch(catalog, of([bad, good]), 2)
    assert ("t1", 0, 0, "down") in names(catalog, "pages") and names(catalog, "failed_pages") == {("t1", "down")}
    assert crawl.add_discovered(catalog, spark.createDataFrame([("t1",), ("new",), ("new",)], "page_title string")) == 2


class Recorded:
    """A wiki of five titles: two pages of discovery, one batch in two answers, a rate limit, a batch that fails."""

    def __init__(self, fail: str = "") -> None:
        self.fail, self.limited = fail, False

    def get(self, params):
        if params.get("list") == "allpages":
            if "apcontinue" not in params:
                return 200, {}, json.dumps({"query": {"allpages": [{"title": t} for t in "ab"]}, "continue": {"apcontinue": "c"}})
            if not self.limited:
                self.limited = True
                return 429, {"retry-after": "7"}, ""
            return 200, {}, json.dumps({"query": {"allpages": [{"title": t} for t in "cde"]}})
        titles = params["titles"].split("|")
        if self.fail in titles and self.fail:
            return 500, {}, ""
        first = "plcontinue" not in params
        page = lambda t: {"title": t, "links": [{"ns": 0, "title": "a" if first else "b"}], "categories": [{"title": "Category:K"}]}
        found = {"query": {"pages": {str(i): page(t) for i, t in enumerate(titles)}}}
        return 200, {}, json.dumps(found | ({"continue": {"plcontinue": "x"}} if first else {}))


def test_crawl_with_a_recorded_wiki(spark, tmp_path, monkeypatch):
    waits, said = [], io.StringIO()
    catalog = Catalog(spark, f"file://{tmp_path}/one")
    assert fetch.discover(catalog, Recorded(), waits.append, flush=1) == 5 and 7 in waits
    progress = Progress("crawl", said, iter([0.0, 3700.0]).__next__)
    assert fetch.run_crawl(catalog, Recorded(), expected=5, sleep=waits.append, progress=progress) == {"ok": 5, "error": 0}
    assert said.getvalue() == "crawl 1/1 100.00% | OK=5 ERROR=0 | elapsed 01:01:40 | eta 00:00\n"
    assert {("a", "a"), ("a", "b"), ("e", "b")} <= names(catalog, "page_links") and len(names(catalog, "page_links")) == 10
    assert fetch.run_crawl(catalog, Recorded(), expected=5) == {"ok": 0, "error": 0}  # nothing is pending
    two = Catalog(spark, f"file://{tmp_path}/two")
    monkeypatch.setattr(fetch, "BATCH", 2)
    assert fetch.run_crawl(two, Recorded("c"), expected=9, sleep=waits.append, flush=1) == {"ok": 3, "error": 2}
    assert {r[0] for r in names(two, "failed_pages")} == {"c", "d"} and {r[1] for r in names(two, "failed_pages")} == {"HTTP status 500"}
    assert fetch.run_crawl(two, Recorded(), expected=5) == {"ok": 2, "error": 0} and names(two, "failed_pages") == set()
    with pytest.raises(OSError):
        fetch.get_json(Recorded("x"), {"titles": "x"})
    assert progress and duration(-3) == "00:00" and duration(59) == "00:59"


def test_http_transport_retries_and_server(spark, tmp_path):
    asked = []

    class Wiki(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(503 if len(asked) < 3 else 200)
            self.end_headers()
            self.wfile.write(b'{"ok": 1}')

        def log_message(self, *args):
            pass

    waits = []
    with HTTPServer(("127.0.0.1", 0), Wiki) as wiki:
        threading.Thread(target=wiki.serve_forever, daemon=True).start()
        transport = fetch.HttpTransport(f"http://127.0.0.1:{wiki.server_port}/api", sleep=waits.append)
        assert fetch.get_json(transport, {"titles": "a|b"}) == {"ok": 1} and waits == [0, 3.0] and asked[0] == "/api?titles=a%7Cb"
        wiki.shutdown()

    catalog = Catalog(spark, f"file://{tmp_path}/tables")
    catalog.replace({"page_links": spark.createDataFrame([("a", "b c")], SCHEMAS["page_links"]),
                     "discovered_pages": spark.createDataFrame([("a",), ("b c",)], "page_title string")})
    (tmp_path / "index.html").write_text("hello")
    with serve.server(catalog, str(tmp_path), port=0) as httpd:
        threading.Thread(target=httpd.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{httpd.server_port}"
        with urllib.request.urlopen(f"{base}/api/adjacency?node_id=%20b%20c%20") as r:
            assert json.loads(r.read())["in"] == ["a"] and r.headers["Cache-Control"] == "public, max-age=300"
        assert urllib.request.urlopen(f"{base}/index.html").read() == b"hello"
        for path, status in (("/api/adjacency", 400), ("/api/adjacency?node_id=zz", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(base + path)
            assert e.value.code == status
        httpd.shutdown()


def test_results_in_csv(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    assert paths.resume_from(spark, path) is None
    for rows in ([("a", "3"), ("b", "x")], [("c", "5"), ("d", "5")]):
        paths.append_results(spark.createDataFrame(rows, "start string, path_length string").coalesce(1), path)
    assert paths.resume_from(spark, path)["start"] == "c" and paths.read_results(spark, path).count() == 4


def test_first_use_from_another_folder(tmp_path):
    """The package reaches the workers though neither their folder nor their path has it."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from graphloom.operators import paths
edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source_title string, target_title string")
print("GOT", paths.eccentricities(edges, spark.createDataFrame([("a",)], "page_title string")).first()["path"])
"""
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "GOT a -> b -> c" in got.stdout, got.stderr[-2000:]
