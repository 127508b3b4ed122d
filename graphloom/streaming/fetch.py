"""Fetching: title discovery and batches of pages from a wiki's API, through a transport that tests can replace."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ingest import batches, clean_failed, parse_responses, pending
from graphloom.plans.pipeline import canonicalise
from graphloom.plans.progress import Progress
from graphloom.runtime import ship
from graphloom.sources.catalog import Catalog
from graphloom.streaming import crawl

#: Fixed values of the API's use.
EXPECTED_TITLES = 72_666
RETRY_ON, RETRIES, BACKOFF = (429, 500, 502, 503, 504), 5, 1.5
TIMEOUT, DEFAULT_WAIT, DISCOVERY_SLEEP = 30, 15, 0.05
BATCH, PAGE = 20, 500
DISCOVERY = {"action": "query", "format": "json", "list": "allpages", "aplimit": str(PAGE)}


class Transport(Protocol):
    """Answers a request; it is sent to the executors, so it must survive pickling."""

    def get(self, params: dict[str, str]) -> tuple[int, dict[str, str], str]:
        """(status, headers with lower-case names, body)"""


class HttpTransport:
    """GET over one opener per process, with retries and growing waits for statuses that may pass."""

    def __init__(self, url: str, agent: str = "graphloom/1.0", sleep: Callable[[float], None] = time.sleep) -> None:
        self.url, self.agent, self.sleep = url, agent, sleep

    def get(self, params: dict[str, str]) -> tuple[int, dict[str, str], str]:
        request = urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(params)}",
                                         headers={"User-Agent": self.agent, "Accept": "application/json"})
        for attempt in range(RETRIES + 1):
            try:
                with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
                    return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode()
            except urllib.error.HTTPError as e:
                if e.code not in RETRY_ON or attempt == RETRIES:
                    return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode(errors="replace")
            except urllib.error.URLError:
                if attempt == RETRIES:
                    raise
            self.sleep(BACKOFF * 2**attempt if attempt else 0)
        raise AssertionError


def get_json(transport: Transport, params: dict[str, str], pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer as JSON. A 429 is waited for once, as long as it says in digits, else DEFAULT_WAIT; other bad statuses
    raise. ``pause`` is slept after each answer."""
    status, headers, body = transport.get(params)
    if status == 429:
        wait = headers.get("retry-after", "")
        sleep(int(wait) if wait.isdigit() else DEFAULT_WAIT)
        status, headers, body = transport.get(params)
    if status >= 400:
        raise OSError(f"HTTP status {status}")
    if pause:
        sleep(pause)
    return json.loads(body)


def answers(transport: Transport, params: dict[str, str], pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """The answer and its continuations."""
    params = dict(params)
    while True:
        data = get_json(transport, params, pause, sleep)
        yield data
        if "continue" not in data:
            return
        params |= data["continue"]


def discover(catalog: Catalog, transport: Transport, sleep: Callable[[float], None] = time.sleep, flush: int = 100) -> int:
    """Mark all titles that the API lists as discovered, ``flush`` answers at a time; returns how many are known."""
    spark, held, n = catalog.spark, [], 0
    for i, data in enumerate(answers(transport, DISCOVERY, DISCOVERY_SLEEP, sleep)):
        held += [(p["title"],) for p in data.get("query", {}).get("allpages", [])]
        if (i + 1) % flush == 0 and held:
            n, held = crawl.add_discovered(catalog, spark.createDataFrame(held, "page_title string")), []
    return crawl.add_discovered(catalog, spark.createDataFrame(held, "page_title string")) if held else n


def fetched(asked: DataFrame, transport: Transport) -> DataFrame:
    """(batch, titles) -> crawl lines (batch, titles, response, error): one per answer, or the batch's error."""
    ship(asked.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for batch, titles in zip(pdf["batch"], pdf["titles"], strict=True):
                params = {"action": "query", "format": "json", "titles": "|".join(titles), "prop": "links|categories",
                          "pllimit": "max", "cllimit": "max"}
                try:
                    rows = [(batch, list(titles), json.dumps(a), None) for a in answers(transport, params)]
                except Exception as e:  # any failure is the batch's result, not the crawl's end
                    rows = [(batch, list(titles), None, str(e))]
                yield pd.DataFrame(rows, columns=["batch", "titles", "body", "error"])

    rows = asked.select("batch", "titles").mapInPandas(run, "batch long, titles array<string>, body string, error string")
    return parse_responses(rows).select("batch", "titles", "response", "error")


def run_crawl(catalog: Catalog, transport: Transport, most: int | None = None, expected: int = EXPECTED_TITLES, tasks: int = 4,
              flush: int = 500, sleep: Callable[[float], None] = time.sleep, progress: Progress | None = None) -> dict[str, int]:
    """Discover titles if fewer than ``expected`` are known, fetch what is pending, ``flush`` batches at a time, and bring
    titles into canonical form at the end. What was stored before an interruption isn't fetched again. Returns counters."""
    if catalog.read("discovered_pages").count() < expected:
        discover(catalog, transport, sleep)
    catalog.replace({"failed_pages": clean_failed(catalog.read("failed_pages"), catalog.read("searched_pages").select("page_title"))})
    titles = pending(catalog.read("discovered_pages"), catalog.read("searched_pages").select("page_title"), most)
    asked = batches(titles.select("page_title"), BATCH).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "page_title"))).alias("t"))
    asked = catalog.staged(asked.select("batch", F.col("t.page_title").alias("titles")), "asked")
    n, done = asked.count(), {"ok": 0, "error": 0}
    for at in range(0, n, flush):
        some = asked.where((F.col("batch") >= at) & (F.col("batch") < at + flush)).repartition(tasks)
        lines = catalog.staged(fetched(some, transport), "lines")
        count = crawl.counters(crawl.records_of(lines)).first()
        crawl.apply_batch(catalog, lines)
        done = {k: v + count[k] for k, v in done.items()}
        if progress:
            progress.report(min(n, at + flush), n, f"OK={done['ok']} ERROR={done['error']}")
    if n:
        canonicalise(catalog)
    catalog.vacuum()
    return done
