"""Document fingerprints by MinHash: universal hash permutations over word shingles, in numpy.

Hash j maps a shingle x, 32 bits, to a_j x + b_j mod 2^64, of which the upper half is strongly universal (multiply-add-
shift; Dietzfelbinger 1996) and the whole orders shingles all but without ties, however long a text is. A fingerprint
keeps 8 bits of each of the PERMUTATIONS least values, after mixing them. Places of unlike texts agree by chance once in
256; corrected for that, the share of equal places estimates the Jaccard similarity of two texts' shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import components
from graphloom.runtime import ship, turn_to
from graphloom.storage import materialise
from .words import encoded, mix, shingle_hashes, word_hashes

PERMUTATIONS = 256
#: Places of a fingerprint that a band takes: texts of similarity 0.8 share one of the 32 bands in 99.7 % of cases.
BAND = 8
#: Share of places at which unlike texts agree.
CHANCE = 1 / 256
#: Shingles that are permuted at a time.
STEP = 256

_rng = np.random.default_rng(1997)
_A = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)[:, None]
_B = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)[:, None]
_NONE = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
#: What the hashes of STEP shingles are computed in; made once, as large arrays are dear to make.
_HELD = np.empty((PERMUTATIONS, STEP), np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value under each permutation; all ones for no shingles."""
    low = _NONE
    x = shingles >> np.uint64(32)
    for at in range(0, len(x), STEP):
        part = x[at : at + STEP]
        y = _HELD[:, : len(part)]
        np.multiply(_A, part, out=y)
        np.add(y, _B, out=y)
        low = np.minimum(low, y.min(axis=1))
    return low


def packed(low: np.ndarray) -> np.ndarray:
    return (mix(low) & np.uint64(255)).astype(np.uint8)


def as_text(print_: np.ndarray) -> str:
    return base64.b64encode(print_.tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return max(0.0, (float(np.count_nonzero(a == b)) / len(a) - CHANCE) / (1 - CHANCE))


def fingerprint(text: str | None) -> np.ndarray:
    return packed(minima(shingle_hashes(next(word_hashes(encoded([text]))))))


def edited(text: str, following: str) -> str:
    """The last third of the text (rounded down) replaced by as many first code points of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _pair(text: str, words: np.ndarray, following: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text's hash and the minima of the text and of the edited text, whose common shingles count once."""
    other = edited(text, following)
    data = other.encode("utf-8", "surrogatepass")
    new = next(word_hashes([data]))
    n = min(len(words), len(new))
    differ = np.flatnonzero(words[:n] != new[:n])
    same = int(differ[0]) if len(differ) else n
    a, b = shingle_hashes(words), shingle_hashes(new)
    common = max(0, same - 4) if min(len(words), len(new)) >= 5 else 0
    low = minima(a[:common])
    return (hashlib.sha256(data).hexdigest(), np.minimum(low, minima(a[common:])), np.minimum(low, minima(b[common:])))


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, place int, edge string, edge_text string"
)
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _row(doc, text: str, words: np.ndarray, following: str, next_print: np.ndarray) -> tuple:
    digest, low, low_edited = _pair(text, words, following)
    own, other = packed(low), packed(low_edited)
    return (doc, len(text), digest, as_text(own), as_text(other), likeness(own, other), likeness(own, next_print),
            None, None, None)


def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range of ids in descending order. The first row's text and the whole last row go out as edges."""
    from pyspark import TaskContext

    turn_to("fingerprints")
    place = TaskContext.get().partitionId()
    held = None
    for pdf in parts:
        out = []
        ids = [None if i is None else int(i) for i in pdf["id"]]
        texts = ["" if t is None else t for t in pdf["text"]]
        words = word_hashes(encoded(texts))
        if held is None and texts:
            out.append((None,) * 7 + (place, "first", texts[0]))
        for doc, text, w in zip(ids, texts, words, strict=True):
            own = packed(minima(shingle_hashes(w)))
            if held is not None:
                out.append(_row(*held, text, own))
            held = (doc, text, w)
        yield _frame(out)
    if held is not None:
        yield _frame([(held[0],) + (None,) * 6 + (place, "last", held[1])])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)  # whole numbers beside nulls stay whole
    return out.astype({"doc_id": "Int64", "n_chars": "Int64", "place": "Int64", "near_edited": "float64", "near_next": "float64"})


def _edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        out = []
        for doc, text, following in zip(pdf["id"], pdf["text"], pdf["following"], strict=True):
            a, b = word_hashes(encoded([text, following]))
            out.append(_row(None if doc is None else int(doc), text, a, following, packed(minima(shingle_hashes(b)))))
        yield _frame(out)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint and that of the text edited with its successor in descending order of ids.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as empty;
    null ids come last; equal ids are ordered by their text. The last is followed by the first, so a single row by
    itself. Two empty texts are alike (1.0); an empty and another text aren't.

    The texts are dealt out in ranges of ids, once. Each task needs just one row from the next range; those edges, two
    texts a range, are settled by a small join.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ship(docs.sparkSession)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.select(F.col("doc_id").cast("string").alias("id"), "text")
    done = materialise(parts.mapInPandas(_in_order, _SCHEMA), "fingerprints")
    columns = _COLUMNS[:7]
    inner = done.where("edge is null").select(columns)
    first = done.where("edge = 'first'").select("place", F.col("edge_text").alias("following"))
    # One row per range: their order is settled in one small window.
    line = Window.orderBy("place")
    chain = first.select("place", F.lead("place").over(line).alias("next"), F.min("place").over(Window.partitionBy()).alias("start"))
    chain = chain.select(F.col("place").alias("_place"), F.coalesce("next", "start").alias("_next"))
    last = done.where("edge = 'last'").select("doc_id", F.col("edge_text").alias("text"), "place")
    met = last.join(chain, F.col("place") == F.col("_place")).drop("place")
    met = met.join(first, F.col("_next") == F.col("place")).select(F.col("doc_id").cast("string").alias("id"), "text", "following")
    return inner.unionByName(met.mapInPandas(_edges, _SCHEMA).select(columns))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row, as an array of PERMUTATIONS numbers; texts without words have none (null)."""

    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def make(texts: pd.Series) -> pd.Series:
        found = (shingle_hashes(w) for w in word_hashes(encoded(texts)))
        return pd.Series([packed(minima(s)).astype("int32") if len(s) else None for s in found], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), make(F.col(text_col).cast("string")).alias("fingerprint"))


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, match_id, jaccard): links to smaller ids, of similarity ``least`` or more, that suffice for components.

    Any two texts that share a band and whose shingles' Jaccard similarity is ``least`` or more are linked, directly or
    over others, but for the 0.3 % of pairs that share none just at 0.8. Empty texts are linked with nothing, rows that
    share an id count as one. First each text meets its bands' smallest members and the smallest text of the same shingles. In bands
    that are left with several components, all pairs across components are tried, of texts of the same shingles one;
    joins on the band are ones that Spark can split when they are skewed.
    """
    from .jaccard_join import describe, verified

    prints = fingerprints(docs, id_col, text_col).where("fingerprint is not null")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // BAND - 1)),
                         lambda i: F.xxhash64(i, F.slice("fingerprint", i * BAND + 1, BAND)))
    bands = materialise(prints.select("doc_id", F.explode(pieces).alias("band")), "bands")
    heads = bands.groupBy("band").agg(F.min("doc_id").alias("match_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = bands.join(heads, "band").where("doc_id <> match_id").select("doc_id", "match_id")
    keys = materialise(describe(docs, id_col, text_col).where("key is not null").select("doc_id", "key"), "keys")
    first = keys.groupBy("key").agg(F.min("doc_id").alias("match_id"))
    copies = keys.join(first, "key").where("doc_id <> match_id").select("doc_id", "match_id")
    tried = materialise(pairs.unionByName(copies).distinct(), "tried")
    found = materialise(verified(docs, tried, least, id_col, text_col), "found")

    label = components(found.select(F.col("doc_id").alias("a"), F.col("match_id").alias("b")))
    single = first.select(F.col("match_id").alias("doc_id"))
    rows = bands.distinct().join(single, "doc_id", "left_semi").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = materialise(rows.select("band", "doc_id", F.coalesce("component", "doc_id").alias("component")), "labelled")
    several = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = materialise(rows.join(several.select("band"), "band", "left_semi"), "open")
    other = rows.select("band", F.col("doc_id").alias("match_id"), F.col("component").alias("other"))
    rest = rows.join(other, "band").where("component <> other and doc_id > match_id").select("doc_id", "match_id").distinct()
    rest = rest.join(tried, ["doc_id", "match_id"], "left_anti")
    return found.unionByName(verified(docs, rest, least, id_col, text_col))
