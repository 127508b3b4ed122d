"""Language identification by language-bitmask n-gram filters.

A Bloom filter whose slots are bitmasks: bit l of a slot belongs to language l, so the filters of all languages lie bit
by bit side by side and one probe answers for all of them. An n-gram is looked up in a few slots; the AND of their
masks has a bit for every language that contains it. Over a text these bits are counted per language (popcounts).
A language whose share of set bits is f answers yes by chance with probability f^probes, so its count c of n lookups
is corrected to (c - n p) / (1 - p). The language with the largest corrected count wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import private, quoted, ship
from graphloom.storage import materialise

#: Bytes of an n-gram.
N = 5
#: Probes of the filter for each n-gram.
PROBES = 2
#: Slots of the filter, a power of two.
SLOTS = 1 << 20
#: The most frequent n-grams of each language go into the filter.
GRAMS = 40_000
#: Documents of each language that are learned from, at most; picked by a hash of the id. The bound of the fit.
LEARN_DOCS = 4_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def grams(data: bytes) -> np.ndarray:
    """The codes of all N-byte windows; letters' case is folded before, runs of white space count as given."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) < N:
        return np.empty(0, np.uint64)
    code = np.zeros(len(a) - N + 1, np.uint64)
    for i in range(N):
        code = (code << np.uint64(8)) | a[i : len(a) - N + 1 + i]
    return code


def folded(text: str) -> bytes:
    return (" " + text.lower() + " ").encode("utf-8", "surrogatepass")


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Filter:
    """langs[64 w + b] has bit b in word w of a slot. A slot has as many 64-bit words as the languages need."""

    langs: list[str]
    slots: np.ndarray  # (words, SLOTS) uint64
    chance: np.ndarray  # false-positive rate of each language

    @classmethod
    def build(cls, by_lang: dict[str, np.ndarray]) -> Filter:
        langs = list(by_lang)
        slots = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), np.uint64)
        fill = np.zeros(len(langs))
        for i, lang in enumerate(langs):
            bit = np.uint64(1) << np.uint64(i % 64)
            for at in probes(by_lang[lang]):
                slots[i // 64, at] |= bit
            fill[i] = np.count_nonzero(slots[i // 64] & bit) / SLOTS
        return cls(langs, slots, fill**PROBES)

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """Popcount for each language over the n-grams."""
        where = probes(codes)
        out = np.zeros(len(self.langs))
        for w, words in enumerate(self.slots):
            mask = words[where[0]]
            for at in where[1:]:
                mask = mask & words[at]
            for b in range(min(64, len(self.langs) - 64 * w)):
                out[64 * w + b] = np.count_nonzero(mask & (np.uint64(1) << np.uint64(b)))
        return out

    def corrected(self, codes: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, (self.counts(codes) - len(codes) * self.chance) / (1 - self.chance))

    def predict(self, text: str | None, fallback: str = "und") -> tuple[str, float]:
        """The language and its share of all corrected counts; ``und`` for texts without letters."""
        if text is None or not self.langs or not has_letters(text):
            return "und", 0.0
        found = np.zeros(len(self.langs))
        data = folded(text)
        for at in range(0, len(data), 1 << 20):  # windows of the whole text, a part at a time
            found += self.corrected(grams(data[at : at + (1 << 20) + N - 1]))
        best = int(np.argmax(found))
        total = found.sum()
        return (self.langs[best], float(found[best] / total)) if total > 0 else (self.langs[0], 0.0)


def probes(codes: np.ndarray) -> list[np.ndarray]:
    x = codes * _STEP
    x ^= x >> np.uint64(29)
    x *= _MIX
    first = x >> np.uint64(44)
    second = x & np.uint64(SLOTS - 1)
    step = second | np.uint64(1)
    return [((first + np.uint64(i) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Filter:
    """A filter from rows whose language is known; at most about LEARN_DOCS documents of each, whole texts.

    Rows without text or language teach nothing; without any rows the filter knows no language. Other columns may have
    any names. Counts are summed in Spark. What the driver gets is GRAMS codes per language.
    """
    ship(rows.sparkSession)
    known = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count()
    rate = materialise(sizes.select("lang", (F.lit(float(LEARN_DOCS)) / F.col("count")).alias("rate")), "rates")
    luck = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    some = known.join(rate, "lang").where(luck < F.col("rate"))  # a row per language, as the planner sees from its files

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lang, group in pdf.groupby("lang"):
                codes, n = np.unique(np.concatenate([grams(folded(t)) for t in group["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n})

    counted = some.select("lang", "text").mapInPandas(run, "lang string, code long, n long")
    counted = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).where("n > 1")
    # Rank within hashed parts first, so that no task ranks all n-grams of a language: what is among the first GRAMS of
    # a language is among the first GRAMS of its part.
    part = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "code")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = counted.withColumn("part", F.pmod(F.hash("code"), F.lit(64)))
    best = best.withColumn("k", F.row_number().over(part)).where(F.col("k") <= GRAMS)
    best = best.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= GRAMS)
    got = best.select("lang", "code").toPandas()
    return Filter.build({str(x): g["code"].to_numpy(np.int64).view(np.uint64) for x, g in sorted(got.groupby("lang"))})


def identify(docs: DataFrame, model: Filter, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1). The model is at most 8 MB per 64 languages, whatever the data.

    Null texts and texts without letters are ``und`` with score 0. A text with letters but without a known n-gram gets
    the first language with score 0. Columns of ``docs`` that are called ``lang_pred`` or ``score`` are replaced, others
    may have any names.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        filt = held.value
        return pd.DataFrame([filt.predict(t) for t in texts], columns=["lang", "score"])

    (got,) = private(docs.columns, "_got")
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    made = docs.withColumn(got, predict(F.col(text_col).cast("string")))
    return made.select(*quoted(keep), F.col(f"{got}.lang").alias("lang_pred"), F.col(f"{got}.score").alias("score"))
