"""Quality classification by compression.

zstandard dictionaries are built in pairs, one from texts labelled good and one from texts labelled bad. What shares more
with the good texts compresses better with their dictionary. A text is compressed in pieces of PIECE bytes, each primed
with the dictionaries anew, so that every part of a long text weighs alike; a piece's difference is
(bad - good) / plain, where good and bad are the mean sizes over the pairs and plain is the size without a dictionary.
The text's difference is its lowest piece's: junk in one part is junk in the text. That difference alone is the feature.
A monotone curve, fitted on other labelled texts than the dictionaries are made from, makes a calibrated probability of
it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import ship, turn_to
from graphloom.storage import materialise

PIECE = 448
LEVEL = 1
#: Bytes of a dictionary, and pairs of dictionaries.
DICTIONARY, PAIRS = 112 * 1024, 3
#: Labelled rows of each class that are learned from, at most about (by a hash of their id): half make the
#: dictionaries, half the curve, on whole texts. The bound of the fit.
LEARN_DOCS = 3_000
#: Pieces of each class that dictionaries are made from, at most about, drawn evenly from all pieces of those rows.
#: The other bound of the fit.
LEARN_PIECES = 30_000
#: Labelled texts that each step of the curve is drawn towards the overall share by.
PULL = 0.5


@dataclass
class Model:
    pairs: list[tuple[bytes, bytes]]  # of dictionaries: good, bad
    at: np.ndarray = field(default_factory=lambda: np.zeros(1))  # differences ...
    share: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))  # ... and the share of good texts there

    def coders(self) -> tuple[list, list, object]:
        import zstandard as z

        if not hasattr(self, "_coders"):
            coder = lambda d: z.ZstdCompressor(level=LEVEL, dict_data=as_dictionary(d), write_content_size=False, write_dict_id=False)
            good, bad = ([coder(p[i]) for p in self.pairs] for i in (0, 1))
            self._coders = good, bad, z.ZstdCompressor(level=LEVEL, write_content_size=False)
        return self._coders

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_coders"}

    def difference(self, text: str | None) -> float:
        return difference(text, *self.coders())

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.share)


def as_dictionary(data: bytes):
    import zstandard as z

    raw = z.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else z.DICT_TYPE_RAWCONTENT
    d = z.ZstdCompressionDict(data, dict_type=raw)
    d.precompute_compress(level=LEVEL)
    return d


def pieces_of(text: str | None) -> list[bytes]:
    """The whole text in pieces; a short rest belongs to the last one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    if len(pieces) > 1 and len(pieces[-1]) < PIECE // 2:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    return pieces


def difference(text: str | None, good: list, bad: list, plain) -> float:
    """The lowest of the pieces' normalised differences; 0 for an empty text."""
    lowest = None
    for piece in pieces_of(text):
        apart = sum(len(c.compress(piece)) for c in bad) - sum(len(c.compress(piece)) for c in good)
        here = apart / (len(plain.compress(piece)) * max(1, len(good)))
        lowest = here if lowest is None else min(lowest, here)
    return lowest or 0.0


def build_dictionary(samples: list[bytes]) -> bytes:
    """Trained by zstandard; where the samples are too few for that, their plain concatenation."""
    import zstandard as z

    if not samples:
        return b""
    try:
        return z.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least-squares curve that never falls (pool adjacent violators), as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sums of x and y, rows
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [s + t for s, t in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    share = (b[:, 1] + PULL * y.mean()) / (b[:, 2] + PULL)
    return b[:, 0] / b[:, 2], np.maximum.accumulate(share)


def choose(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """About LEARN_DOCS labels of each class (all if fewer), by a hash of the id."""
    sizes = {r[0]: r[1] for r in labels.where(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    rate = F.when(F.col(label_col) == 1, LEARN_DOCS / max(1, sizes.get(1, 1))).otherwise(LEARN_DOCS / max(1, sizes.get(0, 1)))
    luck = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) / 1_000_000
    return labels.where(F.col(label_col).isin(0, 1) & (luck < rate))


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """Fit on (id, text, 0/1) rows that ``choose`` has bounded.

    The driver gets LEARN_PIECES pieces of each class and one number for each row of the curve; whole texts stay in the
    executors. Null texts are empty, rows with another label are left out. With no rows, or rows of one class only, every
    score is the smoothed share of good rows.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(label_col).cast("int").alias("y"), F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(2)).alias("half"),
    ).where("y in (0, 1)")
    rows = materialise(rows, "labelled")
    sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("half") == 0, F.octet_length("text"))).alias("bytes")).collect()
    count = {r["y"]: r["n"] for r in sizes}
    rate = {r["y"]: LEARN_PIECES * PIECE / max(1, r["bytes"] or 0) for r in sizes}

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for i, text, y in zip(pdf["id"], pdf["text"], pdf["y"], strict=True):
                for k, piece in enumerate(pieces_of(text)):
                    luck = zlib.crc32(f"{i} {k}".encode())
                    if luck < rate[y] * 2**32:
                        out.append((y, luck, piece))
            yield pd.DataFrame(out, columns=["y", "luck", "piece"])

    share = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    if len(count) < 2:  # nothing to tell apart
        return Model([], share=np.full(1, share))
    got = rows.where("half = 0").select("id", "text", "y").mapInPandas(cut, "y int, luck long, piece binary").toPandas()
    got = got.assign(piece=got["piece"].map(bytes)).sort_values(["y", "luck", "piece"])
    samples = {y: list(got["piece"][got["y"] == y]) for y in (0, 1)}
    model = Model([tuple(build_dictionary(samples[y][k::PAIRS]) for y in (1, 0)) for k in range(PAIRS)], share=np.full(1, share))
    found = rows.where("half = 1").select("y", _differences(rows, model)("text").alias("x")).toPandas()
    if found["y"].nunique() == 2:
        model.at, model.share = fit_curve(found["x"].to_numpy(float), found["y"].to_numpy(float))
    return model


def _differences(df: DataFrame, model: Model):
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def differ(texts: pd.Series) -> pd.Series:
        turn_to("quality")
        m = held.value
        return pd.Series([m.difference(t) for t in texts], dtype="float64")

    return differ


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column with the probability that the text is good; null counts as empty. Other columns may have any names.

    The model is at most about 0.7 MB, whatever the data.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        turn_to("quality")
        m = held.value
        return pd.Series(m.score(np.array([m.difference(t) for t in texts], float)), dtype="float64")

    return probability(F.col(text_col).cast("string"))
