"""Quality scores from compression against good and bad text.

Two zstandard dictionaries are built from labelled text, one of each class. A
text is cut into chunks; each is compressed with either dictionary, and the
difference of the summed sizes over their sum tells which class it resembles. A
logistic curve, fitted on labelled rows that no dictionary has seen, turns the
difference into a score between 0 and 1.

Labels come from a bounded sample of labelled rows (``per_class`` rows of each
class, those of smallest hash); of a long text the sample takes pieces spread evenly
over all of it. Every row is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import written

#: Labelled rows of a class that the fit may take, and the characters of a text that it takes, in so many pieces.
PER_CLASS = 3000
SAMPLE_CHARS = 20_000
SAMPLE_PIECES = 20
DICTIONARY_BYTES = 48 << 10
CHUNK_BYTES = 1024
LEVEL = 3
PREDICT_FROM = 0.7


@dataclass
class Model:
    """Dictionaries and the calibration of their size difference."""

    good: bytes
    bad: bytes
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.5
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": []}

    def difference(self, text: str | None) -> float | None:
        """Normalised size difference, above 0 where the good dictionary compresses better; None for empty texts."""
        if not self._made:
            for content in (self.good, self.bad):
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
                own.precompute_compress(level=LEVEL)
                self._made.append(
                    zstandard.ZstdCompressor(dict_data=own, write_dict_id=False, write_content_size=False, write_checksum=False)
                )
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return None
        good, bad = (
            sum(len(c.compress(raw[i : i + CHUNK_BYTES])) for i in range(0, len(raw), CHUNK_BYTES)) for c in self._made
        )
        return (bad - good) / (bad + good)

    def score(self, text: str | None) -> float:
        """Probability of the good class; the share of good rows for an empty text."""
        d = self.difference(text)
        return self.prior if d is None else float(1 / (1 + np.exp(-np.clip(self.slope * d + self.offset, -30, 30))))


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; the raw text itself where there is too little to train on."""
    chunks = [r[i : i + CHUNK_BYTES] for r in (t.encode("utf-8", "surrogatepass") for t in texts) for i in range(0, len(r), CHUNK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[:DICTIONARY_BYTES] or b"\n" * 16


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on the penalised likelihood, x scaled to unit spread."""
    scale = float(x.std()) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-2 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def spread(text: Column, chars: int = SAMPLE_CHARS, pieces: int = SAMPLE_PIECES) -> Column:
    """A text of up to ``chars`` characters as it is; of a longer one that many, in pieces from its first character to its last."""
    size = chars // pieces
    room = F.length(text) - size
    parts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, F.floor(i * room / (pieces - 1)).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(parts, ""))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", per_class: int = PER_CLASS
) -> Model:
    """A model from ``docs`` and rows (id_col, label_col) with labels of 1 (good) or 0 (bad); others are passed over.

    Of each class the ``per_class`` ids of smallest hash are taken; this bounded list
    alone is joined to the documents, by broadcast. Where ids repeat, ``per_class``
    rows of each class stay, those of smallest hash of their text; a row counts once
    for each of its labels. Of a text ``spread`` is taken. Two thirds of the texts make the
    dictionary, the others the calibration, weighted to the classes' shares among all
    labels. A missing class leaves a model that scores every text with the share of
    good rows.
    """
    rows = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    once = rows.distinct()
    picked = [once.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t") != "")
    found = texts.join(F.broadcast(picked[0].unionAll(picked[1])), "i").select("y", spread(F.col("t")).alias("t"), F.xxhash64("t").alias("h"))
    kept = written(found, "labelled")  # read once for each class
    taken: dict[int, list[str]] = {y: [r["t"] for r in kept.where(F.col("y") == y).orderBy("h", "t").limit(per_class).collect()] for y in (0, 1)}
    if not taken[0] or not taken[1]:
        return Model(b"\n" * 16, b"\n" * 16, 0.0, float(np.log((prior + 1e-6) / (1 - prior + 1e-6))), prior)
    parts = {y: (ts[: max(1, 2 * len(ts) // 3)], ts[2 * len(ts) // 3 :] or ts) for y, ts in taken.items()}
    model = Model(_dictionary(parts[1][0]), _dictionary(parts[0][0]), prior=prior)
    x = np.array([model.difference(t) for y in (0, 1) for t in parts[y][1]])
    y = np.repeat([0.0, 1.0], [len(parts[0][1]), len(parts[1][1])])
    model.slope, offset = _logistic(x, y)
    sampled = len(parts[1][1]) / len(y)
    model.offset = offset + float(np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled)))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = PREDICT_FROM) -> DataFrame:
    """(id_col, score, predicted) of every row; null and empty texts get the share of good labels.

    A score depends on the text alone, so repeated rows score alike; one equal to
    ``cut`` is predicted 1. Other columns are not read.
    """

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([model.score(t.as_py()) for t in b.column(1)], float)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(values, pa.float64()), pa.array((values >= cut).astype(np.int32))], ["id", "score", "predicted"]
            )

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = kept.mapInArrow(scored, f"id {kept.schema['id'].dataType.simpleString()}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
