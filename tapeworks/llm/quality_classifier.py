"""Quality by the votes of labelled neighbours in a latent-semantic space.

A text becomes a vector of hashed byte triples (tf-idf, unit length) and of its shape (shares of repeated words, capitals and
punctuation, and its length, each spread over soft bins).  A truncated singular value decomposition of the labelled sample gives
the latent space.  The sample's vectors and the projection are broadcast (``SAMPLE * DIM + WIDTH * DIM`` floats, a fixed bound), every document's
exact cosine with every labelled vector is computed block by block, and the ``NEIGHBOURS`` nearest labels vote with weight similarity^4.

``SAMPLE`` is the documented bound of the fit: that many labelled rows at most, half of each label, chosen by a hash of doc_id.
Labels of held-out rows (crc32 of doc_id as text, mod 3 equal to 1) are never read; lang, source and doc_id are no inputs of a score.

Null and empty texts are scored by their shape alone.  Null labels are skipped, equal rows get equal scores, a null doc_id is not
held out, without any label every score is 0.5, an empty table gives an empty result, other columns are ignored (``keep_good`` passes them on).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pick

SAMPLE = 2000
DIM = 32
NEIGHBOURS = 15
HASHED = 2048
BINS = 10
SHAPES = 4
SHAPE_WEIGHT = 0.8
WIDTH = HASHED + SHAPES * (BINS + 1)
BLOCK = 512


def features(text: str | None) -> np.ndarray:
    """Log counts of hashed byte triples, followed by the binned shape, of one whole text."""
    raw = (text or "").encode()
    b = np.frombuffer(raw, np.uint8)
    out = np.zeros(WIDTH, np.float32)
    if len(b) >= 3:
        h = b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(40503) + b[2:] * np.uint32(2246822519)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        out[:HASHED] = np.log1p(np.bincount((h >> np.uint32(21)).astype(np.int64), minlength=HASHED))
    words = raw.split()
    count = np.bincount(b, minlength=128)
    plain = count[48:58].sum() + count[65:91].sum() + count[97:123].sum() + count[32] + count[10]
    n = max(1, len(b))
    shape = (1 - len(set(words)) / max(1, len(words)), count[65:91].sum() / n, (count[:128].sum() - plain) / n, min(1.0, len(words) / 200))
    for i, x in enumerate(shape):  # the share between two neighbouring bins is split between them
        at = min(float(np.sqrt(x)) * BINS, BINS - 1e-6)
        k = HASHED + i * (BINS + 1) + int(at)
        out[k], out[k + 1] = (1 - at % 1) * SHAPE_WEIGHT, at % 1 * SHAPE_WEIGHT
    return out


@dataclass
class NeighbourModel:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        a = x.copy()
        a[:, :HASHED] *= self.idf
        a[:, :HASHED] /= np.maximum(np.linalg.norm(a[:, :HASHED], axis=1, keepdims=True), 1e-9)
        z = a @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), BLOCK):
            cosine = self.latent(np.stack([features(t) for t in texts[i : i + BLOCK]])) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** 4
            out[i : i + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(np.round(out, 6), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the sample; the features are computed where the texts are, and only they are collected."""
    usable = pick(labels, doc_id="long", quality="int").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    halves = [usable.filter(F.col("quality") == v).dropDuplicates(["doc_id"]).orderBy(*order).limit(rows // 2) for v in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    rows_of = pick(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def vectors(batch: pa.RecordBatch) -> pa.Table:
        x = [features(t).tobytes() for t in batch.column("text").to_pylist()]
        return pa.table([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.binary())], names=["doc_id", "quality", "x"])

    found = map_arrow(rows_of, vectors, "doc_id long, quality int, x binary").dropDuplicates(["doc_id", "quality"]).collect()
    found.sort(key=lambda r: (r["doc_id"], r["quality"]))
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in found]) if found else np.zeros((0, WIDTH), np.float32)
    return x, np.array([r["quality"] for r in found], np.float64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, dim: int = DIM) -> NeighbourModel:
    """The latent space and the labelled vectors, from ``rows`` labelled documents at most."""
    x, y = labelled_sample(docs, labels, rows)
    idf = (np.log((1 + len(x)) / (1 + (x[:, :HASHED] > 0).sum(0))) + 1).astype(np.float32)
    model = NeighbourModel(idf, np.eye(WIDTH, dtype=np.float32), x, y)
    if not len(y):
        return model
    a = x.copy()
    a[:, :HASHED] *= idf
    a[:, :HASHED] /= np.maximum(np.linalg.norm(a[:, :HASHED], axis=1, keepdims=True), 1e-9)
    dim = min(dim, len(a))
    q = a.T @ np.random.default_rng(0).standard_normal((len(a), dim + 10)).astype(np.float32)
    for _ in range(4):  # subspace iteration: the leading right singular vectors without the full decomposition
        q = a.T @ (a @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    _, v = np.linalg.eigh((a @ q).T @ (a @ q))
    model.projection = np.ascontiguousarray((q @ v[:, ::-1])[:, :dim])
    model.vectors = model.latent(x)
    return model


def quality_scores(docs: DataFrame, model: NeighbourModel) -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1) and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.table([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    scored = map_arrow(pick(docs, doc_id="long", text="string"), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: NeighbourModel) -> DataFrame:
    """The documents predicted to be of quality 1, with all their columns; decided in place, without moving texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.Table:
        good = shared.value.scores(batch.column("text").cast(pa.string()).to_pylist()) >= 0.5
        return pa.Table.from_batches([batch]).filter(pa.array(good))

    return map_arrow(docs, run, docs.schema)
