"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text is two weighted profiles: of the shapes of its words (case, closing characters, length,
repetition of the word before) and of the words themselves. Latent semantic analysis of a bounded
number of labelled documents (``train_docs``) gives the space; their vectors, at most
1.5 * train_docs rows of ``rank`` numbers, are broadcast. Every document is compared with all of them
by blocked cosine products, and the labels of its nearest neighbours vote by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, per_document, record, unclashed, utf8, with_outputs
from .sampling import hash_sample
from .wordhash import byte_values, mixed, span_hashes, word_bounds

#: Slots of each profile, and the weight of the words beside the shapes.
SLOTS, WORD_WEIGHT = 4096, 0.3
VALUES = byte_values(13)
#: Byte classes: every ASCII character that is no letter or digit is a class of its own.
CLASS = np.arange(256)
CLASS[48:58], CLASS[65:91], CLASS[97:123], CLASS[128:] = 48, 65, 97, 97
#: Documents compared at a time.
BLOCK = 512


def profile(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots (shapes first, then words) and counts of a text."""
    if not text:
        return np.empty(0, np.int64), np.empty(0)
    start, end = word_bounds(text)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0)
    data = np.frombuffer(text, np.uint8)
    kind = CLASS[data]
    upper = np.concatenate(([0], np.cumsum(kind == 65)))
    size = end - start
    word = span_hashes(text, start, end, VALUES)
    again = np.concatenate(([False], word[1:] == word[:-1]))
    shape = kind[start].astype(np.uint64)
    for back in (1, 2, 3):
        shape = shape * np.uint64(131) + kind[np.maximum(end - back, start)].astype(np.uint64)
    shape = shape * np.uint64(8) + (upper[end] - upper[start] > size // 2).astype(np.uint64) * np.uint64(2) + again
    shape = shape * np.uint64(8) + np.minimum(size // 3, 7).astype(np.uint64)
    slots = np.concatenate([mixed(shape) % np.uint64(SLOTS), word % np.uint64(SLOTS) + np.uint64(SLOTS)]).astype(np.int64)
    counts = np.bincount(slots, minlength=2 * SLOTS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


def weighted(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf values with each profile scaled to its length."""
    value = np.log1p(counts) * idf[slots]
    for half, weight in ((slots < SLOTS, 1.0), (slots >= SLOTS, WORD_WEIGHT)):
        norm = np.sqrt((value[half] ** 2).sum())
        if norm:
            value[half] *= weight / norm
    return value


@dataclass
class Space:
    idf: np.ndarray
    axes: np.ndarray  # slots x rank
    vectors: np.ndarray  # labelled rows x rank, unit length
    labels: np.ndarray

    def place(self, profiles: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors of profiles (zero for an empty one)."""
        out = np.zeros((len(profiles), self.axes.shape[1]), np.float32)
        for i, (slots, counts) in enumerate(profiles):
            if len(slots):
                out[i] = weighted(slots, counts, self.idf).astype(np.float32) @ self.axes[slots]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def scores(self, vectors: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
        out = np.full(len(vectors), self.labels.mean())
        k = min(neighbours, len(self.labels))
        for at in range(0, len(vectors), BLOCK):
            cosine = vectors[at : at + BLOCK] @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** sharpness
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[at : at + BLOCK] = np.where(total > 0, vote, out[at : at + BLOCK])
        return np.clip(out, 0, 1)


def fit(profiles: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int) -> Space:
    """Truncated SVD of the labelled tf-idf rows by subspace iteration."""
    df = np.bincount(np.concatenate([s for s, _ in profiles]), minlength=2 * SLOTS)
    idf = np.log((1 + len(profiles)) / (1 + df)) + 1
    rows = np.zeros((len(profiles), 2 * SLOTS), np.float32)
    for i, (slots, counts) in enumerate(profiles):
        rows[i, slots] = weighted(slots, counts, idf)
    rank = min(rank, len(profiles))
    axes = np.random.default_rng(3).normal(size=(2 * SLOTS, rank)).astype(np.float32)
    for _ in range(5):
        axes, _ = np.linalg.qr(rows.T @ (rows @ axes))
    space = Space(idf, np.ascontiguousarray(axes), np.empty((0, rank), np.float32), labels)
    space.vectors = space.place(profiles)
    return space


def labelled_profiles(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str, modulus: int,
    remainder: int, train_docs: int,
) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Profiles and labels of a bounded sample of the labelled training rows."""
    usable = labels.where(F.col(label_col).isNotNull() & (fold(label_id_col, modulus) != remainder))
    usable = usable.groupBy(F.col(label_id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label"))
    sample = hash_sample(usable, "id", train_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(sample, "id")

    def rows():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [profile(t) for t in utf8(batch.column("text"))]
            return record(
                id=batch.column("id"), label=batch.column("label").cast(pa.float64()),
                slots=pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32())),
                counts=pa.array([c.astype(np.float32) for _, c in found], pa.list_(pa.float32())),
            )

        return f

    made = per_document(texts, "id long, label double, slots array<int>, counts array<float>", rows, "text")
    kept = made.orderBy("id", F.xxhash64("slots", "counts")).limit(2 * train_docs).toArrow()
    profiles = [
        (np.array(s, np.int64), np.array(c, float))
        for s, c in zip(kept["slots"].to_pylist(), kept["counts"].to_pylist(), strict=True)
    ]
    return profiles, kept["label"].to_numpy()


def quality_score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    label_col: str = "quality", modulus: int = 5, remainder: int = 0, train_docs: int = 2500, rank: int = 48,
    neighbours: int = 25, sharpness: float = 8.0, threshold: float = 0.3, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: id, the carried columns, score, predicted.

    score is the weighted share of label 1 among the nearest labelled documents; a null, empty or
    wordless text gets the share of label 1 in the sample. Labels train only where the crc32 of
    their id modulo ``modulus`` is not ``remainder``; a row that is labelled twice counts as 0 if
    any label is. With no labels every score is 0.5. carry may not name an output.
    """
    unclashed(id_col, carry, ("score", "predicted"))
    profiles, y = labelled_profiles(docs, labels, id_col, text_col, label_id_col, label_col, modulus, remainder, train_docs)
    some = [i for i, (s, _) in enumerate(profiles) if len(s)]
    space = fit([profiles[i] for i in some], y[some], rank) if some else None
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def make():
        def f(texts):
            if shared.value is None:
                score = np.full(len(texts), 0.5)
            else:
                score = shared.value.scores(shared.value.place([profile(t) for t in texts]), neighbours, sharpness)
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return f

    keep = [F.col(id_col), *[F.col(c) for c in carry]]
    return with_outputs(docs, keep, F.col(text_col), {"score": "double", "predicted": "int"}, make)
