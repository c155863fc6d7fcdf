"""Quality scores from random-indexing word vectors (operator 3).

Every word has an index vector: a few +1 and -1 at places its hash names.  A
word's context vector sums the index vectors of its neighbours over the whole
corpus.  Words share 2^14 hash buckets, so the table has a fixed size; tasks
emit their part of it and Spark sums the parts.  A document is the mean and
the spread of its words' vectors, how near those of neighbouring words are to
each other, and its size, scored by a network of two layers whose logits are
divided by a temperature fitted on held-back labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bucket, encoded, mix, packs, run_hashes, runs
from .learn import Adam, fit_temperature, labelled_sample, sigmoid

BUCKET_BITS = 14
DIMS = 32
NONZERO = 4
REACH = 2
HIDDEN = 24
EPOCHS = 60
SEED = 3

#: Bytes of words (letters, digits, beyond ASCII) and of symbols; the rest is white space.
_CLASSES = np.array([0 if c <= 32 else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)


def _tokens(line: bytes, starts: np.ndarray, owners: np.ndarray):
    """Hash and owning text of each token of a pack."""
    buf = np.frombuffer(line, np.uint8)
    first, last = runs(buf, _CLASSES)
    owner = owners[np.searchsorted(starts, first, "right") - 1]
    return run_hashes(buf, first, last, SEED), owner


def _index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each word's nonzero entries."""
    h = mix(h ^ np.uint64(0xD1B54A32D192ED03))
    shifts = np.arange(NONZERO, dtype=np.uint64) * np.uint64(8)
    part = (h[:, None] >> shifts) & np.uint64(0xFF)
    return (part % np.uint64(DIMS)).astype(np.int64), np.where(part & np.uint64(0x80), 1.0, -1.0)


def context_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all buckets over all texts: an array of 2^14 rows,
    the first column the word count.  Sums of integers, so neither order nor
    partitioning changes them."""
    def part(batches):
        total = np.zeros((1 << BUCKET_BITS, DIMS))
        count = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for line, starts, owners in packs(encoded(batch.column(0).to_pylist())):
                h, owner = _tokens(line, starts, owners)
                if not len(h):
                    continue
                word = bucket(h, BUCKET_BITS).astype(np.int64)
                place, sign = _index_vectors(h)
                flat, weight = [], []
                for gap in range(1, REACH + 1):
                    near = np.flatnonzero(owner[gap:] == owner[:-gap])
                    for a, b in ((near, near + gap), (near + gap, near)):
                        flat.append((word[a, None] * DIMS + place[b]).ravel())
                        weight.append(sign[b].ravel())
                total += np.bincount(np.concatenate(flat), np.concatenate(weight),
                                     minlength=total.size).reshape(total.shape)
                count += np.bincount(word, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used], pa.int64())]
            + [pa.array(total[used, d].astype(np.int64)) for d in range(DIMS)],
            names=["bucket", "n"] + [f"d{d}" for d in range(DIMS)])

    names = ["n"] + [f"d{d}" for d in range(DIMS)]
    schema = "bucket int, " + ", ".join(f"{c} long" for c in names)
    summed = docs.select(text_col).mapInArrow(part, schema).groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in names])
    out = np.zeros((1 << BUCKET_BITS, 1 + DIMS))
    for row in summed.collect():            # at most 2^14 rows
        out[row["bucket"]] = row[1:]
    return out


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Unit context vectors; a bucket without neighbours is zero."""
    v = table[:, 1:]
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word vectors, for neighbours at either
    reach the mean product of their vectors and the share of equal ones, and
    the logarithm of the word count; zeros without words."""
    n = np.zeros(len(texts))
    near_sum = np.zeros((2 * REACH, len(texts)))
    near_n = np.zeros((REACH, len(texts)))
    total, square = np.zeros((2, len(texts), vectors.shape[1]))
    for line, starts, owners in packs(texts):
        h, owner = _tokens(line, starts, owners)
        if not len(h):
            continue
        word = bucket(h, BUCKET_BITS)
        v = vectors[word]
        for gap in range(1, REACH + 1):
            a = np.flatnonzero(owner[gap:] == owner[:-gap])
            product = np.einsum("ij,ij->i", v[a], v[a + gap])
            for row, value in ((near_n[gap - 1], None), (near_sum[2 * gap - 2], product),
                               (near_sum[2 * gap - 1], word[a] == word[a + gap])):
                row += np.bincount(owner[a], value, minlength=len(texts))
        cut = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        of = owner[cut]                     # a text has one run of tokens in a pack
        n[of] += np.diff(np.append(cut, len(owner)))
        total[of] += np.add.reduceat(v, cut, axis=0, dtype=np.float64)
        square[of] += np.add.reduceat(v * v, cut, axis=0, dtype=np.float64)
    size = np.maximum(n, 1)[:, None]
    mean = total / size
    near = near_sum / np.maximum(np.repeat(near_n, 2, axis=0), 1)
    return np.hstack([mean, np.sqrt(np.maximum(square / size - mean ** 2, 0)), near.T, np.log1p(n)[:, None]])


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray] | None:
    """Network on pooled vectors; every fifth row is held back for the
    temperature.  None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    held, use = order[::5], np.setdiff1d(order, order[::5])
    mean, scale = x[use].mean(0), x[use].std(0) + 1e-6
    z = (x - mean) / scale
    weight = weight / weight.mean()
    p = {"a": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
         "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
    adam = Adam(p, 0.005)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(use), max(1, len(use) // 64)):
            h = np.tanh(z[rows] @ p["a"] + p["b"])
            err = weight[rows] * (sigmoid(h @ p["c"] + p["d"]) - y[rows]) / len(rows)
            back = np.outer(err, p["c"]) * (1 - h * h)
            adam.update({"a": z[rows].T @ back, "b": back.sum(0), "c": h.T @ err, "d": err.sum(keepdims=True)}, 1e-3)
    model = {**p, "mean": mean, "scale": scale, "t": np.ones(1)}
    if len(set(y[held].tolist())) == 2:
        model["t"] = np.array([fit_temperature(logits(model, x[held]), y[held], weight[held])])
    return model


def logits(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    h = np.tanh((x - model["mean"]) / model["scale"] @ model["a"] + model["b"])
    return (h @ model["c"] + model["d"]) / model["t"]


def score(text: Column, vectors: np.ndarray, model: dict[str, np.ndarray] | None) -> Column:
    """Column of probabilities that a text is good; 0.5 without a model."""
    @arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        rows = encoded(texts.to_pylist())
        if model is None:
            return pa.array(np.full(len(rows), 0.5))
        return pa.array(sigmoid(logits(model, pooled(rows, vectors))))
    return run(text)


def quality(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to each row (columns of these
    names are replaced).

    ``labels`` (doc_id, quality) are the rows to learn from; word vectors come
    from all texts.  Null and empty texts are scored as texts without words.
    Without labels of both classes every score is 0.5.  Rows are scored one by
    one, so repeats and null ids come out as they come in; an empty table gives
    an empty result.
    """
    plain = docs.select("doc_id", F.col(text_col).alias("text"))
    vectors = word_vectors(context_table(plain, "text"))
    texts, y, weight = labelled_sample(plain, labels, "quality")
    model = train(pooled(texts, vectors), y, weight) if len(texts) else None
    return docs.withColumn("score", score(F.col(text_col), vectors, model)).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
