"""Toxicity by a bidirectional gated recurrent network (operator 7).

Inputs: for each word (lower case) the vector and the log odds of its hash,
the mean vector of its 5-byte grams (the byte before the word included) and
their largest log odds.  A gated recurrent layer runs over a window of words in
either direction, attention pools its states, and a logistic unit scores the
window.  Every text is covered by overlapping windows and has the score of its
worst window.

Training (numpy) learns from documents as bags of windows: the worst window of
each document carries its label.  The log odds say how much likelier a bucket
is in toxic training documents; a training document sees those of the other
folds.  Buckets in few documents have no vector.  The logits are calibrated on
held-back labelled documents so that a score of 0.7 is the best cut there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bucket, encoded, keep_caches, packs, run_hashes, runs
from .learn import Adam, labelled_sample, sigmoid

WINDOW = 32
STRIDE = 24
WORD_BITS = 18
GRAM_BITS = 16
GRAM = 5
WIDTH = 12
HIDDEN = 8
#: Passes over the training documents, at least so many steps, at most so many passes.
EPOCHS = 8
STEPS = 300
MOST_EPOCHS = 30
#: A bucket in RARE documents counts half of its log odds; one in fewer than
#: SEEN has no vector.  FOLDS of the training documents see each other's odds.
RARE = 3
SEEN = 10
FOLDS = 5
DECAY = 0.03
BATCH = 64
CHUNK = 2048
DOCS_AT_ONCE = 200
SEED = 7
CUT = 0.7
#: Bytes that a long text's pieces share: more than WINDOW words of usual length.
OVERLAP = 1024
#: Bytes of a pack that are hashed at a time: a byte needs some 100 bytes beside it.
HASHED_BYTES = 1 << 18

_CLASSES = np.array([1 if c >= 128 or chr(c).isalnum() else 0 for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _runs_of_pieces(pack):
    """A pack (see ``packs``) as smaller ones of about HASHED_BYTES, cut between pieces."""
    line, starts, owners = pack
    first = 0
    while first < len(starts):
        stop = max(first + 1, int(np.searchsorted(starts, starts[first] + HASHED_BYTES)))
        end = starts[stop] if stop < len(starts) else len(line)
        yield line[starts[first]:end], starts[first:stop] - starts[first], owners[first:stop]
        first = stop


class Words:
    """Inputs of some texts: bucket of each word, buckets of its grams (from
    gram_at[i]), and the windows as first word, length and owning text."""

    def __init__(self, texts: list[bytes] | None = None, pack=None):
        self.word, self.gram, self.gram_at, self.first, self.size, self.owner = [], [], [], [], [], []
        n_words = n_grams = 0
        whole = packs(texts, OVERLAP) if pack is None else [pack]
        for line, starts, owners in (part for one in whole for part in _runs_of_pieces(one)):
            buf = _LOWER[np.frombuffer(line, np.uint8)]
            # upper-case letters of the Latin-1 block: C3 80-9E, but for the sign C3 97
            high = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1
            buf[high] += 0x20
            buf[_CLASSES[buf] == 0] = 32
            buf = np.concatenate([[np.uint8(32)], buf])     # a byte before the first word
            s, e = runs(buf, _CLASSES)
            if not len(s):
                continue
            count = np.maximum(1, e - s + 2 - GRAM)
            at = np.cumsum(count) - count
            place = np.repeat(s - 1 - at, count) + np.arange(int(count.sum()))
            stop = np.minimum(place + GRAM, np.repeat(e, count))
            self.word.append(bucket(run_hashes(buf, s, e, SEED), WORD_BITS))
            self.gram.append(bucket(run_hashes(buf, place, stop, SEED + 1), GRAM_BITS))
            self.gram_at.append(at + n_grams)
            piece = np.searchsorted(starts, s - 1, "right") - 1
            cut = np.concatenate([[0], np.flatnonzero(piece[1:] != piece[:-1]) + 1])
            length = np.diff(np.append(cut, len(piece)))
            windows = 1 + np.maximum(0, -(-(length - WINDOW) // STRIDE))
            of = np.repeat(np.arange(len(cut)), windows)
            step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            # the last window ends with the piece
            begin = np.minimum(step * STRIDE, np.maximum(0, length[of] - WINDOW))
            self.first.append(n_words + cut[of] + begin)
            self.size.append(np.minimum(length[of], WINDOW))
            self.owner.append(owners[piece[cut]][of])
            n_words += len(s)
            n_grams += len(place)
        self.odds = None
        for name in ("word", "gram", "gram_at", "first", "size", "owner"):
            parts = getattr(self, name)
            setattr(self, name, np.concatenate(parts) if parts else np.zeros(0, np.int64))


def inputs(model: dict, words: Words) -> np.ndarray:
    """Input vector of each word."""
    out = np.empty((len(words.word), 2 * WIDTH + 2), np.float32)
    if len(out):
        out[:, :WIDTH] = model["word"][model["word_row"][words.word]]
        count = np.diff(np.append(words.gram_at, len(words.gram)))
        out[:, WIDTH:-2] = np.add.reduceat(model["gram"][model["gram_row"][words.gram]], words.gram_at,
                                           axis=0) / count[:, None]
        out[:, -2:] = _odds(model, words) if words.odds is None else words.odds
    return out


def _odds(model: dict, words: Words) -> np.ndarray:
    """Log odds of each word, and the largest of its grams."""
    return np.stack([model["word_odds"][words.word],
                     np.maximum.reduceat(model["gram_odds"][words.gram], words.gram_at)], 1)


def _cells(model: dict, gates: np.ndarray, real: np.ndarray | None, keep: list | None):
    """States (steps, 2, rows, HIDDEN) of both directions over projected
    windows (steps, 2, rows, 3 HIDDEN), the second direction's steps reversed."""
    steps, _, rows, _ = gates.shape
    h = np.zeros((2, rows, HIDDEN), np.float32)
    states = np.empty((steps, 2, rows, HIDDEN), np.float32)
    for t in range(steps):
        back = h @ model["u"]
        zr = 1 / (1 + np.exp(-(gates[t, ..., :2 * HIDDEN] + back[..., :2 * HIDDEN])))
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        n = 2 / (1 + np.exp(-2 * (gates[t, ..., 2 * HIDDEN:] + r * back[..., 2 * HIDDEN:]))) - 1
        new = n + z * (h - n)
        if real is not None:
            new = np.where(real[t], new, h)
        if keep is not None:
            keep.append((h, z, r, n, back[..., 2 * HIDDEN:]))
        states[t] = h = new
    return states


def _gather(projected: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Gates of windows given as (steps, rows) of word numbers."""
    steps, rows = index.shape
    out = np.empty((steps, 2, rows, 3 * HIDDEN), np.float32)
    out[:, 0] = projected[index, :3 * HIDDEN]
    out[:, 1] = projected[index[::-1], 3 * HIDDEN:]
    return out


def _index(first: np.ndarray, size: np.ndarray):
    """Word numbers (steps, rows) of windows, and which are real (None: all)."""
    steps = int(size.max())
    t = np.arange(steps)[:, None]
    index = first[None, :] + np.minimum(t, size[None, :] - 1)
    if int(size.min()) == steps:
        return index, None
    forward = t < size[None, :]
    return index, np.stack([forward, forward[::-1]], 1)[..., None]


def _pool(model: dict, states: np.ndarray, real):
    """Attention pooling: logits of the windows and what backward needs."""
    both = np.concatenate([states[:, 0], states[::-1, 1]], -1)
    key = np.tanh(both @ model["att"] + model["att_b"])
    e = key @ model["att_v"]
    if real is not None:
        e = np.where(real[:, 0, :, 0], e, -1e30)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = (w[..., None] * both).sum(0)
    return pooled @ model["out"] + model["out_b"][0], (both, key, w, pooled)


def window_logits(model: dict, words: Words) -> np.ndarray:
    """Logit of every window."""
    out = np.zeros(len(words.first), np.float32)
    for at in range(0, len(out), CHUNK):
        near = np.arange(at, min(at + CHUNK, len(out)))
        lo, hi = int(words.first[near].min()), int((words.first[near] + words.size[near]).max())
        projected = inputs(model, _some(words, np.arange(lo, hi))) @ model["w"] + model["b"]
        whole = words.size[near] == WINDOW               # these need no mask
        for rows in (near[whole], near[~whole]):
            if len(rows):
                index, real = _index(words.first[rows] - lo, words.size[rows])
                out[rows] = _pool(model, _cells(model, _gather(projected, index), real, None), real)[0]
    return out


def gradients(model: dict, words: Words, rows: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean log loss of some windows."""
    index, real = _index(words.first[rows], words.size[rows])
    steps = len(index)
    used, local = np.unique(index, return_inverse=True)
    local = local.reshape(index.shape)
    x = inputs(model, _some(words, used))
    projected = x @ model["w"] + model["b"]
    keep: list = []
    states = _cells(model, _gather(projected, local), real, keep)
    logit, (both, key, w, pooled) = _pool(model, states, real)
    err = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {"out": pooled.T @ err, "out_b": err.sum(keepdims=True)}
    d_pooled = err[:, None] * model["out"]
    d_w = (both * d_pooled).sum(-1)
    d_e = w * (d_w - (w * d_w).sum(0))
    d_key = d_e[..., None] * model["att_v"] * (1 - key * key)
    g["att_v"] = np.einsum("tbk,tb->k", key, d_e)
    g["att"] = np.einsum("tbh,tbk->hk", both, d_key)
    g["att_b"] = d_key.sum((0, 1))
    d_both = w[..., None] * d_pooled + d_key @ model["att"].T
    d_states = np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]], 1)
    g["u"] = np.zeros_like(model["u"])
    d_gates = np.zeros((steps, 2, len(rows), 3 * HIDDEN), np.float32)
    d_h = np.zeros((2, len(rows), HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, back_n = keep[t]
        d = d_states[t] + d_h
        live = d if real is None else np.where(real[t], d, 0)
        d_n = live * (1 - z) * (1 - n * n)
        d_z = live * (h - n) * z * (1 - z)
        d_r = d_n * back_n * r * (1 - r)
        d_back = np.concatenate([d_z, d_r, d_n * r], -1)
        d_gates[t] = np.concatenate([d_z, d_r, d_n], -1)
        g["u"] += np.swapaxes(h, 1, 2) @ d_back
        d_h = live * z + d_back @ np.swapaxes(model["u"], 1, 2)
        if real is not None:
            d_h = d_h + np.where(real[t], 0, d)
    d_projected = np.zeros_like(projected)
    np.add.at(d_projected[:, :3 * HIDDEN], local, d_gates[:, 0])
    np.add.at(d_projected[:, 3 * HIDDEN:], local, d_gates[::-1, 1])
    g["w"], g["b"] = x.T @ d_projected, d_projected.sum(0)
    d_x = d_projected @ model["w"].T
    part = _some(words, used)
    count = np.diff(np.append(part.gram_at, len(part.gram)))
    for name, at, d in (("word", part.word, d_x[:, :WIDTH]),
                        ("gram", part.gram, np.repeat(d_x[:, WIDTH:-2] / count[:, None], count, axis=0))):
        g[name] = np.zeros_like(model[name])
        np.add.at(g[name], model[name + "_row"][at], d)
        g[name][0] = 0
    return g


def _some(words: Words, used: np.ndarray) -> Words:
    """The inputs of some words alone."""
    part = Words(pack=(b"\n", np.zeros(1, int), np.zeros(1, int)))
    begin = words.gram_at[used]
    count = np.append(words.gram_at, len(words.gram))[used + 1] - begin
    part.word = words.word[used]
    part.odds = None if words.odds is None else words.odds[used]
    part.gram_at = np.cumsum(count) - count
    part.gram = words.gram[np.repeat(begin - part.gram_at, count) + np.arange(int(count.sum()))]
    return part


def _document_counts(buckets: np.ndarray, owner: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Documents of class 0 and of class 1 that each bucket is in; ``owner`` is
    in order, and some documents at a time are looked at."""
    out = np.zeros((2, 1 << bits), np.int64)
    cuts = np.searchsorted(owner, np.arange(0, len(y) + DOCS_AT_ONCE, DOCS_AT_ONCE))
    for a, b in zip(cuts, cuts[1:]):
        seen = np.unique(owner[a:b].astype(np.int64) << bits | buckets[a:b])
        label = y[seen >> bits]
        for k in (0, 1):
            out[k] += np.bincount(seen[label == k] & ((1 << bits) - 1), minlength=1 << bits)
    return out


def _log_odds(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log odds of presence in class 1, drawn towards 0 for rare buckets."""
    odds = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
    both = n.sum(0)
    return (odds * both / (both + RARE)).astype(np.float32)


def train(texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict | None:
    """A model of labelled texts, that of the pass which ranks the held-back
    fifth best; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(SEED)
    held = rng.permutation(len(y))[::5]
    fit = np.setdiff1d(np.arange(len(y)), held)
    words = Words([texts[i] for i in fit])
    of, label = words.owner, y[fit]
    doc_of_word = np.zeros(len(words.word), np.int32)
    for k in range(WINDOW):
        at = words.first + np.minimum(k, words.size - 1)
        doc_of_word[at] = of
    count = np.diff(np.append(words.gram_at, len(words.gram)))
    doc_of_gram = np.repeat(doc_of_word, count)
    f32 = np.float32
    model = {"w": rng.normal(0, 0.3, (2 * WIDTH + 2, 6 * HIDDEN)).astype(f32), "b": np.zeros(6 * HIDDEN, f32),
             "u": rng.normal(0, 0.3, (2, HIDDEN, 3 * HIDDEN)).astype(f32),
             "att": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)).astype(f32), "att_b": np.zeros(HIDDEN, f32),
             "att_v": rng.normal(0, 0.5, HIDDEN).astype(f32),
             "out": rng.normal(0, 0.5, 2 * HIDDEN).astype(f32), "out_b": np.zeros(1, f32)}
    total = np.bincount(label, minlength=2)
    words.odds = np.empty((len(words.word), 2), f32)
    for name, at, owner, bits in (("word", words.word, doc_of_word, WORD_BITS),
                                  ("gram", words.gram, doc_of_gram, GRAM_BITS)):
        n = _document_counts(at, owner, label, bits)
        known = n.sum(0) >= SEEN
        model[name + "_row"] = np.where(known, np.cumsum(known), 0).astype(np.int32)    # row 0: no vector
        model[name] = np.zeros((int(known.sum()) + 1, WIDTH), f32)
        model[name + "_odds"] = _log_odds(n, total)
        odds = np.empty(len(at), f32)
        for k in range(FOLDS):
            mine = owner % FOLDS == k
            part = _document_counts(at[mine], owner[mine], label, bits)
            odds[mine] = _log_odds(n - part, total - np.bincount(label[k::FOLDS], minlength=2))[at[mine]]
        words.odds[:, 0 if name == "word" else 1] = odds if name == "word" else np.maximum.reduceat(odds, words.gram_at)
    adam = Adam({k: v for k, v in model.items() if not k.endswith(("_row", "_odds"))}, 0.003)
    docs, best = np.unique(of), None
    batches = max(1, len(docs) // BATCH)
    for _ in range(min(max(EPOCHS, STEPS // batches), MOST_EPOCHS)):
        z = window_logits(model, words)
        order = np.lexsort((z, of))
        worst = order[np.flatnonzero(np.append(of[order][1:] != of[order][:-1], True))]
        for part in np.array_split(rng.permutation(len(docs)), batches):
            adam.update(gradients(model, words, worst[part], label[docs[part]].astype(f32)))
            for name in ("word", "gram"):
                model[name] *= 1 - DECAY
        z = document_logits(model, [texts[i] for i in held])
        rank = _ranking(z, y[held])
        if best is None or rank >= best[0]:
            best = rank, {k: v.copy() for k, v in model.items()}, z
    model = best[1]
    model["line"] = _calibrated(best[2], y[held], weight[held])
    return model


def _ranking(z: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of either class in the right order; 0 without both."""
    a, b = np.sort(z[y == 0]), z[y == 1]
    below = np.searchsorted(a, b, "left") + np.searchsorted(a, b, "right")
    return float(below.sum()) / max(1, 2 * len(a) * len(b))


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and offset of the log odds: the slope by logistic regression, the
    offset so that CUT falls on the cut of best F1 (the middle of the widest
    gap of equally good ones), however many documents there are."""
    if len(set(y.tolist())) < 2:
        return np.array([1.0, 0.0])
    a, b = 1.0, 0.0
    for _ in range(200):
        err = weight / weight.mean() * (sigmoid(a * z + b) - y)
        a, b = a - 0.1 * float(np.mean(err * z)), b - 0.1 * float(np.mean(err))
    s = np.unique(z)
    cuts = (s[1:] + s[:-1]) / 2
    hit = np.array([[(weight * ((z > c) & (y == 1))).sum(), (weight * (z > c)).sum()] for c in cuts])
    f1 = 2 * hit[:, 0] / (hit[:, 1] + (weight * y).sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    cut = cuts[best[np.argmax((s[1:] - s[:-1])[best])]]
    a = max(a, 0.05)
    return np.array([a, np.log(CUT / (1 - CUT)) - a * cut])


def document_logits(model: dict, texts: list[bytes]) -> np.ndarray:
    """Logit of the worst window of each text; without a word, that of a text
    below every window seen (-20)."""
    out = np.full(len(texts), -20.0)
    for pack in packs(texts, OVERLAP):
        words = Words(pack=pack)
        np.maximum.at(out, words.owner, window_logits(model, words))
    return out


def score(text: Column, model: dict | None) -> Column:
    """Column of toxicity scores; 0 without a model."""
    @arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        keep_caches("powers")
        rows = encoded(texts.to_pylist())
        if model is None:
            return pa.array(np.zeros(len(rows)))
        a, b = model["line"]
        return pa.array(sigmoid(a * document_logits(model, rows) + b))
    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher is more toxic) and ``predicted`` (1 from
    0.7) to each row (columns of these names are replaced).

    ``labels`` (doc_id, toxic) are the rows to learn from.  Null and empty
    texts have no window and score near 0.  Without labels of both classes
    every score is 0.  Rows are scored one by one, so repeats and null ids come
    out as they come in; an empty table gives an empty result.
    """
    texts, y, weight = labelled_sample(docs.select("doc_id", F.col(text_col).alias("text")), labels, "toxic")
    model = train(texts, y, weight) if len(texts) else None
    return docs.withColumn("score", score(F.col(text_col), model)).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int"))
