"""Toxicity grades by cumulative-link ordinal regression (operator 9).

``P(grade <= j) = sigmoid(theta_j - w . x)`` with one weight vector w for all thresholds
theta_0 < theta_1 < ..; x holds ``1 + log(count)`` of the words of a text and of the words' first 4 and 6 bytes, which stand for
inflected forms (sparse; A-Z lowered, ASCII punctuation separates). Severity is the expected grade.

The labels say toxic or not; ordered grades come from them: words that are ``RATIO`` times
as frequent in toxic as in clean training texts are *evidence*, and toxic texts are graded 1, 2, 3 by
terciles of how many evidence words they hold (none: 1). Clean texts are grade 0.

Fit: proximal gradient with an L1 penalty (``l1`` a row, 4 at least) chooses the words, a second pass without it refits
the chosen ones. It uses at most ``sample_rows`` labelled rows, those with the smallest hash of
their id (a bounded, repeatable sample; exact repeats of a text count once), featurised on the executors. Prediction scans all documents
once, without a shuffle; the model is some hundred words.

Edge cases: null or empty text has no words and gets the base severity; null labels or ids are not
used for the fit; no labelled rows, or labels all alike, give a model without words; ties of
grade probability take the lower grade; repeated rows get equal predictions; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.llm.common import LOWER, NOT_WORD, U, row_blocks, span_hashes, text_bytes, words

GRADES = 4
RATIO = 20.0


@dataclass
class OrdinalModel:
    words: np.ndarray  # sorted word hashes (uint64)
    weights: np.ndarray
    theta: np.ndarray

    def cumulative(self, f: np.ndarray) -> np.ndarray:
        """P(grade <= j) for each score, one column a threshold."""
        return _sigmoid(self.theta[None, :] - f[:, None])

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """w . x of each row of a block of word hashes."""
        n = len(first) - 1
        if not len(self.words) or not len(h):
            return np.zeros(n)
        p = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        at = np.flatnonzero(self.words[p] == h)
        row = np.searchsorted(first, at, side="right") - 1
        key, tf = np.unique(row * len(self.words) + p[at], return_counts=True)
        return np.bincount(key // len(self.words), (1 + np.log(tf)) * self.weights[key % len(self.words)], minlength=n)


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def _loss_parts(theta, f, y):
    """Derivatives of the negative log likelihood by the score and by each threshold."""
    c = np.column_stack([np.zeros(len(f)), _sigmoid(theta[None, :] - f[:, None]), np.ones(len(f))])
    hi, lo = c[np.arange(len(y)), y + 1], c[np.arange(len(y)), y]
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
    g = np.zeros(len(theta))
    np.subtract.at(g, y[y < len(theta)], dhi[y < len(theta)])
    np.add.at(g, y[y > 0] - 1, dlo[y > 0])
    return dhi - dlo, g, float(-np.log(p).sum())


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, n_cols: int, grades: int,
                l1: float, l2: float, steps: int = 300):
    """Proximal gradient with momentum on sparse rows. Returns weights, thresholds and losses."""
    n = len(y)
    share = np.cumsum(np.bincount(y, minlength=grades))[:-1] / n
    share = np.clip(share, 1 / (2 * n + 2), 1 - 1 / (2 * n + 2))
    theta = np.log(share / (1 - share)) + 1e-6 * np.arange(grades - 1)
    w = np.zeros(n_cols)
    # step from the curvature bound 1/4 per row (1/2 with two thresholds)
    v = np.ones(n_cols)
    for _ in range(12):
        u = np.bincount(row, val * v[col], minlength=n)
        v = np.bincount(col, val * u[row], minlength=n_cols)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    lr = 1 / (0.5 * norm + l2)
    lt = 1 / (0.5 * n)
    zw, zt, k, losses = w.copy(), theta.copy(), 1.0, []
    for _ in range(steps):
        f = np.bincount(row, val * zw[col], minlength=n)
        df, gt, loss = _loss_parts(zt, f, y)
        losses.append(loss + l2 / 2 * float(zw @ zw) + l1 * float(np.abs(zw).sum()))
        new = zw - lr * (np.bincount(col, val * df[row], minlength=n_cols) + l2 * zw)
        new = np.sign(new) * np.maximum(np.abs(new) - lr * l1, 0)
        newt = np.maximum.accumulate(zt - lt * gt)  # thresholds stay in order
        newt += 1e-6 * np.arange(grades - 1)
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        zw, zt = new + (k - 1) / k2 * (new - w), newt + (k - 1) / k2 * (newt - theta)
        zt = np.maximum.accumulate(zt)
        w, theta, k = new, newt, k2
    return w, theta, losses


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of each row, and each row's first one."""
    d = LOWER[data]
    s, e, _ = words(d, off, NOT_WORD)
    at, h = [s], [span_hashes(d, s, e)]
    for n, salt in ((4, U(0x51ED270B)), (6, U(0x2545F491))):
        long = e - s > n
        at.append(s[long])
        h.append(span_hashes(d, s[long], s[long] + n) ^ salt)
    at, h = np.concatenate(at), np.concatenate(h)
    order = np.argsort(at, kind="stable")
    return h[order], np.searchsorted(at[order], off)


def labelled_features(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str, label_col: str):
    """Toxic flags, first feature of each row (one more than rows), feature hashes and counts of the sample, as
    flat arrays in an order that does not depend on how the rows arrive."""
    pick = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null") \
        .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def run(batches):
        for b in batches:
            data, off, _ = text_bytes(b.column(1))
            found, counts = [], []
            for i, j in row_blocks(off):
                h, first = features(data[off[i]:off[j]], off[i:j + 1] - off[i])
                for r in range(j - i):
                    u, c = np.unique(h[first[r]:first[r + 1]], return_counts=True)
                    found.append(u.view(np.int64))
                    counts.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], ["y", "words", "counts"])

    # the sample is bounded by sample_rows; one text of each id
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(pick), "id") \
        .groupBy("id").agg(F.first("y").alias("y"), F.min_by("t", F.xxhash64("t")).alias("t"))
    got = rows.select("y", "t").mapInArrow(run, "y int, words array<long>, counts array<int>").toArrow().combine_chunks()
    y = np.asarray(got["y"]).astype(np.int64)
    if not len(y):
        return y, np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    w, c = got["words"].combine_chunks(), got["counts"].combine_chunks()
    at = np.asarray(w.offsets).astype(np.int64)
    w, c = np.asarray(w.values).view(np.uint64), np.asarray(c.values)
    del got
    seen, keep = set(), []
    for i in range(len(y)):
        key = (bool(y[i]), w[at[i]:at[i + 1]].tobytes(), c[at[i]:at[i + 1]].tobytes())
        h = hashlib.sha256(repr(key[0]).encode() + key[1] + key[2]).digest()
        if at[i + 1] > at[i] and h not in seen:
            seen.add(h)
            keep.append((h, i))
    order = np.array([i for _, i in sorted(keep)], np.int64)
    size = at[order + 1] - at[order]
    first = np.append(0, np.cumsum(size))
    take = np.repeat(at[order] - first[:-1], size) + np.arange(first[-1])
    return (y[order] != 0).astype(np.int64), first, w[take], c[take]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = 12_000, min_docs: int = 5, l1: float = 0.003) -> OrdinalModel:
    y, first, h, counts = labelled_features(docs, labels, sample_rows, id_col, text_col, label_col)
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([4.0, 5.0, 6.0]))
    if not len(y) or y.min() == y.max():
        return none
    vocab, col = np.unique(h, return_inverse=True)
    row = np.repeat(np.arange(len(y)), np.diff(first))
    val = 1 + np.log(counts.astype(float))
    df = np.bincount(col, minlength=len(vocab))
    tox = np.bincount(col, y[row], minlength=len(vocab))
    keep = df >= min_docs
    # grades of the toxic rows by their evidence words
    rate = ((tox + 0.1) / y.sum()) / ((df - tox + 0.1) / (len(y) - y.sum()))
    evidence = keep & (rate >= RATIO) & (tox >= min_docs)
    n_ev = np.bincount(row, evidence[col] * np.exp(val - 1), minlength=len(y))
    cuts = np.quantile(n_ev[(y == 1) & (n_ev > 0)], [1 / 3, 2 / 3]) if ((y == 1) & (n_ev > 0)).any() else np.array([0.0, 0.0])
    grade = np.where(y == 1, 1 + (n_ev > cuts[0]) + (n_ev > cuts[1]), 0)
    new = np.cumsum(keep) - 1
    ok = keep[col]
    row, col, val = row[ok], new[col[ok]], val[ok]
    vocab = vocab[keep]
    if not len(vocab):
        return none
    w, theta, _ = fit_ordinal(row, col, val, grade, len(vocab), GRADES, max(l1 * len(y), 4.0), 0.0, 150)
    chosen = w != 0
    if not chosen.any():
        return none
    ok = chosen[col]
    w, theta, _ = fit_ordinal(row[ok], (np.cumsum(chosen) - 1)[col[ok]], val[ok], grade, int(chosen.sum()), GRADES, 0.0, 0.5, 400)
    return OrdinalModel(vocab[chosen], w, theta)


def predict(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_col, severity (expected grade), grade (the most probable), p_toxic (grade 1 or more), toxic."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, off, _ = text_bytes(b.column(1))
            f = []
            for i, j in row_blocks(off):
                h, first = features(data[off[i]:off[j]], off[i:j + 1] - off[i])
                f.append(model.scores(h, first))
            c = model.cumulative(np.concatenate(f) if f else np.zeros(0))
            each = np.diff(np.column_stack([np.zeros(len(c)), c, np.ones(len(c))]), axis=1)
            p = 1 - c[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((1 - c).sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)),
                                              pa.array(p), pa.array(p >= threshold)], ["id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")) \
        .mapInArrow(run, f"id {id_type}, severity double, grade int, p_toxic double, toxic boolean").withColumnRenamed("id", id_col)
