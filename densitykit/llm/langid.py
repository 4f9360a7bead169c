"""Language ID by a bidirectional gated recurrent network over bytes (operator 6).

The network reads a *word* (a run of ASCII letters and non-ASCII bytes, in pieces of at most
``SPAN`` bytes) from both ends, labels every byte position with language probabilities, and a
document's probabilities are the means over all its positions. The state starts anew with each word, so
a word has the same position labels wherever it stands: a worker runs the network once for
each distinct word that it meets (it remembers at most ``MEMO`` of them) and adds up.

Training is numpy backpropagation through time with Adam on the words of at most
``sample_rows`` labelled documents (pairs of id and text), those with the smallest hash of their id; a word's target is
its distribution over the languages of the documents that hold it. Whatever the caller holds out
never gets into the sample.

Edge cases: null text and text without a letter get ``und`` and score 0; null languages are not
learned; without labelled rows every text gets ``und``; ties go to the first language in order of
name; repeated rows get equal predictions; an empty table gives an empty result; extra columns are
ignored; whole texts are read whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from densitykit.llm.common import bounded_sample, lean, row_blocks, span_hashes, text_bytes, words

SPAN = 24
MEMO = 2_000_000
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[128:] = False
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = False


def _sig(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class BiGRU:
    """Two gated recurrent units over bytes and a softmax at every position."""
    langs: list[str]
    par: dict[str, np.ndarray]

    @staticmethod
    def new(langs: list[str], hidden: int = 16, seed: int = 5) -> "BiGRU":
        r = np.random.default_rng(seed)
        par = {"W": r.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32), "c": np.zeros(len(langs), np.float32)}
        for d in "fb":
            par[f"E{d}"] = r.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)  # input weights, a row for each byte
            par[f"U{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        return BiGRU(langs, par)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States after every step (steps, rows, hidden); masked steps hold the state."""
        e, u = self.par[f"E{d}"], self.par[f"U{d}"]
        k = u.shape[0]
        h = np.zeros((x.shape[0], k), e.dtype)
        out, tape = np.empty((x.shape[1], *h.shape), e.dtype), []
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        for t in steps:
            a, b, m = e[x[:, t]], h @ u[:, :2 * k], mask[:, t, None]
            z, r = _sig(a[:, :k] + b[:, :k]), _sig(a[:, k:2 * k] + b[:, k:])
            q = (r * h) @ u[:, 2 * k:]
            n = np.tanh(a[:, 2 * k:] + q)
            new = h + m * (1 - z) * (n - h)
            if keep:
                tape.append((t, h, z, r, n, m))
            out[t] = h = new
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Language probabilities of every position: (steps, rows, languages)."""
        f, tf = self._run(x, mask, "f", keep)
        b, tb = self._run(x, mask, "b", keep)
        s = np.concatenate([f, b], axis=2)
        logit = s @ self.par["W"] + self.par["c"]
        logit -= logit.max(axis=2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=2, keepdims=True)
        return p, s, (tf, tb)

    def gradients(self, x, mask, target, weight):
        """Loss (mean cross-entropy over weighted positions) and its gradients by the parameters."""
        p, s, tapes = self.forward(x, mask, True)
        m = (mask * weight[:, None]).T[:, :, None]
        total = max(float(m.sum()), 1e-9)
        loss = float(-(m * target[None] * np.log(p + 1e-9)).sum() / total)
        dl = m * (p * target.sum(axis=1)[None, :, None] - target[None]) / total
        g = {"W": np.einsum("tnh,tnl->hl", s, dl), "c": dl.sum(axis=(0, 1))}
        ds = dl @ self.par["W"].T
        k = ds.shape[2] // 2
        for d, tape, dout in (("f", tapes[0], ds[:, :, :k]), ("b", tapes[1], ds[:, :, k:])):
            u = self.par[f"U{d}"]
            ge, gu = np.zeros_like(self.par[f"E{d}"]), np.zeros_like(u)
            dh = np.zeros_like(dout[0])
            for t, h, z, r, n, mt in reversed(tape):
                dh = dh + dout[t]
                dn = dh * mt * (1 - z)
                dz = -dh * mt * (n - h)
                back = dh * (1 - mt * (1 - z))
                da_n = dn * (1 - n * n)
                drh = da_n @ u[:, 2 * k:].T
                da_r = drh * h * r * (1 - r)
                da_z = dz * z * (1 - z)
                gu[:, 2 * k:] += (r * h).T @ da_n
                azr = np.concatenate([da_z, da_r], axis=1)
                gu[:, :2 * k] += h.T @ azr
                np.add.at(ge, x[:, t], np.concatenate([azr, da_n], axis=1))
                dh = back + drh * r + azr @ u[:, :2 * k].T
            g[f"E{d}"], g[f"U{d}"] = ge, gu
        return loss, g

    def word_sums(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sum of the position probabilities of each word (padded byte rows)."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), 4096):
            o = order[i:i + 4096]
            t = int(length[o].max())
            mask = (np.arange(t)[None, :] < length[o][:, None]).astype(np.float32)
            p, _, _ = self.forward(x[o, :t], mask)
            out[o] = (p * mask.T[:, :, None]).sum(axis=0)
        return out


def byte_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in pieces of at most SPAN bytes: starts, lengths, first piece of each row."""
    s, e, _ = words(data, off, _NOT_LETTER)
    k = -(-(e - s) // SPAN)
    if len(k) and k.max() > 1:
        s = np.repeat(s, k) + (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)) * SPAN
        e = np.minimum(np.repeat(e, k), s + SPAN)
    return s, e - s, np.searchsorted(s, off)


def padded(data: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = np.minimum(s[:, None] + np.arange(SPAN)[None, :], max(len(data) - 1, 0))
    return np.where(np.arange(SPAN)[None, :] < n[:, None], data[at], 0)


def train(x: np.ndarray, length: np.ndarray, target: np.ndarray, weight: np.ndarray, langs: list[str],
          steps: int = 900, batch: int = 256, rate: float = 0.01, seed: int = 5) -> BiGRU:
    """Adam on batches of words of like length."""
    net, r = BiGRU.new(langs, seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.par.items()}
    v = {k: np.zeros_like(w) for k, w in net.par.items()}
    pick = np.cumsum(weight / weight.sum())
    for i in range(1, steps + 1):
        o = np.minimum(np.searchsorted(pick, r.random(batch)), len(x) - 1)
        t = int(length[o].max())
        mask = (np.arange(t)[None, :] < length[o][:, None]).astype(np.float32)
        _, g = net.gradients(x[o, :t], mask, target[o], np.ones(len(o), np.float32))
        lr = rate * min(1.0, 2.0 * (1 - i / (steps + 1)))
        for k, w in net.par.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            w -= (lr * (m[k] / (1 - 0.9 ** i)) / (np.sqrt(v[k] / (1 - 0.999 ** i)) + 1e-8)).astype(w.dtype)
    return net


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 2000,
        steps: int = 900) -> BiGRU:
    """Learn from the labelled ``rows`` (the caller leaves out what is held out)."""
    pick = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")) \
        .where("t is not null and l is not null")
    got = bounded_sample(pick, "id", "t", sample_rows).select("t", "l").toArrow()
    langs = sorted(set(got["l"].to_pylist()))
    if not langs:
        return BiGRU.new([])
    code = np.array([langs.index(x) for x in got["l"].to_pylist()])
    # words by (word, language), whatever the order of the rows
    keys, langs_of, starts, lens, datas, base = [], [], [], [], [], 0
    data, off, _ = text_bytes(got["t"])
    for i, j in row_blocks(off):
        d = data[off[i]:off[j]]
        s, n, first = byte_words(d, off[i:j + 1] - off[i])
        keys.append(span_hashes(d, s, s + n))
        langs_of.append(np.repeat(code[i:j], np.diff(first)))
        starts.append(s + base)
        lens.append(n)
        datas.append(d)
        base += len(d)
    h, lo, s, n, d = (np.concatenate(v) for v in (keys, langs_of, starts, lens, datas))
    if not len(h):
        return BiGRU.new([])
    _, first, inv = np.unique(h, return_index=True, return_inverse=True)
    count = np.zeros((len(first), len(langs)))
    np.add.at(count, (inv, lo), 1)
    total = count.sum(axis=1)
    return train(padded(d, s[first], n[first]), n[first], (count / total[:, None]).astype(np.float32), np.sqrt(total), langs, steps)


class WordLabels:
    """The network's word sums, each distinct word computed once."""

    def __init__(self, net: BiGRU):
        self.net = net
        self._clear()

    def _clear(self):
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros((0, len(self.net.langs)), np.float32)

    def rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of position probabilities of each row, and its number of positions."""
        s, n, first = byte_words(data, off)
        out = np.zeros((len(off) - 1, len(self.net.langs)))
        positions = np.zeros(len(off) - 1, np.int64)
        if not len(s) or not self.net.langs:
            return out, positions
        uniq, at, inv = np.unique(span_hashes(data, s, s + n), return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > MEMO:
            self._clear()
        p = np.searchsorted(self.keys, uniq)
        new = np.ones(len(uniq), bool)
        inside = p < len(self.keys)
        new[inside] = self.keys[p[inside]] != uniq[inside]
        if new.any():
            a = at[new]
            sums = self.net.word_sums(padded(data, s[a], n[a]), n[a])
            where = p[new]
            self.keys, self.sums = np.insert(self.keys, where, uniq[new]), np.insert(self.sums, where, sums, axis=0)
            p = np.searchsorted(self.keys, uniq)
        full = np.flatnonzero(np.diff(first))
        out[full] = np.add.reduceat(self.sums[p[inv]].astype(np.float64), first[full], axis=0)
        positions[full] = np.add.reduceat(n, first[full])
        return out, positions


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with a letter: an ASCII one, or by decoding a row that has other bytes only."""
    ascii_letter = np.append(0, np.cumsum(~_NOT_LETTER[data] & (data < 128)))
    other = np.append(0, np.cumsum(data >= 128))
    yes = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
    for r in np.flatnonzero(~yes & (other[off[1:]] > other[off[:-1]])):
        yes[r] = any(ch.isalpha() for ch in data[off[r]:off[r + 1]].tobytes().decode("utf-8", "replace"))
    return yes


def predict(docs: DataFrame, net: BiGRU, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text unless ``keep_text``), and lang_pred, score (mean probability of
    that language)."""
    langs = np.array([*net.langs, "und"], object)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text_col)]
    kept = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])

    carried = keep_text and isinstance(docs.schema[text_col].dataType, T.StringType)  # then it is sent once
    place = keep.index(text_col) if carried else len(keep)
    sent = docs.select(*keep, *([] if carried else [F.col(text_col).cast("string").alias("_text")]))

    def run(batches):
        memo = WordLabels(net)
        for b in batches:
            data, off, _ = text_bytes(b.column(place))
            pred, score = [], []
            for i, j in row_blocks(off):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                total, n = memo.rows(d, o)
                mean = total / np.maximum(n, 1)[:, None]
                ok = has_letter(d, o) & (n > 0) & (len(net.langs) > 0)
                best = mean.argmax(axis=1) if len(net.langs) else np.zeros(len(n), np.int64)
                pred.append(np.where(ok, best, len(net.langs)))
                score.append(np.where(ok, mean.max(axis=1, initial=0.0), 0.0))
            pred = np.concatenate(pred) if pred else np.zeros(0, np.int64)
            score = np.clip(np.concatenate(score), 0, 1) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(langs[pred], pa.string()), pa.array(score, pa.float64())],
                                             [*keep, "lang_pred", "score"])

    return sent.mapInArrow(lean(run), schema)
