"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training (labelled rows only; the caller chooses which):

1. A sample of at most ``MAX_FIT`` labelled rows per class, the smallest by a
   hash of the id, is joined to the texts. The bound is a parameter: the sample
   is broadcast, its texts are read where they lie.
2. Hashed n-grams of 4, 5, 6 and 8 characters (case folded for ASCII) are counted by
   document and class. The log-count ratio of a feature is
   r = log((p + a) / |p|) - log((q + a) / |q|) with p, q its document counts.
3. The ``FEATURES`` features with the largest evidence |r| * sqrt(count) stay. Each
   sampled document becomes its set of these, as two bytes a feature, so what the
   driver holds is bounded by MAX_FIT * FEATURES.
4. Logistic regression with an L2 penalty on the presences scaled by r gives one
   weight a feature; class weights even out the classes.

Scoring is one pass over all texts without a shuffle: the weights of the
distinct features present are summed, 1 / (1 + exp(-s)).

Defined cases: null and empty texts have no feature and score by the intercept;
no labels of one class give the constant score 0.5; several labels of one id are
used each; repeated rows score alike; empty in, empty out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.textvec import U64, mix, slices

ORDERS = (4, 5, 6, 8)
BITS = 20
MAX_FIT, FEATURES = 5000, 3000
ALPHA, RIDGE = 1.0, 1e-2
THRESHOLD = 0.7

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _b in (0x09, 0x0A, 0x0B, 0x0C, 0x0D):
    _FOLD[_b] = 0x20


def _codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of folded UTF-8 bytes, and the byte at which each begins."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = _FOLD[data]
    cp = b[at].astype(np.uint32)
    wide = np.flatnonzero(cp >= 0x80)
    if len(wide):
        n = len(data)
        start = at[wide]
        nxt = np.r_[at[1:], n][wide]
        for j in range(1, 4):
            more = start + j < nxt
            cp[wide[more]] = (cp[wide[more]] << np.uint32(8)) | data[start[more] + j]
    return cp, at


def ngrams(data: np.ndarray, offs: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (text index, hashed feature) of all n-grams of a run of texts."""
    cp, at = _codes(data)
    if not len(cp):
        return
    text = np.searchsorted(offs, at, side="right") - 1
    h = cp.astype(U64) * U64(0x9E3779B97F4A7C15)
    g = h.copy()
    for k in range(2, max(orders) + 1):
        m = len(cp) - k + 1
        if m <= 0:
            return
        g = g[:m] * U64(0xBF58476D1CE4E5B9) + h[k - 1 : k - 1 + m]
        if k in orders:
            ok = np.flatnonzero(text[:m] == text[k - 1 :])
            yield text[ok], (mix(g[ok] + U64(k)) >> U64(64 - bits)).astype(np.int64)


def _distinct(text: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((text << bits) | feature)
    return key >> bits, key & ((1 << bits) - 1)


def _class_counts(bits: int):
    """Columns in: text, label. Out: (feature, positives, negatives) summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int32)
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offs in slices(b.column(0)):
                found = list(ngrams(data, offs, ORDERS, bits))
                if not found:
                    continue
                t, f = _distinct(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), bits)
                for c in (0, 1):
                    total[c] += np.bincount(f[label[lo:hi][t] == c], minlength=1 << bits).astype(np.int32)
        seen = np.flatnonzero(total.any(axis=0))
        for lo in range(0, len(seen), 65536):
            s = seen[lo : lo + 65536]
            yield pa.record_batch([pa.array(s.astype(np.int32)), pa.array(total[1][s].astype(np.int64)), pa.array(total[0][s].astype(np.int64))], names=["feature", "pos", "neg"])

    return run


def _presences(bits: int, index: np.ndarray):
    """Columns in: text, label. Out: label and the chosen features present, as uint16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in slices(b.column(0)):
                rows: list[bytes] = [b""] * (hi - lo)
                t, f = chosen(data, offs, index, bits)
                if len(t):
                    cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                    for a, z in zip(cut, np.r_[cut[1:], len(t)], strict=True):
                        rows[t[a]] = f[a:z].astype(np.uint16).tobytes()
                yield pa.record_batch([b.column(1).slice(lo, hi - lo).cast(pa.int32()), pa.array(rows, pa.binary())], names=["label", "present"])

    return run


def chosen(data: np.ndarray, offs: np.ndarray, index: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, chosen feature) of a run of texts; index maps a hashed feature to its place or -1."""
    ts, fs = [], []
    for t, f in ngrams(data, offs, ORDERS, bits):
        p = index[f]
        hit = np.flatnonzero(p >= 0)
        ts.append(t[hit])
        fs.append(p[hit])
    if not ts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _distinct(np.concatenate(ts), np.concatenate(fs).astype(np.int64), 16)


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, ridge: float = RIDGE, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights (already times r) and intercept: accelerated gradient steps on the class-balanced log loss."""
    n, f = len(rows), len(r)
    at = np.concatenate(rows).astype(np.int64) if n else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), [len(x) for x in rows])
    value = r[at]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(f), 0.0
    vw, vb = w.copy(), b
    norm = np.bincount(row, value * value, minlength=n)
    step = 4.0 / (max(1e-9, float(np.max(norm, initial=1.0))) + 1.0)
    lift = min(1.0, 60 * step)  # the bound above is loose: start longer and fall back if the loss rises
    step, best = max(step, lift), np.inf
    for i in range(steps):
        s = np.bincount(row, value * vw[at], minlength=n) + vb
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        loss = float(-(share * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() + ridge / 2 * (vw @ vw))
        if loss > best * 1.2 + 1e-9:
            step, vw, vb, best = step / 2, w.copy(), b, np.inf
            continue
        best = min(best, loss)
        e = share * (p - y)
        gw = np.bincount(at, value * e[row], minlength=f) + ridge * vw
        nw, nb = vw - step * gw, vb - step * float(e.sum())
        m = i / (i + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w * r, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT, features: int = FEATURES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(index of hashed features, weights, intercept) from the labelled rows given."""
    draw = F.xxhash64(F.lit("fit"), F.col(id_col))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("label"), draw.alias("draw"))
    sample = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy("draw", "lid").limit(max_fit)
        sample = part if sample is None else sample.union(part)
    picked = [(r.lid, r.label) for r in sample.select("lid", "label").collect()]  # at most 2 * max_fit rows
    empty = np.full(1 << bits, -1, np.int32)
    if len({c for _, c in picked}) < 2:
        return empty, np.zeros(0), 0.0
    small = docs.sparkSession.createDataFrame(picked, "lid long, label int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(small), F.col("id") == F.col("lid")).select("text", "label")
    counts = rows.mapInArrow(_class_counts(bits), "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
    table = counts.toArrow()  # at most 2 ** bits rows
    feature, pos, neg = (table.column(i).to_numpy().astype(np.float64) for i in range(3))
    n1, n0 = sum(c for _, c in picked), sum(1 - c for _, c in picked)
    r = np.log((pos + ALPHA) / (n1 + 2 * ALPHA)) - np.log((neg + ALPHA) / (n0 + 2 * ALPHA))
    order = np.lexsort((feature, -np.abs(r) * np.sqrt(pos + neg)))[:features]
    index = empty
    index[feature[order].astype(np.int64)] = np.arange(len(order), dtype=np.int32)
    r = r[order]
    sparse = rows.mapInArrow(_presences(bits, index), "label int, present binary").collect()  # bounded: see module text
    y = np.array([x.label for x in sparse], np.float64)
    w, b = fit_logistic([np.frombuffer(bytes(x.present), np.uint16) for x in sparse], y, r)
    return index, w, b


def _score(bits: int, model, held: int, parts: int):
    """Columns in: doc, text. Out: id, held_out, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w, b = model.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in slices(batch.column(1)):
                s = np.full(hi - lo, b)
                if len(w):
                    t, f = chosen(data, offs, index, bits)
                    s += np.bincount(t, w[f], minlength=hi - lo)
                score = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
                yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(score)], names=["doc", "score"])

    return run


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, **options) -> DataFrame:
    """(id, held_out, score, predicted), one row per input row; learns from the labels that are not held out."""
    model = train(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col, label_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInArrow(_score(options.get("bits", BITS), shared, 1, 3), "doc long, score double")
    return out.select(F.col("doc").alias(id_col), F.coalesce(held_out(F.col("doc")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
