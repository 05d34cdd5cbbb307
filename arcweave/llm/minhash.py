"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

1. A shingle of ``SHINGLE`` words weighs its count in the text times
   FLOOR + (1 - FLOOR) * ln(N / df) / ln(1 / COMMON), at most 1: df is the exact
   number of the N documents that have it. A shingle in fewer than a share
   ``COMMON`` of the documents weighs 1, boilerplate less, down to FLOOR; without
   a floor, a group of edited copies that holds a third of all documents would
   weigh its shared shingles away against its edits. Only shingles of df >= COMMON * N
   need a count, and there are at most (mean shingles of a text) / COMMON of them,
   whatever the corpus. They are found in two passes: a sketch that never counts
   too low (two rows of ``WIDTH`` counters) names the shingles that may be common,
   then exactly these are counted. A narrow sketch costs shuffle, never exactness.
2. Improved consistent weighted sampling: per hash function each shingle draws
   r, c ~ Gamma(2, 1) and beta ~ U(0, 1) from its own hash, t = floor(ln S / r +
   beta), and the smallest ln c - r (t - beta) - r wins; the sample is (shingle,
   t). Two texts share a sample with probability equal to their weighted Jaccard
   similarity.
3. ``BANDS`` bands of ``ROWS`` samples make candidates: a text meets the smallest
   text of each of its buckets (partial minimum, so a bucket of any size costs
   one pair a member), pairs whose total weights differ too much are dropped, and
   the rest are verified by their true weighted Jaccard similarity. Texts move
   only if they are in such a pair: a filter of fixed size over the candidates'
   ids is asked where the texts are read, and each text follows its pairs, sorted
   by their first text, so that a head is split into shingles once a task.
   Buckets that still hold texts of several classes are then searched across
   classes, so a link that a star missed is found, without forming all pairs.
   A shingle is rare if at most ``RARE`` members of these buckets have it. Pairs
   that share a rare shingle come from an index of the rare shingles, whose lists
   are short by definition. For all others, with W the weight of a text and U that
   of its rare shingles, J(a, b) <= min(Wa - Ua, Wb - Ub) / max(Wa + Ub, Wb + Ua);
   so two texts that both have U > W (1 - t) / (1 + t) never reach t, and a pair
   needs one text below that share. Edited copies of one text have many rare
   shingles and are settled by the bound. Each bucket is searched first from the
   text with the smallest share of them, then in full.
4. Links become classes by star contraction. Equal texts are settled first by a
   digest: only the smallest id of each text takes part.

Defined cases: a text of 1 to 4 words is a single shingle; a text without words
is near to nothing but its equals; a null text is empty; a null id gets a null
class; rows of one id get the class of their own text, and two texts whose
smallest id is the same share a class; a text of any length is handled whole, alone if it is
longer than a slice; ties for the head of a bucket go to the smallest id; other
columns, whatever their names, pass or are ignored; empty in, empty out. Ids
must be castable to long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.textvec import U64, Words, grams, mix, signed, slices, spans_inside, text_of
from arcweave.operators.components import component_labels
from arcweave.runtime import discard, id_filter, materialize, materialize_counted, may_hold, redeal

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
WIDTH, CHUNK = 1 << 20, 1 << 12
COMMON, FLOOR = 1 / 1024, 0.7
_TABLE = 1 << 16
HELD, RARE = 1 << 20, 16


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle hash), by text; texts under k words give one shingle of all their words."""
    n = len(w)
    at = spans_inside(w.first, n, k)
    text = text_of(w.first, n)[at] if len(at) else at
    h = grams(w.hashes, k)[at] if len(at) else np.zeros(0, U64)
    sizes = np.diff(w.first)
    small = np.flatnonzero((sizes > 0) & (sizes < k))
    if not len(small):
        return text, h
    own = np.array([int(grams(w.hashes[w.first[i] : w.first[i + 1]], int(sizes[i]), salt=7 + int(sizes[i]))[0]) for i in small], U64)
    text, h = np.r_[text, small], np.r_[h, own]
    order = np.argsort(text, kind="stable")
    return text[order], h[order]


def weighted_shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts: (text index, hash, count), by text and hash."""
    text, h = shingles(w, k)
    if not len(h):
        return text, h, np.zeros(0, np.int64)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.r_[at, len(h)])


def _cells(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = U64(width - 1)
    return (h & m).astype(np.int64), ((h >> U64(32)) & m).astype(np.int64)


def _sketch(k: int, width: int, chunk: int):
    """Columns in: text. Out: per task, chunks of the two counter rows, and as chunk -1 the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = np.zeros((2, width), np.int32), 0
        for b in batches:
            n += b.num_rows
            for _, _, data, offs in slices(b.column(0)):
                _, h, _ = weighted_shingles(Words(data, offs), k)
                for r, cell in enumerate(_cells(h, width)):
                    at, m = np.unique(cell, return_counts=True)
                    rows[r][at] += m.astype(np.int32)
        if n:
            yield _chunks(rows, n, chunk)

    return run


def _chunks(rows: np.ndarray, n: int, chunk: int) -> pa.RecordBatch:
    z = zstandard.ZstdCompressor(level=1)
    ids, body = [-1], [z.compress(np.array([n], np.int64).tobytes())]
    for i, part in enumerate(rows.reshape(-1, chunk)):
        if part.any():
            ids.append(i)
            body.append(z.compress(part.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()))
    return pa.record_batch([pa.array(ids, pa.int32()), pa.array(body, pa.binary())], names=["chunk", "body"])


def _unchunk(body: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return raw.view(np.int64) if len(raw) == 8 else np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(-1)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the chunks of equal number; memory is bounded by the sketch."""
    total: dict[int, np.ndarray] = {}
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = _unchunk(body)
            total[i] = total[i] + part if i in total else part
    if total:
        packed = [z.compress((v if i < 0 else v.view(np.uint8).reshape(-1, 8).T).tobytes()) for i, v in total.items()]
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "body"])


def sketch_frequencies(texts: DataFrame, k: int = SHINGLE, width: int = WIDTH, chunk: int = CHUNK) -> tuple[np.ndarray, int]:
    """Two rows of ``width`` counters, none lower than the document frequency of any of its shingles, and the number of texts."""
    parts = texts.mapInArrow(_sketch(k, width, chunk), "chunk int, body binary")
    merged = parts.repartition("chunk").mapInArrow(_add_chunks, "chunk int, body binary").collect()
    rows, n = np.zeros((2 * width // chunk, chunk), np.int64), 0
    for r in merged:
        part = _unchunk(bytes(r.body))
        if r.chunk < 0:
            n += int(part[0])
        else:
            rows[r.chunk] += part
    return rows.reshape(2, width), n


def may_be_common(h: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which shingles the flags (2 x width: counter is high enough) do not rule out."""
    a, b = _cells(h, flags.shape[1])
    return flags[0][a] & flags[1][b]


def _count_flagged(k: int, flags):
    """Columns in: text. Out: the flagged shingles of the task with the number of texts that have them, HELD at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(signed(h)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for b in batches:
            for _, _, data, offs in slices(b.column(0)):
                h = weighted_shingles(Words(data, offs), k)[1]
                held.append(h[may_be_common(h, flags.value)])
                if sum(map(len, held)) >= HELD:
                    yield counted()
                    held.clear()
        if sum(map(len, held)):
            yield counted()

    return run


class Idf:
    """Weights of shingles: ``n`` texts, the flags of the sketch, and the sorted common shingles with their weights."""

    def __init__(self, n: int, flags: np.ndarray, shingles: np.ndarray, df: np.ndarray, common: float = COMMON, floor: float = FLOOR):
        self.flags, self.known = flags, shingles
        self.weights = floor + (1 - floor) * np.clip(np.log(max(n, 2) / df) / math.log(max(2.0, min(n, 1 / common))), 0, 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h))
        if len(self.known) and len(h):
            may = np.flatnonzero(may_be_common(h, self.flags))
            at = np.minimum(np.searchsorted(self.known, h[may]), len(self.known) - 1)
            here = self.known[at] == h[may]
            out[may[here]] = self.weights[at[here]]
        return out


def common_shingles(texts: DataFrame, k: int = SHINGLE, common: float = COMMON, width: int = WIDTH) -> Idf:
    """Exact document frequencies of all shingles that a share ``common`` of the texts, and at least two, have."""
    spark = texts.sparkSession
    counters, n = sketch_frequencies(texts, k, width)
    least = max(2, math.ceil(common * n))
    flags = counters >= least
    counts = texts.mapInArrow(_count_flagged(k, spark.sparkContext.broadcast(flags)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.toArrow()  # at most (mean shingles of a text) / common rows
    h, df = (np.asarray(found.column(i)) for i in (0, 1))
    h = h.astype(np.int64).view(U64)
    order = np.argsort(h)
    return Idf(n, flags, h[order], df[order].astype(np.float64), common)


def _gamma2(u: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1) by Newton steps on 1 - (1 + x) exp(-x) = u."""
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        f = -np.expm1(-x) - x * np.exp(-x) - u
        x = np.maximum(x - f / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


_Q = _gamma2((np.arange(_TABLE) + 0.5) / _TABLE)
_R = _Q.astype(np.float32)
_LNC = np.log(_Q).astype(np.float32)


def samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, n_hashes: int) -> np.ndarray:
    """ICWS samples as 32-bit fingerprints of (shingle, t): one row per text whose shingles begin at ``starts``."""
    ln_s = np.log(weight).astype(np.float32)
    out = np.empty((len(starts), n_hashes), np.uint32)
    for j in range(n_hashes):
        z = mix(h + U64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        r = _R[z & U64(0xFFFF)]
        beta = ((z >> U64(32)) & U64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(ln_s / r + beta)
        ln_a = _LNC[(z >> U64(16)) & U64(0xFFFF)] - r * (t - beta) - r
        key = (ln_a + np.float32(256.0)).view(np.uint32).astype(U64) << U64(32)
        key |= (z >> U64(32)) ^ (t.astype(np.int64).view(U64) * U64(0x9E3779B1) & U64(0xFFFFFFFF))
        out[:, j] = np.minimum.reduceat(key, starts) & U64(0xFFFFFFFF)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), U64)
    for b in range(bands):
        x = np.full(len(sig), (b + 1) * 0xD6E8FEB86659FD93 % 2**64, U64)
        for r in range(rows):
            x = mix(x ^ sig[:, b * rows + r].astype(U64))
        out[:, b] = x
    return out


def _sign(k: int, bands: int, rows: int, table):
    """Columns in: doc, text. Out: doc, 128-bit digest of the text, its weight, band keys (none for texts without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = table.value
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1)):
                text, h, tf = weighted_shingles(Words(data, offs), k)
                raw = data.tobytes()
                digest = [hashlib.blake2b(raw[offs[i] : offs[i + 1]], digest_size=16).digest() for i in range(hi - lo)]
                d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                count, total = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                keys = np.zeros((0, bands), U64)
                if len(h):
                    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                    weight = tf * idf(h)
                    keys = band_keys(samples(h, weight, starts, bands * rows), bands, rows)
                    count[text[starts]] = bands
                    total[text[starts]] = np.add.reduceat(weight, starts)
                offsets = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
                yield pa.record_batch(
                    [b.column(0).slice(lo, hi - lo), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(total), pa.ListArray.from_arrays(offsets, pa.array(signed(keys.reshape(-1))))],
                    names=["doc", "d1", "d2", "weight", "bands"],
                )

    return run


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of minima over sum of maxima; the hashes are sorted and distinct."""
    if not len(ha) or not len(hb):
        return 0.0
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum(dtype=np.float64)
    return float(low / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - low))


def _verify(k: int, threshold: float, table):
    """Columns in: a, b, za, zb (packed texts), best sorted by a. Out: a, b of the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, d = table.value, zstandard.ZstdDecompressor()
        last: tuple = (None, None)

        def features(z: bytes) -> tuple:
            data = np.frombuffer(d.decompress(z), np.uint8)
            _, h, tf = weighted_shingles(Words(data, np.array([0, len(data)], np.int64)), k)
            return h, tf * idf(h)

        for b in batches:
            left, right = [], []
            for i in range(b.num_rows):
                x, y, zx, zy = (b.column(c)[i] for c in range(4))
                if last[0] != (x, zx):
                    last = ((x, zx), features(zx.as_py()))
                if weighted_jaccard(*last[1], *features(zy.as_py())) >= threshold:
                    left.append(x.as_py())
                    right.append(y.as_py())
            if left:
                yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = zstandard.ZstdCompressor(level=3)
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            yield pa.record_batch([part.column(0), pa.array([c.compress((x or "").encode()) for x in part.column(1).to_pylist()], pa.binary())], names=["doc", "z"])


def packed_texts(live: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, z): compressed texts of the ids, and of few others, without a shuffle."""
    return may_hold(live, "doc", id_filter(ids), "wanted").where("wanted").select("doc", "text").mapInArrow(_pack, "doc long, z binary")


def verified(pairs: DataFrame, packed: DataFrame, k: int, threshold: float, table) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold; packed(doc, z) holds the compressed texts of all of them.

    Both joins are sort-merge joins at every size: a text of many pairs is split
    over tasks there, and the pairs of one text arrive next to each other.
    """
    with_b = pairs.select("a", "b").join(packed.select(F.col("doc").alias("x"), F.col("z").alias("zb")).hint("merge"), F.col("b") == F.col("x")).select("a", "b", "zb")
    both = with_b.join(packed.select(F.col("doc").alias("y"), F.col("z").alias("za")).hint("merge"), F.col("a") == F.col("y"))
    return both.select("a", "b", "za", "zb").mapInArrow(_verify(k, threshold, table), "a long, b long")


def shared_buckets(keys: DataFrame) -> DataFrame:
    """keys(key, rep, weight) of the buckets with several texts, with the smallest, the head, and its weight."""
    heads = keys.groupBy("key").agg(F.min(F.struct("rep", "weight")).alias("x"), F.max("rep").alias("z")).where("x.rep < z")
    heads = heads.select(redeal(F.col("key")).alias("k"), F.col("x.rep").alias("head"), F.col("x.weight").alias("head_weight"))
    return keys.join(heads.hint("merge"), redeal(F.col("key")) == F.col("k")).select("key", "rep", "weight", "head", "head_weight")


def _weights_allow(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= F.lit(threshold - 1e-6) * F.greatest(a, b)


def star_pairs(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each text of a bucket with the bucket's head, where their weights let them be near: distinct (a, b), a < b."""
    near = members.where((F.col("rep") > F.col("head")) & _weights_allow(F.col("weight"), F.col("head_weight"), threshold))
    return near.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, weight, comp) in buckets of several classes, without the heads that the star has tested."""
    lab = labels.select(F.col("node").alias("n"), "comp")
    named = members.join(lab, F.col("rep") == F.col("n"), "left").select("key", "rep", "weight", "head", F.coalesce("comp", "rep").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(redeal(F.col("key")).alias("k"))
    return named.join(mixed, redeal(F.col("key")) == F.col("k")).where("rep <> head").select("key", "rep", "weight", "comp")


def _own_shingles(k: int, table):
    """Columns in: doc, z. Out: a row per distinct shingle: its hash, doc, its weight in 64ths rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, d = table.value, zstandard.ZstdDecompressor()
        for b in batches:
            texts = pa.array([d.decompress(x) for x in b.column(1).to_pylist()], pa.large_binary()).cast(pa.large_string())
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in slices(texts):
                text, h, tf = weighted_shingles(Words(data, offs), k)
                if len(h):
                    yield pa.record_batch([pa.array(signed(h)), pa.array(ids[lo:hi][text]), pa.array(np.floor(tf * idf(h) * 64).astype(np.int32))], names=["h", "doc", "w"])

    return run


def rare_shingles(members: DataFrame, packed: DataFrame, k: int, table, rare: int = RARE) -> DataFrame:
    """(h, doc, w, n): the shingles that at most ``rare`` of the members have, a row per member, with their number."""
    ids = members.select(F.col("rep").alias("r")).distinct()
    rows = packed.join(ids, F.col("doc") == F.col("r")).select("doc", "z").mapInArrow(_own_shingles(k, table), "h long, doc long, w int")
    few = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= rare).select(redeal(F.col("h")).alias("x"), "n")
    return rows.join(few.hint("merge"), redeal(F.col("h")) == F.col("x")).select("h", "doc", "w", "n")


def rare_weights(found: DataFrame) -> DataFrame:
    """(o, own): per text the weight of its rare shingles, never too high."""
    return found.groupBy(F.col("doc").alias("o")).agg((F.sum("w") / 64.0).alias("own"))


def rare_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of members that share a rare shingle."""
    lists = found.where("n > 1").groupBy("h").agg(F.sort_array(F.collect_set("doc")).alias("docs")).select("docs", F.posexplode("docs").alias("i", "a"))
    return lists.select("a", F.explode(F.expr("slice(docs, i + 2, size(docs))")).alias("b")).distinct()


def across_classes(pairs: DataFrame, members: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """The pairs of different classes whose weights let them be near."""
    lab = labels.select(F.col("node").alias("n"), F.col("comp").alias("c"))
    known = members.select("rep", "weight").distinct().join(lab, F.col("rep") == F.col("n"), "left").select("rep", "weight", F.coalesce("c", "rep").alias("comp"))
    a, b = (known.select(*[F.col(c).alias(f"{s}_{c}") for c in known.columns]) for s in "xy")
    both = pairs.join(a, F.col("a") == F.col("x_rep")).join(b, F.col("b") == F.col("y_rep"))
    return both.where((F.col("x_comp") != F.col("y_comp")) & _weights_allow(F.col("x_weight"), F.col("y_weight"), threshold)).select("a", "b")


def bounded_members(members: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """(key, rep, comp, weight, own) of the members that can be near to another with which they share no rare shingle."""
    known = members.join(own, F.col("rep") == F.col("o"), "left").select("key", "rep", "comp", "weight", F.coalesce("own", F.lit(0.0)).alias("own"))
    return known.where(F.col("weight") - F.col("own") >= F.lit(threshold - 1e-6) * F.col("weight"))


def _may_reach(threshold: float) -> Column:
    """The bound for two members that share no rare shingle, the second with prefix x_."""
    overlap = F.least(F.col("weight") - F.col("own"), F.col("x_weight") - F.col("x_own"))
    union = F.greatest(F.col("weight") + F.col("x_own"), F.col("x_weight") + F.col("own"))
    return (F.col("comp") != F.col("x_comp")) & (overlap >= F.lit(threshold - 1e-6) * union)


def clean_star_pairs(bounded: DataFrame, threshold: float) -> DataFrame:
    """Each member with the bucket's text that has the smallest share of rare shingles: what copies of one text are copies of."""
    best = bounded.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("weight")).alias("share"), "rep", "comp", "weight", "own")).alias("x"))
    x = best.select(redeal(F.col("key")).alias("x_key"), *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("rep", "comp", "weight", "own")])
    near = bounded.join(x, (redeal(F.col("key")) == F.col("x_key")) & _may_reach(threshold))
    return near.select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b")).distinct()


def relabelled(bounded: DataFrame, labels: DataFrame) -> DataFrame:
    lab = labels.select(F.col("node").alias("n"), F.col("comp").alias("c"))
    return bounded.join(lab, F.col("rep") == F.col("n"), "left").select("key", "rep", F.coalesce("c", "rep").alias("comp"), "weight", "own")


def cross_pairs(bounded: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of one bucket and two classes that the bound does not rule out, each from its first shared bucket."""
    still = bounded.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(redeal(F.col("key")).alias("k"))
    live = bounded.join(still, redeal(F.col("key")) == F.col("k")).select("key", "rep", "comp", "weight", "own")
    places = live.groupBy(F.col("rep").alias("p")).agg(F.sort_array(F.collect_set("key")).alias("keys"))  # at most one key a band
    live = live.join(places, F.col("rep") == F.col("p")).drop("p")
    clean = F.col("own") <= F.lit((1 - threshold) / (1 + threshold) + 1e-6) * F.col("weight")
    x = live.where(clean).select(*[F.col(c).alias(f"x_{c}") for c in live.columns])
    y = live.withColumn("clean", clean)
    on = (F.col("key") == F.col("x_key")) & (~F.col("clean") | (F.col("x_rep") < F.col("rep"))) & _may_reach(threshold)
    on = on & (F.element_at(F.array_intersect("keys", "x_keys"), 1) == F.col("key"))
    return y.join(x, on).select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b")).distinct()


def _classes(live: DataFrame, signs: DataFrame, table, k: int, threshold: float) -> DataFrame:
    """(node, comp) of the texts that are near to another; signs(rep, weight, bands) has a row per different text."""
    keys = signs.select("rep", "weight", F.explode("bands").alias("key"))
    members = materialize(shared_buckets(keys), "members")
    pairs, found = materialize_counted(star_pairs(members, threshold), "pairs")
    if not found["rows"]:
        discard(pairs)
        pairs = None
    ids = members.select("rep").distinct()
    packed = materialize(packed_texts(live, ids), "packed")
    star = materialize(verified(pairs, packed, k, threshold, table), "star") if pairs is not None else materialize(members.select(F.col("head").alias("a"), F.col("rep").alias("b")).limit(0), "star")
    labels = materialize(component_labels(star, "a", "b"), "labels")
    open_, left = materialize_counted(unsettled(members, labels), "unsettled")
    discard(members, pairs)
    if left["rows"]:
        found = materialize(rare_shingles(open_, packed, k, table), "rare")
        bounded = materialize(bounded_members(open_, rare_weights(found), threshold), "bounded")
        clean = materialize(verified(clean_star_pairs(bounded, threshold), packed, k, threshold, table), "clean")
        links = star.unionByName(clean)
        again = materialize(component_labels(links, "a", "b"), "labels")
        more = across_classes(rare_pairs(found), open_, again, threshold).unionByName(cross_pairs(relabelled(bounded, again), threshold)).distinct()
        rest, size = materialize_counted(verified(more, packed, k, threshold, table), "rest")
        discard(labels)
        labels = again
        if size["rows"]:
            labels = materialize(component_labels(links.unionByName(rest), "a", "b"), "labels")
            discard(again)
        discard(found, bounded, clean, rest)
    discard(open_, packed, star)
    return labels


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id, text_id): the smallest id of the class and of the same text; a row per input row."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    table = spark.sparkContext.broadcast(common_shingles(base.select("text"), k))
    live = base.where("doc is not null")
    signed_ = materialize(live.mapInArrow(_sign(k, bands, rows, table), "doc long, d1 long, d2 long, weight double, bands array<long>"), "signatures")
    texts = materialize(signed_.groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "texts")
    labels = _classes(live, texts.select("rep", "weight", "bands"), table, k, threshold)
    named = texts.select(F.col("d1").alias("x1"), F.col("d2").alias("x2"), "rep").join(labels, F.col("rep") == F.col("node"), "left").select("x1", "x2", "rep", F.coalesce("comp", "rep").alias("comp"))
    member = signed_.select("doc", "d1", "d2").join(named, (F.col("d1") == F.col("x1")) & (F.col("d2") == F.col("x2")))
    out = materialize(member.select(F.col("doc").alias(id_col), F.col("comp").alias("class_id"), F.col("rep").alias("text_id")), "classes")
    discard(signed_, texts, labels)
    nulls = base.where("doc is null").select(F.col("doc").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("text_id"))
    return out.unionByName(nulls)


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest id of each class, and rows without an id.

    Only rows that the filter of the leaving ids does not clear meet these ids in a join; the others stay where they are.
    """
    classes = near_duplicate_classes(docs, id_col, text_col, **options)
    gone = materialize(classes.where(F.col(id_col) > F.col("class_id")).select(F.col(id_col).alias("__gone")).distinct(), "gone")
    asked = materialize(id_filter(gone), "filter")
    rows = may_hold(docs.withColumn("__key", F.col(id_col).cast("long")), "__key", asked, "__may")
    left = rows.where("__may").join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    return rows.where("not __may").unionByName(left).select(*[F.col(f"`{c}`") for c in docs.columns])
