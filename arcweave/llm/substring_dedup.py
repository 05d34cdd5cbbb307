"""Substring dedup: winnowed anchors as seeds, extended to maximal repeats.

A repeat is a run of words of which every ``length``-word window also starts in
a document with a smaller id. The steps:

1. Seeds. Every document is cut into ``seed``-word grams; of every
   ``length - seed + 1`` consecutive grams the rightmost smallest hash is an
   anchor (winnowing), so two documents that share a window share its anchor.
2. Seed join. Anchor occurrences are joined with the anchors that lie in at
   least two different texts. Those are found by a partial aggregate
   (anchor, min and max text hash), so a passage in a third of all documents is
   combined before it is shuffled and never meets in one task as a group.
3. Extension both ways. Around each surviving anchor every window that it seeds
   is a way to extend the anchor by i words to the left and the rest to the
   right. The windows carry a 64-bit window hash and 16 bits of the anchor, and
   the smallest document id of each is again a partial aggregate. Windows with an
   earlier document survive.
4. Maximal repeats. Surviving windows of a document that touch or overlap merge
   into spans: those are the maximal repeats of at least ``length`` words.

Equal texts are settled by a digest beforehand: a copy with a larger id is one
repeat from end to end, and only anchors of texts that differ travel further.

Texts are read three times and move only where they must: a filter of fixed size
over the ids that have a shared anchor, then over those that have a repeat, is
asked where the texts are read; the texts it clears are never shuffled.

Defined cases: null text is a document without words; a null id is neither
earlier nor later than any other, so its row keeps every word and gives none;
documents under ``length`` words keep all; rows with the same id are no copies
of each other, and are told apart by a 64-bit hash of their texts; a text of any
length is handled whole, alone if it is longer than a slice; of equal smallest
hashes in a window the rightmost is the anchor; windows count as equal if 64 bits
of their own and 16 of their anchor are; other columns, whatever their names,
pass or are ignored; an empty table gives an empty result. Ids must be castable
to long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.textvec import Words, grams, signed, slices, spans_inside, text_of
from arcweave.runtime import discard, id_filter, materialize, may_hold, redeal

LENGTH = 13
SEED = 5


def anchors_of(w: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the anchor word of each, the seed grams, and the text of each word."""
    n = len(w)
    at = spans_inside(w.first, n, length)
    g = grams(w.hashes, seed)
    if not len(at):
        return at, at, g, text_of(w.first, n)
    best, where = g[at].copy(), np.zeros(len(at), np.int64)
    for j in range(1, length - seed + 1):
        c = g[at + j]
        low = c <= best
        best[low] = c[low]
        where[low] = j
    return at, at + where, g, text_of(w.first, n)


def _emit_anchors(length: int, seed: int):
    """Columns in: doc, text, th. Out: one row per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in slices(b.column(1)):
                w = Words(data, offs)
                _, anchor, g, text = anchors_of(w, length, seed)
                if not len(anchor):
                    continue
                a = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
                t = text[a]
                yield pa.record_batch(
                    [pa.array(signed(g[a])), pa.array(ids[lo:hi][t]), pa.array(th[lo:hi][t]), pa.array((a - w.first[t]).astype(np.int32))],
                    names=["anchor", "doc", "th", "pos"],
                )

    return run


def _emit_windows(length: int, seed: int):
    """Columns in: doc, th, z, pos. Out: the windows of the shared anchors, keyed by window hash and 16 bits of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            shared = b.column(3)
            for lo, hi, data, offs in slices(unpack(b.column(2))):
                w = Words(data, offs)
                at, anchor, g, text = anchors_of(w, length, seed)
                if not len(at):
                    continue
                mark = np.zeros(len(w), bool)
                part = shared.slice(lo, hi - lo)
                pos = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                per = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                mark[pos + np.repeat(w.first[:-1], per)] = True
                keep = mark[anchor]
                at, anchor = at[keep], anchor[keep]
                if not len(at):
                    continue
                t = text[at]
                full = grams(w.hashes, length, salt=1)
                yield pa.record_batch(
                    [pa.array(signed(full[at])), pa.array(signed(g[anchor]).astype(np.int16)), pa.array(ids[lo:hi][t]), pa.array(th[lo:hi][t]), pa.array((at - w.first[t]).astype(np.int32))],
                    names=["win", "seed", "doc", "th", "start"],
                )

    return run


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the text column for the one shuffle that moves whole texts; the other columns pass."""
    c = zstandard.ZstdCompressor(level=3)
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            z = [None if x is None else c.compress(x.encode()) for x in part.column("text").to_pylist()]
            cols = [pa.array(z, pa.binary()) if n == "text" else part.column(i) for i, n in enumerate(part.schema.names)]
            yield pa.record_batch(cols, names=["z" if n == "text" else n for n in part.schema.names])


def unpack(z: pa.Array) -> pa.Array:
    d = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else d.decompress(x) for x in z.to_pylist()], pa.large_binary()).cast(pa.large_string())


def removed_mask(n: int, starts, length: int) -> np.ndarray:
    """Words covered by windows at the given starts."""
    d = np.zeros(n + 1, np.int32)
    s = np.unique(np.asarray(starts, np.int64))
    d[s] += 1
    np.subtract.at(d, np.minimum(s + length, n), 1)
    return np.cumsum(d[:-1]) > 0


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _emit_kept(length: int, with_text: bool, packed: bool):
    """Columns in: z (text, compressed if ``packed``), is_copy, starts and others that pass. Out: n_words, n_removed, digest, spans[, text]."""
    own = ("z", "is_copy", "starts")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def one(raw: bytes, copy: bool, starts) -> tuple:
        words = raw.split()
        n = len(words)
        if copy and n >= length:
            mask, kept = np.ones(n, bool), []
        elif starts is not None and len(starts):
            mask = removed_mask(n, starts, length)
            kept = [words[k] for k in np.flatnonzero(~mask)]
        else:
            mask, kept = None, words
        joined = b" ".join(kept)
        spans = [] if mask is None else [{"start": a, "end": z} for a, z in _spans(mask)]
        return n, n - len(kept), hashlib.sha256(joined).hexdigest(), spans, (raw if mask is None else joined).decode() if with_text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            rest = [n for n in b.schema.names if n not in own]
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                z, copy, starts = (part.column(n) for n in own)
                done = [
                    one((d.decompress(z[i].as_py()) if packed else z[i].as_py()) if z[i].is_valid else b"", copy[i].as_py(), starts[i].values.to_numpy(zero_copy_only=False) if starts[i].is_valid else None)
                    for i in range(part.num_rows)
                ]
                made = list(zip(*done, strict=True))
                cols = [part.column(n) for n in rest] + [pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.string()), pa.array(made[3], span)]
                names = [*rest, "n_words", "n_removed", "kept_sha256", "spans"]
                if with_text:
                    text = [t if z[i].is_valid else None for i, t in enumerate(made[4])]
                    cols.append(pa.array(text, pa.string()))
                    names.append("text")
                yield pa.record_batch(cols, names=names)

    return run


def _schema(df: DataFrame, drop: tuple[str, ...]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name not in drop)


def later_copies(base: DataFrame) -> DataFrame:
    """(cd, ct): id and text hash of the rows whose text a smaller id has as a whole."""
    digests = base.where("doc is not null and text is not null").select(F.sha2("text", 256).alias("sha"), "doc", "th")
    firsts = digests.groupBy("sha").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select(F.reverse("sha").alias("s"), "lo")
    copies = digests.join(firsts, F.reverse("sha") == F.col("s")).where("doc > lo")  # reversed, so both sides have an exchange of their own and a hot text can be split
    return materialize(copies.select(F.col("doc").alias("cd"), F.col("th").alias("ct")).distinct(), "copies")


def shared_seeds(base: DataFrame, copies: DataFrame, length: int, seed: int) -> DataFrame:
    """(sd, st, pos): per document the places of the anchors that a different text shares; later copies are left out."""
    found = base.where("doc is not null").select("doc", "text", "th").mapInArrow(_emit_anchors(length, seed), "anchor long, doc long, th long, pos int")
    shared = found.groupBy("anchor").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo <> hi").select(redeal(F.col("anchor")).alias("a"))
    seeds = found.join(shared.hint("shuffle_hash"), redeal(F.col("anchor")) == F.col("a")).groupBy("doc", "th").agg(F.collect_set("pos").alias("pos"))
    seeds = seeds.join(copies, (F.col("doc") == F.col("cd")) & (F.col("th") == F.col("ct")), "left_anti")
    return materialize(seeds.select(F.col("doc").alias("sd"), F.col("th").alias("st"), "pos"), "seeds")


def repeated_starts(base: DataFrame, seeds: DataFrame, length: int, seed: int) -> DataFrame:
    """(hd, ht, starts): per document the windows that start in an earlier document too."""
    live = may_hold(base.select("doc", "th", "text"), "doc", id_filter(seeds.select("sd")), "wanted").where("wanted").drop("wanted")
    packed = live.mapInArrow(_pack_texts, "doc long, th long, z binary")
    windows = packed.join(seeds.hint("merge"), (F.col("doc") == F.col("sd")) & (F.col("th") == F.col("st"))).select("doc", "th", "z", "pos")
    windows = windows.mapInArrow(_emit_windows(length, seed), "win long, seed short, doc long, th long, start int")
    first = windows.groupBy("win", "seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select(redeal(F.col("win")).alias("w"), F.col("seed").alias("s"), "lo")
    hits = windows.join(first.hint("shuffle_hash"), (redeal(F.col("win")) == F.col("w")) & (F.col("seed") == F.col("s"))).where("lo < doc")
    return materialize(hits.groupBy(F.col("doc").alias("hd"), F.col("th").alias("ht")).agg(F.collect_set("start").alias("starts")), "hits")


def keep_unrepeated(base: DataFrame, length: int, seed: int, with_text: bool) -> DataFrame:
    """base(doc, text, ...): the other columns pass through."""
    rest = [c for c in base.columns if c != "text"]
    base = base.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    copies = later_copies(base)
    seeds = shared_seeds(base, copies, length, seed)
    hits = repeated_starts(base, seeds, length, seed)
    discard(seeds)
    asked = materialize(id_filter(hits.select("hd").union(copies.select("cd"))), "filter")
    rows = may_hold(base, "doc", asked, "wanted")
    flat = rows.where("wanted").drop("wanted")
    packed = flat.mapInArrow(_pack_texts, ", ".join(f"`{f.name if f.name != 'text' else 'z'}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in flat.schema))
    on = lambda d, t: (F.col("doc") == F.col(d)) & (F.col("th") == F.col(t))
    joined = packed.join(hits.hint("merge"), on("hd", "ht"), "left").join(copies, on("cd", "ct"), "left").select(*rest, "z", F.col("cd").isNotNull().alias("is_copy"), "starts")
    free = rows.where("not wanted").select(*rest, F.col("text").cast("binary").alias("z"), F.lit(False).alias("is_copy"), F.lit(None).cast("array<int>").alias("starts"))
    schema = _schema(joined, ("z", "is_copy", "starts")) + "n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>" + (", text string" if with_text else "")
    return free.mapInArrow(_emit_kept(length, with_text, False), schema).unionByName(joined.mapInArrow(_emit_kept(length, with_text, True), schema))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, spans of the maximal repeats [, the kept text].

    Text is returned unchanged where nothing was removed; elsewhere the kept words joined by one space.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    out = keep_unrepeated(base, length, seed, with_text)
    return out.withColumnRenamed("doc", id_col)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with the repeats cut from the text and the length column, if any, brought up to date."""
    names = [c for c in docs.columns if c not in (id_col, text_col)]
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)])
    out = keep_unrepeated(base, length, seed, True)
    held = {c: F.col(f"__c{i}") for i, c in enumerate(names)} | {id_col: F.col("doc"), text_col: F.col("text")}
    if chars_col in names:
        held[chars_col] = F.when(F.col("text").isNull(), held[chars_col]).otherwise(F.char_length("text")).cast(docs.schema[chars_col].dataType)
    return out.select(*[held[c].alias(c) for c in docs.columns])
