"""SimHash fingerprints by weighted term votes, and search by permuted block tables.

Every word votes on 64 bits with the bits of its hash; a word counts with a
weight that rises with its length, and once per occurrence. The votes are 32
sums of two 32-bit lanes each, all built-in aggregates: texts are exploded and
summed in the stage that reads them, and one row per text is shuffled.

Search: 64 bits are cut into 6 blocks. Two fingerprints within 3 bits agree on
at least 3 blocks, so each of the 20 choices of 3 blocks is a table keyed by
those blocks (about 32 bits); a pair is counted in the first table that brings it
together, and the true distance decides. Only distinct fingerprints are
joined.

Defined cases: null text is empty; a text without words has fingerprint 0; equal
texts have equal fingerprints; rows with equal ids are ordered by their text's
hash; a single row is its own next document; a null id comes first.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.runtime import materialize

RADIUS = 3
_LANE = 0x0000000100000001
_LOW = 0xFFFFFFFF


def term_weight(word: Column) -> Column:
    """0 for the empty string, then length squared over 4, between 1 and 15."""
    n = F.char_length(word)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(F.lit(15), F.shiftright(n * n, 2)))).cast("long")


def _votes(texts: DataFrame, keys: list[str], text_col: str, extra: dict[str, Column]) -> DataFrame:
    """Per key: total weight, 32 two-lane sums, and the largest of each extra (a long, read at a text's first word)."""
    words = texts.select("*", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+")).alias("p", "w"))
    votes = words.select(*keys, F.xxhash64("w").alias("h"), term_weight(F.col("w")).alias("q"), *[F.when(F.col("p") == 0, c).alias(n) for n, c in extra.items()])
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANE)) * F.col("q")).alias(f"s{k}") for k in range(32)]
    return votes.groupBy(*keys).agg(F.sum("q").alias("total"), *lanes, *[F.max(n).alias(n) for n in extra])


def _signs() -> Column:
    """The fingerprint: a bit is set if more than half of the weight voted for it."""
    fp = None
    for k in range(32):
        s = F.col(f"s{k}")
        low = F.when(s.bitwiseAND(F.lit(_LOW)) * 2 > F.col("total"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        top = (1 << (k + 32)) if k < 31 else -(1 << 63)
        high = F.when(F.shiftrightunsigned(s, 32) * 2 > F.col("total"), F.lit(top).cast("long")).otherwise(F.lit(0).cast("long"))
        both = low.bitwiseOR(high)
        fp = both if fp is None else fp.bitwiseOR(both)
    return fp


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(keys, fingerprint long, extras): one row per distinct key, from the votes of all its texts."""
    return _votes(texts, keys, text_col, extra or {}).select(*keys, _signs().alias("fingerprint"), *(extra or {}))


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of bits that differ."""
    return (F.lit(64) - F.bit_count(a.bitwiseXOR(b))).cast("double") / F.lit(64.0)


def _masks(blocks: int = 6, agree: int = 3) -> list[int]:
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    masks, at = [], 0
    for w in widths:
        masks.append(((1 << w) - 1) << at)
        at += w
    out = []
    for c in combinations(masks, agree):
        m = sum(c)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def neighbours(queries: DataFrame, table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, found, distance) for all distinct fingerprints within ``radius`` bits; both inputs have column fingerprint."""
    masks = _masks(radius + 3, 3)
    keyed = lambda df, name: df.select(F.col("fingerprint").alias(name)).distinct().select(
        name, F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in masks])).alias(f"{name}_t", f"{name}_k")
    )
    diff = F.col("query").bitwiseXOR(F.col("found"))
    first = F.lit(len(masks))
    for i, m in reversed(list(enumerate(masks))):
        first = F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(i)).otherwise(first)
    on = (F.col("query_t") == F.col("found_t")) & (F.col("query_k") == F.col("found_k")) & (F.bit_count(diff) <= radius) & (F.col("query_t") == first)
    return keyed(queries, "query").join(keyed(table, "found"), on).select("query", "found", F.bit_count(diff).alias("distance"))


def next_by_id(ids: DataFrame, id_col: str, tie_col: str) -> DataFrame:
    """ids plus next_id and next_tie in ascending order, the last followed by the first.

    Rows are dealt by id ranges once and the ranges kept; each range is a
    window of its own, and a table of one row per range links their ends.
    """
    ranged = materialize(ids.repartitionByRange(id_col, tie_col).withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__part").orderBy(id_col, tie_col)
    here = F.struct(F.col(id_col).alias("i"), F.col(tie_col).alias("t"))
    inner = ranged.withColumn("__next", F.lead(here).over(w))
    heads = ranged.groupBy("__part").agg(F.min(here).alias("head"))
    links = heads.withColumn("__after", F.coalesce(F.lead("head").over(Window.orderBy("__part")), F.first("head").over(Window.orderBy("__part"))))
    links = links.select(F.col("__part").alias("__p"), "__after")
    nxt = F.coalesce(F.col("__next"), F.col("__after"))
    return inner.join(links, F.col("__part") == F.col("__p")).select(*ids.columns, nxt["i"].alias("next_id"), nxt["t"].alias("next_tie"))


def simhash_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, every: int = 100) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and the search result.

    The edited text has its last half replaced by the head of the next document.
    ``n_within`` is the number of rows whose fingerprint lies within ``radius`` bits;
    it is given for the queries: rows whose id is divisible by ``every``.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("tie", F.xxhash64("text"))
    ids = base.select("id", "tie", F.char_length("text").cast("long").alias("n")).groupBy("id", "tie").agg(F.max("n").alias("n_chars"), F.count(F.lit(1)).alias("rows"))
    chain = materialize(next_by_id(ids, "id", "tie"), "chain")
    same = lambda a, b, x, y: F.col(a).eqNullSafe(F.col(b)) & (F.col(x) == F.col(y))
    asks = chain.select(F.col("next_id").alias("ai"), F.col("next_tie").alias("at"), F.col("id").alias("pi"), F.col("tie").alias("pt"), F.shiftright("n_chars", 1).cast("int").alias("ask"))
    heads = base.join(asks, same("id", "ai", "tie", "at")).select("pi", "pt", F.substring(F.col("text"), F.lit(1), F.col("ask")).alias("head"))
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.shiftright(n, 1)), F.col("head"))
    both = base.join(heads, same("id", "pi", "tie", "pt")).select("id", "tie", "text", edited.alias("edited"))
    digest = F.when(F.col("kind") == 1, F.sha2("body", 256))
    kinds = both.select("id", "tie", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("x"))
    kinds = kinds.select("id", "tie", F.col("x.kind").alias("kind"), F.col("x.body").alias("body"))
    parts = {f"d{i}": F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)}
    prints = fingerprints(kinds, ["id", "tie", "kind"], "body", parts)
    sha = F.concat(*[F.lpad(F.lower(F.hex(F.max(F.when(F.col("kind") == 1, F.col(d))))), 16, "0") for d in parts])
    pair = prints.groupBy("id", "tie").agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("efp"), sha.alias("edited_sha256"))
    k = chain.select(F.col("id").alias("ci"), F.col("tie").alias("ct"), "n_chars", "rows", "next_id", "next_tie")
    table = materialize(pair.join(k, same("id", "ci", "tie", "ct")).drop("ci", "ct"), "prints")

    after = table.select(F.col("id").alias("ni"), F.col("tie").alias("nt"), F.col("fp").alias("next_fp"))
    sizes = table.groupBy("fp").agg(F.sum("rows").alias("n"))
    asked = table.where(F.col("id") % every == 0).select(F.col("fp").alias("fingerprint"))
    near = neighbours(asked, sizes.select(F.col("fp").alias("fingerprint")), radius)
    within = near.join(sizes, F.col("found") == F.col("fp")).groupBy("query").agg(F.sum("n").alias("n_within"))
    out = table.join(after, same("next_id", "ni", "next_tie", "nt")).join(within, (F.col("fp") == F.col("query")) & (F.col("id") % every == 0), "left")
    out = out.withColumn("__i", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within",
    )
