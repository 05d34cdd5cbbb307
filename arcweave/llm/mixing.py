"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a and normalised: q = p^a / sum.
The exponent is bisected until the mixture meets either a target entropy or a
repetition limit (largest over smallest number of passes). Each source then has
a quota of tokens q * budget. Quotas are realised as block permutations: a
source's documents are hashed into blocks of about ``BLOCK`` documents; blocks
are ordered by a keyed hash and documents inside a block by another. A source is
passed through in full as often as its quota allows; the last, partial pass
takes blocks in permutation order until the rest of the quota is used. With
``ordered`` the mixed rows come pass by pass in the order of the permutation.

By default the budget is the smallest that passes every source at least once,
so mixing repeats documents and drops none.

All sums are partial aggregates. The partial pass is a cut point per source,
found from the ranges of the permutation to one range's blocks to one block's
documents, so no task sums over all blocks of a source. Documents are then
chosen in place: the text is not shuffled unless the table of sources outgrows
Spark's own broadcast limit.

Defined cases: a null source is a source of its own; a source without tokens is
passed once; repeated rows are rows of their own (and share their hash, so they
fall on the same side of a cut); a null id draws by its text; a very long text
that does not fit into the rest of a quota ends the partial pass; rows whose
draws tie are taken or left together; an empty table gives an empty result;
columns of ``docs`` may have any name that does not start with two underscores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.draws import draw, range_of
from arcweave.llm.words import word_count
from arcweave.runtime import materialize

BLOCK = 1024
MAX_REPEAT = 1.5


def _bisect(low: float, high: float, above, steps: int = 60) -> float:
    """The point where the decreasing test ``above`` turns false."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) else (low, mid)
    return (low + high) / 2


def exponent_for_repeat(log_p_min: float, log_p_max: float, max_repeat: float) -> float:
    """Passes of a source go as p^(a-1): the ratio of the extremes falls as a rises to 1."""
    spread = log_p_max - log_p_min
    if spread * 1.0 <= math.log(max_repeat):
        return 0.0
    return _bisect(0.0, 1.0, lambda a: (1 - a) * spread > math.log(max_repeat))


def exponent_for_entropy(shares: DataFrame, target: float, high: float = 8.0, points: int = 63, passes: int = 7) -> float:
    """Exponent at which the entropy of q (nats) is ``target``; shares(log_p). Entropy falls as the exponent rises.

    A pass evaluates ``points`` inner points in one aggregate, i.e. six
    bisection steps, so the number of sources is not limited by the driver.
    """
    low = 0.0
    for _ in range(passes):
        grid = [low + (high - low) * (i + 1) / (points + 1) for i in range(points)]
        aggs = []
        for i, a in enumerate(grid):
            z = F.exp(F.lit(a) * F.col("log_p"))
            aggs += [F.sum(z).alias(f"z{i}"), F.sum(z * F.col("log_p")).alias(f"s{i}")]
        r = shares.agg(*aggs).first()
        ent = [math.log(r[f"z{i}"]) - a * r[f"s{i}"] / r[f"z{i}"] for i, a in enumerate(grid)]
        over = sum(1 for e in ent if e > target)
        low, high = ([low, *grid][over], [*grid, high][over])
    return (low + high) / 2


def plan_mixture(rows: DataFrame, target_entropy: float | None = None, max_repeat: float | None = MAX_REPEAT, budget: int | None = None) -> DataFrame:
    """Per source: tokens, docs, share, weight, epochs, cut_block, cut_doc. rows(source, n_tokens, block hash inputs doc_key)."""
    per = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    total = per.agg(F.sum("tokens").alias("t")).first().t or 0
    live = per.where("tokens > 0").withColumn("log_p", F.log(F.col("tokens") / F.lit(float(max(total, 1)))))
    ends = live.agg(F.min("log_p").alias("lo"), F.max("log_p").alias("hi")).first()
    if ends.lo is None:
        a = 1.0
    elif target_entropy is not None:
        a = exponent_for_entropy(live, target_entropy)
    else:
        a = exponent_for_repeat(ends.lo, ends.hi, max_repeat)
    norm = live.agg(F.sum(F.exp(F.lit(a) * F.col("log_p"))).alias("z")).first().z or 1.0
    weight = F.exp(F.lit(a) * F.col("log_p")) / F.lit(norm)
    if budget is None:
        budget = live.agg(F.max(F.col("tokens") / weight).alias("b")).first().b or 0.0
    quota = per.withColumn("log_p", F.when(F.col("tokens") > 0, F.log(F.col("tokens") / F.lit(float(max(total, 1)))))).withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    quota = quota.withColumn("quota", F.col("weight") * F.lit(float(budget)))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + F.lit(1e-9))).otherwise(F.lit(1)).cast("long")
    quota = quota.withColumn("epochs", passes).withColumn("rest", F.when(F.col("tokens") > 0, F.greatest(F.lit(0), F.floor(F.col("quota") - F.col("epochs") * F.col("tokens") + F.lit(1e-6)))).otherwise(F.lit(0)).cast("long"))
    quota = quota.withColumn("blocks", F.ceil(F.col("docs") / F.lit(BLOCK)).cast("long")).withColumn("exponent", F.lit(a))
    quota = materialize(quota.drop("log_p"), "quota")
    return materialize(_with_cuts(rows, quota), "mixture")


def block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(key, blocks)


def block_order(source: Column, block: Column, epoch: Column) -> Column:
    return draw("order", F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")), block, epoch)


def doc_order(key: Column, epoch: Column) -> Column:
    return draw("doc", key, epoch)


def _border(sums: DataFrame, order: list[str]) -> DataFrame:
    """The one row of each source in which the running total of ``t`` passes the rest; ``before`` is the total up to it."""
    run = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = sums.withColumn("before", F.col("base") + F.coalesce(F.sum("t").over(run), F.lit(0))).where("before <= rest and before + t > rest")
    return found.select(F.col("source").alias("bs"), *[F.col(c).alias(f"b_{c}") for c in order], F.col("before").alias("base"))


def _inside(located: DataFrame, border: DataFrame, keys: list[str]) -> DataFrame:
    on = F.col("source").eqNullSafe(F.col("bs"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"b_{k}"))
    return located.join(border, on).drop("bs", *[f"b_{k}" for k in keys])


def _with_cuts(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """The block and, inside it, the document draw up to which the partial pass takes documents."""
    q = quota.select(F.col("source").alias("qs"), "blocks", "epochs", "rest").where("rest > 0")
    located = rows.join(q, F.col("source").eqNullSafe(F.col("qs"))).withColumn("block", block_of(F.col("doc_key"), F.col("blocks")))
    located = located.withColumn("bo", block_order(F.col("source"), F.col("block"), F.col("epochs"))).withColumn("r", range_of(F.col("bo")))
    blocks = located.groupBy("source", "rest", "epochs", "r", "bo", "block").agg(F.sum("n_tokens").alias("t"))
    blocks = materialize(blocks, "blocks")
    ranges = blocks.groupBy("source", "rest", "r").agg(F.sum("t").alias("t")).withColumn("base", F.lit(0).cast("long"))
    border = _border(_inside(blocks, _border(ranges, ["r"]), ["r"]), ["bo", "block"])
    docs = _inside(located, border, ["bo", "block"]).withColumn("do", doc_order(F.col("doc_key"), F.col("epochs")))
    each = docs.groupBy("source", "bo", "block", "do", "base", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy("source", "bo", "block").orderBy("do").rowsBetween(Window.unboundedPreceding, 0)
    cuts = each.withColumn("upto", F.col("base") + F.sum("t").over(upto)).groupBy("source", "bo", "block").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("do"))).alias("cut_doc"))
    cuts = cuts.select(F.col("source").alias("cs"), F.col("bo").alias("cut_order"), F.col("block").alias("cut_block"), "cut_doc")
    return quota.join(cuts, F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs")


def with_copies(docs: DataFrame, mixture: DataFrame, key: Column, source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with __copies, __block and __rank columns; every column of docs stays."""
    m = mixture.select(F.col("source").alias("__s"), *[F.col(c).alias(f"__{c}") for c in ("weight", "epochs", "blocks", "rest", "cut_order", "cut_block", "cut_doc")])
    out = docs.withColumn("__key", key).join(m, F.col(source_col).eqNullSafe(F.col("__s")), "left")
    out = out.withColumn("__block", block_of(F.col("__key"), F.col("__blocks")))
    bo, do = block_order(F.col(source_col), F.col("__block"), F.col("__epochs")), doc_order(F.col("__key"), F.col("__epochs"))
    before_cut = (bo < F.col("__cut_order")) | ((bo == F.col("__cut_order")) & (F.col("__block") < F.col("__cut_block")))
    in_cut = (bo == F.col("__cut_order")) & (F.col("__block") == F.col("__cut_block")) & (do <= F.col("__cut_doc"))
    extra = F.when(F.col("__rest") <= 0, F.lit(0)).when(F.col("__cut_order").isNull(), F.lit(0)).when(F.coalesce(before_cut | in_cut, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return out.withColumn("__copies", (F.col("__epochs") + extra).cast("long"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("n_tokens"), _key(id_col, text_col).alias("doc_key"))


def _key(id_col: str, text_col: str) -> Column:
    return draw("key", F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """(id, source, n_tokens, copies, weight, block, block_order, doc_order): how often each row is shown and where in its source's first pass."""
    rows = materialize(_rows(docs, id_col, text_col, source_col), "mixrows")
    out = with_copies(rows, plan_mixture(rows, **targets), F.col("doc_key"))
    first = F.lit(0).cast("long")
    return out.select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "n_tokens", F.col("__copies").alias("copies"), F.col("__weight").alias("weight"), F.col("__block").alias("block"),
        block_order(F.col("source"), F.col("__block"), first).alias("block_order"), doc_order(F.col("__key"), first).alias("doc_order"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ordered: bool = False, **targets) -> DataFrame:
    """The mixed rows with the columns of ``docs``: each row as often as the mixture shows it.

    ``ordered`` sorts them by pass, then by block draw and document draw of that pass: the blocks of all
    sources come interleaved, and the last pass of a source holds the head of its permutation.
    """
    plan = plan_mixture(materialize(_rows(docs, id_col, text_col, source_col), "mixrows"), **targets)
    out = with_copies(docs, plan, _key(id_col, text_col), source_col)
    passes = F.when(F.col("__copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1))
    out = out.withColumn("__pass", F.explode(passes))
    if ordered:
        out = out.orderBy("__pass", block_order(F.col(source_col), F.col("__block"), F.col("__pass")), "__block", doc_order(F.col("__key"), F.col("__pass")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
