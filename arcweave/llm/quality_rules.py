"""Quality rules with risk-controlled cutoffs.

Every document gets a few scores (higher is worse). For each stratum (language)
and rule a grid of cutoffs is tested on the labelled documents as a holdout: with
n documents labelled good in the stratum, of which k score above a cutoff, the
hypothesis "the cutoff rejects more than a share ``risk`` of good documents" is
refuted if the exact binomial tail P(X <= k | n, risk) (Clopper-Pearson bound) is
at most ``delta / (strata * rules)``. The cutoffs of one rule are a fixed sequence
from the laxest to the strictest, tested until one is not refuted: that needs no
split of delta over grid points, and as k only grows along it, the refuted cutoffs
are those whose own tail is small enough. Strata and rules are corrected for by
Bonferroni. Of the refuted cutoffs the one with the best gain on bad documents is
taken, where a good document lost costs ``cost`` bad ones found; ties go to the
laxer cutoff. A stratum without enough labels (ln(delta / tests) / ln(1 - risk)
good ones: 297 for four strata) gets no cutoff and rejects nothing. A document is
kept if no cutoff of its stratum is exceeded; with r rules the false rejections of
a stratum stay below r * risk with confidence 1 - delta.

Scores are functions of the row, so documents are read once to fit the cutoffs on
the labelled ones and once to judge; no text is shuffled, only the labelled rows' scores.

Everything is SQL functions: repeated 8-word windows are found inside a row by
hashing, the binomial tail by a recurrence in log space.

Defined cases: null text has no words (and fails the base rule); a null language
is a stratum of its own; labels other than 0 and 1 are not used; several labels of
one id count each; repeated rows give repeated results; a text of any length is
one row's expression; other columns, whatever their names, pass or are ignored;
empty in, empty out, and without labels only the base rule rejects. Ids must be
castable to long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.words import words_of
from arcweave.runtime import id_filter, materialize, may_hold

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SEPARATORS = " \t\n\x0b\x0c\r"
#: Cutoffs tried for each rule.
GRIDS: dict[str, list[float]] = {
    "symbols": [0.02 * i for i in range(1, 21)],
    "capitals": [0.05 * i for i in range(2, 20)],
    "dup_lines": [0.05 * i for i in range(1, 20)],
    "repeats": [0.02 * i for i in range(1, 21)],
    "exclaims": [0.05 * i for i in range(1, 20)],
}
RISK, DELTA, COST = 0.02, 0.05, 20


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words covered by windows that occur at least twice in the array; ``words`` must be a column."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(window)]))

    def covered(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
            found = F.filter(F.transform(s, lambda x, j: F.when(twin(x, j), x["i"])), lambda i: i.isNotNull())
            zero = F.struct(F.lit(0).alias("c"), F.lit(-(window + 1)).alias("last"))
            step = lambda a, i: F.struct((a["c"] + F.least(F.lit(window), i - a["last"])).alias("c"), i.alias("last"))
            return F.aggregate(F.array_sort(found), zero, step, lambda a: a["c"])

        return _let(tagged, starts)

    pick = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(n <= window, F.lit(0)).otherwise(_let(hashes, pick)).cast("long")


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``docs`` with a struct ``__q``: doc, stratum, base counts and rule scores."""
    rows = docs.select("*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).withColumn("__words", words_of(F.col("__text")))
    bare = lambda c: F.trim(c, F.lit(_SEPARATORS))
    lines = F.filter(F.split("__text", "\n"), lambda s: bare(s) != "")
    long = F.char_length("__text")
    without = lambda chars: F.char_length(F.translate(F.col("__text"), chars, ""))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("__words").cast("long").alias("__n"),
        without(_SEPARATORS).cast("long").alias("__chars"),
        (long - without(SYMBOLS)).cast("long").alias("__symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("__lines"),
        repeated_words(F.col("__words")).alias("__repeats"),
        (long - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("__caps"),
        (long - without("!?")).alias("__marks"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).cast("double")
    q = F.struct(
        F.col(id_col).cast("long").alias("doc"), F.col(stratum_col).cast("string").alias("stratum"),
        F.col("__n").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"), F.col("__lines.d").cast("long").alias("n_dup_lines"), F.col("__repeats").alias("n_repeat_words"),
        ((F.col("__n") < 20) | (F.lit(100) * F.col("__repeats") > F.lit(30) * F.col("__n"))).alias("base_failed"),
        share("__symbols", "__chars").alias("symbols"),
        share("__caps", "__chars").alias("capitals"),
        share("__lines.d", "__lines.n").alias("dup_lines"),
        share("__repeats", "__n").alias("repeats"),
        share("__marks", "__n").alias("exclaims"),
    )
    # a generator of one row: filters on __q stay above it, so the counts are made once a row
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(q)).alias("__q"))


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X ~ Bin(n, p), exact up to rounding: terms by recurrence, summed in log space."""
    odds = math.log(p) - math.log1p(-p)
    zero = F.struct((n * F.lit(math.log1p(-p))).alias("t"), (n * F.lit(math.log1p(-p))).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.lit(odds)
        hi, lo = F.greatest(a["s"], t), F.least(a["s"], t)
        return F.struct(t.alias("t"), (hi + F.log1p(F.exp(lo - hi))).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(terms, zero, step, lambda a: a["s"])


def certified_cutoffs(scored: DataFrame, grids: dict[str, list[float]] | None = None, risk: float = RISK, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """(stratum, rule, cutoff, n_good, k_good, k_bad) for the strata and rules with a certified cutoff.

    ``scored`` has stratum, good (boolean) and a column per rule: labelled rows that the base rule keeps.
    """
    grids = grids or GRIDS

    def above(rule: str, cuts: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: F.col(rule) > c))

    each = scored.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), above(r, cuts).alias("above")) for r, cuts in grids.items()])).alias("x"))
    counts = each.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.above").alias("above")).agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")
    )
    # grid point i (from 0) rejects the rows whose score exceeds more than i cutoffs
    points = F.create_map(*[x for r, cuts in grids.items() for x in (F.lit(r), F.array(*[F.lit(float(c)) for c in cuts]))])
    grid = counts.select("stratum", "rule").distinct().select("stratum", "rule", F.posexplode(points[F.col("rule")]).alias("i", "cutoff"))
    c = counts.select(F.col("stratum").alias("s"), F.col("rule").alias("r"), "above", "good", "bad")
    table = grid.join(c, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r"))).groupBy("stratum", "rule", "i", "cutoff").agg(
        F.sum("good").alias("n_good"),
        F.sum(F.when(F.col("above") > F.col("i"), F.col("good")).otherwise(0)).alias("k_good"),
        F.sum(F.when(F.col("above") > F.col("i"), F.col("bad")).otherwise(0)).alias("k_bad"),
    )
    strata = counts.select("stratum").distinct().count()
    limit = F.lit(math.log(delta / (max(1, strata) * len(grids))))
    sure = F.when(F.col("k_good") >= F.col("n_good") * F.lit(risk), F.lit(False)).otherwise(log_binomial_tail(F.col("k_good"), F.col("n_good"), risk) <= limit)
    gain = F.col("k_bad") - F.lit(cost) * F.col("k_good")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("cutoff"))
    ok = table.withColumn("gain", gain).where(sure & (F.col("k_bad") > 0) & (F.col("gain") > 0))
    return ok.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").select("stratum", "rule", "cutoff", "n_good", "k_good", "k_bad")


def fitted_cutoffs(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, label_col: str) -> DataFrame:
    """(__stratum, __cut): per stratum the certified cutoff of each rule, or null; fitted on the labelled documents alone."""
    rules = list(GRIDS)
    marks = labels.select(F.col(id_col).cast("long").alias("__lid"), F.col(label_col).cast("int").alias("__label")).where("__lid is not null and __label in (0, 1)")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.col(stratum_col).alias("lang"))
    asked = materialize(id_filter(marks.select("__lid")), "labelled")
    rows = may_hold(rows, "doc", asked, "__may").where("__may").drop("__may")
    scores = with_features(rows, "doc").where("not __q.base_failed").select("__q.doc", "__q.stratum", *[f"__q.{r}" for r in rules])
    held = materialize(scores.join(marks, F.col("doc") == F.col("__lid")).select("stratum", (F.col("__label") == 1).alias("good"), *rules), "held")
    cut = certified_cutoffs(held).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in rules])
    return materialize(cut.select(F.col("stratum").alias("__stratum"), F.struct(*rules).alias("__cut")), "cutoffs")


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, label_col: str) -> DataFrame:
    """``docs`` with __q, __over (number of cutoffs exceeded) and __kept, one row per input row."""
    cutoffs = fitted_cutoffs(docs, labels, id_col, text_col, stratum_col, label_col)
    joined = with_features(docs, id_col, text_col, stratum_col).join(cutoffs, F.col("__q.stratum").eqNullSafe(F.col("__stratum")), "left")
    over = F.lit(0)
    for r in GRIDS:
        over = over + F.coalesce(F.col(f"__q.{r}") > F.col(f"__cut.{r}"), F.lit(False)).cast("int")
    return joined.withColumn("__over", over).withColumn("__kept", (~F.col("__q.base_failed")) & (F.col("__over") == 0))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Base counts, base_failed, kept, and the number of cutoffs exceeded, one row per input row."""
    out = verdicts(docs.select(id_col, text_col, stratum_col), labels, id_col, text_col, stratum_col, label_col)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(F.col("__q.doc").alias(id_col), *[f"__q.{c}" for c in base], F.col("__kept").alias("kept"), F.col("__over").alias("rules_exceeded"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the rules keep: one pass over the documents, without a shuffle."""
    return verdicts(docs, labels, id_col, text_col, stratum_col, label_col).where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
