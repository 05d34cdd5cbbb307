"""Text operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.llm import chat_format, license_scan, minhash, mixing, packing, quality_rules, registry, sharding, simhash, substring_dedup, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, slot string, weight double, words string, bucket string"


def passage(i, n=30):
    return " ".join(f"w{i}x{j}" for j in range(n))


def awkward_rows():
    """Nulls in every column, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"tok{j % 4001}" for j in range(12000))
    near = passage(9, 200)
    texts = [
        passage(1), passage(1), passage(1) + " tail one", "intro " + passage(1, 20) + " and more", "", "   \n\t ", None, "short text", "one",
        long, long + " end", passage(2) + "\n" + passage(2), "***&&& $$$ %%% " * 12, "line a b\nline a b\nline c", near, near.replace("w9x77", "changed"),
        "É é ß words\x0bwith\x0cseparators\r\nhere", "Released under the MIT License. The mit license; MIT-License", passage(3, 13), passage(3, 12),
        "\U0001f600 emoji \U0001f600", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, None, i, "x", 0.5, "w", "b") for i, t in enumerate(texts)]
    rows.append((None, passage(1), "en", "s0", 3, None, None, None, None, None))
    rows.append(rows[7])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0), (12, 0, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def bag(rows):
    return sorted(map(repr, map(tuple, rows)))


def word_list(t):
    return WORD.findall(t or "")


def test_word_columns(docs):
    for r in docs.select("text", words.words_of(F.col("text")).alias("w"), words.word_count(F.col("text")).alias("n")).collect():
        assert list(r.w) == word_list(r.text) and r.n == len(word_list(r.text))


# ------------------------------------------------------------ substring dedup


def expected_kept(rows, length=13):
    first = {}
    for i, t in rows:
        if i is None:
            continue
        w = word_list(t)
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = word_list(t)
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if i is not None and first[tuple(w[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(docs, empty):
    got = substring_dedup.substring_dedup(docs).drop("spans").collect()
    assert bag(got) == bag(expected_kept([(r.doc_id, r.text) for r in docs.collect()]))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_spans_are_maximal(spark):
    df = spark.createDataFrame([(1, "x " + passage(1, 40)), (2, "y " + passage(1, 40) + " z " + passage(1, 15))], "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substring_dedup.substring_dedup(df).collect()}
    assert spans == {1: [], 2: [(1, 41), (42, 57)]}


def test_drop_repeats_keeps_columns(docs):
    out = substring_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {(r.doc_id, r.source): r for r in out.collect()}
    assert rows[(2, "s2")].text == "tail one" and rows[(2, "s2")].n_chars == 8 and rows[(2, "s2")].slot == "x"
    assert rows[(6, "s0")].text is None


# ------------------------------------------------------------------- toxicity


def test_toxicity_learns(spark):
    rng = np.random.default_rng(3)
    syl = ["ba", "ko", "ri", "tu", "ne", "mo", "sa", "li"]
    rows, lab = [], []
    for i in range(400):
        w = ["".join(rng.choice(syl, 3)) for _ in range(60)]
        bad = i % 2
        if bad:
            for p in rng.integers(0, 60, 4):
                w[p] = "zvrkak"
        rows.append((i, " ".join(w)))
        lab.append((i, bad))
    d, lb = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, lb).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].predicted == lab[i][1] for i in held]) > 0.95


def test_toxicity_awkward(docs, empty, labels):
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_not_used(spark):
    d = spark.createDataFrame([(i, f"text number {i} abc") for i in range(60)], "doc_id long, text string")
    a = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    flip = a.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert bag(toxicity.score_toxicity(d, a).collect()) == bag(toxicity.score_toxicity(d, flip).collect())


# -------------------------------------------------------------- quality rules


def base_counts(t):
    t = t or ""
    w = word_list(t)
    n = len(w)
    at = collections.defaultdict(list)
    for s in range(n - 7):
        at[tuple(w[s : s + 8])].append(s)
    covered = {p for v in at.values() if len(v) > 1 for s in v for p in range(s, s + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base(docs, empty, labels):
    got = quality_rules.judge(docs, labels).collect()
    assert bag([tuple(r)[:7] for r in got]) == bag([(r.doc_id, *base_counts(r.text)) for r in docs.collect()])
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels to certify a cutoff
    assert quality_rules.judge(empty, labels).count() == 0
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_binomial_tail(spark):
    from math import comb, log

    for n, k, p in [(10, 0, 0.3), (50, 3, 0.1), (400, 2, 0.01), (5, 5, 0.5)]:
        want = log(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
        got = spark.range(1).select(quality_rules.log_binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert abs(got - want) < 1e-9


def test_certified_cutoffs(spark):
    good = [("en", True, 0.01 * (i % 3)) for i in range(3000)] + [("de", True, 0.0)] * 50
    bad = [("en", False, 0.5)] * 200 + [("de", False, 0.5)] * 50
    df = spark.createDataFrame(good + bad, "stratum string, good boolean, symbols double")
    got = quality_rules.certified_cutoffs(df, {"symbols": [0.005, 0.1, 0.3, 0.6]}).collect()
    assert [(r.stratum, r.cutoff, r.k_good, r.k_bad) for r in got] == [("en", 0.3, 0, 200)]  # the laxest that finds all; de has too few labels


# -------------------------------------------------------------------- packing


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(5)
    for _ in range(20):
        v = sorted(rng.choice(200, 8, replace=False).tolist())
        c = rng.integers(1, 30, 8).tolist()
        cost = lambda cuts: sum(n * (min(u for u in cuts if u >= x) - x) for x, n in zip(v, c, strict=True))  # noqa: B023, E731
        best = min(cost([*x, v[-1]]) for k in range(3) for x in combinations(v[:-1], k))
        assert cost(packing.optimal_boundaries(v, c, 3)) == best


def test_pack(docs, empty):
    got = packing.pack(docs, budget=500).collect()
    assert bag((r.doc_id, r.n_tokens) for r in got) == bag((r.doc_id, len(word_list(r.text))) for r in docs.collect())
    batches = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.padding == r.bucket_len - r.n_tokens
        batches[r.bucket, r.batch].append(r)
    for rows in batches.values():
        assert len(rows) == 1 or sum(r.bucket_len for r in rows) <= 500
        assert sorted(r.batch_slot for r in rows) == list(range(len(rows)))
    assert packing.pack(empty).count() == 0


def test_long_lengths_have_exact_boundaries(spark):
    from itertools import combinations

    rng = np.random.default_rng(6)
    lengths = [int(x) for x in np.r_[rng.choice(np.arange(1, 2049), 3), rng.choice(np.arange(2049, 20000), 9, replace=False)] for _ in range(rng.integers(1, 6))]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long").withColumn("text", F.lit("x"))
    got = packing.pack(rows, tokens=F.col("n"), buckets=4).collect()
    v = sorted(set(lengths))
    cost = lambda cuts: sum(min(u for u in cuts if u >= x) - x for x in lengths)
    assert sum(r.padding for r in got) == min(cost([*x, v[-1]]) for k in range(4) for x in combinations(v[:-1], k))
    assert {r.bucket_len for r in got} <= set(v) and max(r.bucket_len for r in got) == v[-1]


def test_length_bins_are_bounded(spark):
    bins = spark.range(1, 200000).select(packing.length_bin(F.col("id")).alias("b"), "id")
    assert bins.where("b < id or (id > 2048 and b > id * 1.02)").count() == 0
    assert bins.select("b").distinct().count() < 4096


# ---------------------------------------------------------------- chat format


def test_chat_round_trip(spark):
    turns = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\b\\l\\h\\\\"), ("sys:tem\n", "<#>"), (None, None), ("assistant", "")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(1, 1, "assistant", "tie"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    f = chat_format.format_chat(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    back = f.where("conv_id = 1").select(chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("l")).first()
    want = [(r or "", t or "") for r, t in turns[:2]] + [("assistant", "tie")] + [(r or "", t or "") for r, t in turns[2:]]
    assert [tuple(x) for x in back.t] == want
    assert back.l == "".join(t for r, t in want if r == "assistant")
    assert f.count() == 2
    assert chat_format.digest_chat(chat_format.format_chat(df.limit(0).withColumn("parts", chat_format.text_part(F.col("text"))))).count() == 0


def test_chat_parts(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part(type="text", text="look <"), part(type="image", ref="a.png", width=56, height=29), part(type="text", text=" and "), part(type="audio", ref="b.wav", seconds=2.0), part(type="document", ref="c.pdf", pages=3)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part(type="text", text="ok")])], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.format_chat(df).first()
    assert r.formatted == "### user: look \\l<image:0.1> and <audio:0.3><document:0.4></turn>\n### assistant: ok</turn>\n"
    assert [(a.turn, a["index"], a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 4), (0, 3, "audio", "b.wav", 50), (0, 4, "document", "c.pdf", 1536)]
    assert r.placeholder_tokens == 1590
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == ["ok"]


# -------------------------------------------------------------- license scans


def test_license_base(docs, empty):
    out = []
    for r in docs.collect():
        w = license_scan.template_words(r.text or "")
        at = sorted((s, lab) for p, lab in license_scan.PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        out.append((r.doc_id, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = license_scan.scan_licenses(docs).collect()
    assert bag(tuple(r)[:6] for r in got) == bag(out)
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_diagonals(spark):
    notice = "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    inserted = "Licensed under the Apache License, Version 2.0 (the \"License\"); hereby you may not use this very file except in compliance with the License. You may obtain a copy of the License at"
    rows = [(1, "intro " + inserted), (2, notice), (3, "nothing here at all"), (4, "x Licensed under CC BY-NC 4.0. y")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache,apache-2.0-notice,apache-2.0-text" and got[1].base_labels == "apache"
    assert got[2].labels == "apache-2.0-text" and got[3].labels == "" and got[3].score == 0
    assert got[4].labels == "cc-by-nc-4.0-notice" and got[4].score == 1


def test_license_interrupted_copies(spark):
    """Sections with words dropped, inserted and cut off: the diagonals decide, and half a section is not enough."""
    text = {lab: t.split() for lab, t in license_scan.TEMPLATES if lab in ("mit-disclaimer", "bsd-conditions", "isc-text")}
    rows, want = [], {}
    for i, (lab, w) in enumerate(sorted(text.items())):
        rows += [(10 * i, " ".join(["x"] * 5 + w[:9] + w[10:20] + ["really"] + w[20:] + ["y"])), (10 * i + 1, " ".join(w[: len(w) // 2])), (10 * i + 2, " ".join(w[len(w) // 2 :] + w[: len(w) // 2]))]
        want |= {10 * i: lab, 10 * i + 1: "", 10 * i + 2: ""}
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.labels for i, r in got.items()} == want
    assert all(license_scan.COVER <= got[10 * i].score < 1 for i in range(3))


def test_long_texts_and_conversations(spark):
    """One text of 200,000 words and one conversation of 8,000 turns: both are read in time linear in their length."""
    text = " ".join(f"w{i % 5000}" for i in range(200_000)) + " Licensed under the Apache License, Version 2.0."
    r = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.first_word, r.labels) == (200_008, 200_003, "apache,apache-2.0-notice")
    turns = spark.range(8000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("a <b> # "), 20).alias("text"))
    got = chat_format.digest_chat(chat_format.format_chat(turns.withColumn("parts", chat_format.text_part(F.col("text"))))).first()
    assert (got.n_turns, got.loss_chars) == (8000, 4000 * 160)
    assert got.loss_sha256 == hashlib.sha256(("a <b> # " * 20 * 4000).encode()).hexdigest()


# ------------------------------------------------------------------- simhash


def test_simhash_report(docs, empty):
    rows = sorted({(r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()})
    want = {}
    for k, (i, t) in enumerate(rows):
        n, nxt = len(t), rows[(k + 1) % len(rows)][1]
        edited = t[: n - n // 2] + nxt[: n // 2]
        want[i] = (n, hashlib.sha256(edited.encode()).hexdigest())
    got = simhash.simhash_report(docs).collect()
    assert len(got) == docs.count()
    prints = collections.defaultdict(set)
    text = {(r.doc_id if r.doc_id is not None else -1): r.text or "" for r in docs.collect()}
    for r in got:
        i = r.doc_id if r.doc_id is not None else -1
        assert (r.n_chars, r.edited_sha256) == want[i] and len(r.fingerprint) == 16
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[text[i]].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert simhash.simhash_report(empty).count() == 0


def test_simhash_votes(spark):
    t = "alpha beta beta gamma"
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in set(t.split())], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    weight = lambda w: max(1, min(15, len(w) ** 2 // 4))
    bits = 0
    for b in range(64):
        if sum(weight(w) * (1 if h[w] >> b & 1 else -1) for w in t.split()) > 0:
            bits |= 1 << b
    got = simhash.fingerprints(spark.createDataFrame([(1, t)], "id long, text string"), ["id"]).first().fingerprint
    assert got % 2**64 == bits


def test_block_tables_find_all(spark):
    rng = np.random.default_rng(11)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    prints = list(base)
    for x in base:
        for k in range(1, 6):
            y = x % 2**64
            for b in rng.choice(64, k, replace=False):
                y ^= 1 << int(b)
            prints.append(y - 2**64 if y >= 2**63 else y)
    t = spark.createDataFrame([(x,) for x in prints], "fingerprint long")
    q = t.limit(60)
    got = {(r.query, r.found) for r in simhash.neighbours(q, t).collect()}
    pop = lambda a, b: bin((a ^ b) % 2**64).count("1")
    assert got == {(r.fingerprint, p) for r in q.collect() for p in prints if pop(r.fingerprint, p) <= 3}


def test_simhash_equals_brute_force(docs):
    xxhash = pytest.importorskip("xxhash")

    def fingerprint(t):
        votes = np.zeros(64, np.int64)
        for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" "):
            if w:
                h = xxhash.xxh64_intdigest(w.encode(), seed=42)
                votes += max(1, min(15, len(w) ** 2 // 4)) * (2 * ((h >> np.arange(64, dtype=np.uint64).astype(object)) & 1).astype(np.int64) - 1)
        return sum(1 << b for b in range(64) if votes[b] > 0)

    like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    rows = sorted((r.doc_id, r.text or "") for r in docs.where("doc_id is not null").distinct().collect())
    prints = [fingerprint(t) for _, t in rows]
    got = simhash.simhash_report(docs.where("doc_id is not null").distinct(), every=2).collect()
    assert len(got) == len(rows)
    for r in got:
        k = [i for i, _ in rows].index(r.doc_id)
        t, nxt = rows[k][1], rows[(k + 1) % len(rows)][1]
        edited = fingerprint(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2])
        assert (r.fingerprint, r.edited_fingerprint) == (f"{prints[k]:016x}", f"{edited:016x}")
        assert (r.near_edited, r.near_next) == (like(prints[k], edited), like(prints[k], prints[(k + 1) % len(rows)]))
        assert r.n_within == (sum(bin(prints[k] ^ p).count("1") <= 3 for p in prints) if r.doc_id % 2 == 0 else None)


# ----------------------------------------------------------- SQL counterparts


@pytest.mark.parametrize("name", ["op4_packing", "op8_mixing", "op10_sharding"])
@pytest.mark.parametrize("table", ["awkward", "sf0.001"])
def test_sql_counterpart(spark, docs, data, tmp_path, name, table):
    duckdb = pytest.importorskip("duckdb")
    if table == "awkward":
        path = str(tmp_path)
        docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
        files = f"{path}/documents.parquet/*.parquet"
    else:
        path, files = data, f"{data}/documents.parquet"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{files}'")
    got = registry.QUERIES[name](spark, path)
    cols = sorted(got.columns)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == cols
    assert bag(got.select(*cols).collect()) == bag(want.select(*cols).fetchall())


# -------------------------------------------------------------------- mixing


def test_mixing(spark, empty):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else "small", "x") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")
    got = mixing.mix_report(df, max_repeat=3.0).collect()
    assert len(got) == 5000 and min(r.copies for r in got) >= 1
    shown, own = collections.Counter(), collections.Counter()
    for r in got:
        shown[r.source] += r.copies * r.n_tokens
        own[r.source] += r.n_tokens
    assert shown["big"] == own["big"] and 2.9 < shown["small"] / own["small"] <= 3.0
    out = mixing.mix(df, max_repeat=3.0)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_partial_pass_is_the_head_of_the_permutation(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(n), "a" if i < 9000 else "b") for i, n in enumerate(rng.integers(0, 40, 12000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(df, budget=int(0.8 * sum(len(r[1]) // 2 for r in rows))).collect()
    md5 = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:13], 16)
    plan = {r.source: r for r in mixing.plan_mixture(mixing._rows(df, "doc_id", "text", "source"), budget=int(0.8 * sum(len(r[1]) // 2 for r in rows))).collect()}
    for source, p in plan.items():
        mine = [r for r in got if r.source == source]
        keys = {r.doc_id: md5("key", r.doc_id, "") for r in mine}
        assert all(r.block == keys[r.doc_id] % p.blocks for r in mine)
        order = sorted(mine, key=lambda r: (md5("order", "s" + source, r.block, p.epochs), r.block, md5("doc", keys[r.doc_id], p.epochs)))
        total, taken = 0, []
        for r in order:
            total += r.n_tokens
            if total > p.rest:
                break
            taken.append(r.doc_id)
        assert p.rest > 0 and {r.doc_id for r in mine if r.copies > p.epochs} == set(taken) and 0 < len(taken) < len(mine)


def test_ordered_mixture_runs_pass_by_pass(spark):
    rows = [(i, "a b", "big" if i % 4 else "small") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shown = {r.doc_id: r for r in mixing.mix_report(df, max_repeat=2.0).collect()}
    out = [r.doc_id for r in mixing.mix(df, max_repeat=2.0, ordered=True).collect()]
    first = sorted(shown.values(), key=lambda r: (r.block_order, r.block, r.doc_order))
    assert out[:3000] == [r.doc_id for r in first]
    assert collections.Counter(out) == {i: r.copies for i, r in shown.items()}


def test_mixing_awkward(docs):
    got = mixing.mix_report(docs).collect()
    assert len(got) == docs.count() and all(r.copies >= 1 for r in got)
    assert mixing.mix(docs).columns == docs.columns


def test_target_entropy(spark):
    shares = [0.7, 0.2, 0.1]
    df = spark.createDataFrame([(float(np.log(p)),) for p in shares], "log_p double")
    a = mixing.exponent_for_entropy(df, 1.0)
    q = np.array(shares) ** a
    q /= q.sum()
    assert abs(-(q * np.log(q)).sum() - 1.0) < 1e-6


def test_budget_is_kept(spark):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 2}") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix_report(df, budget=3000).collect()
    assert 2900 <= sum(r.copies * r.n_tokens for r in got) <= 3000


# ------------------------------------------------------------------- minhash


def counts(t, k=5):
    w = word_list(t)
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else collections.Counter([tuple(w)] if w else [])


def jaccard(a, b):
    low = sum(min(a[s], b[s]) for s in a if s in b)
    total = sum(a.values()) + sum(b.values()) - low
    return low / total if total else 0.0


def test_minhash_classes(docs, empty):
    got = minhash.near_duplicate_classes(docs).collect()
    assert len(got) == docs.count()
    cls = {r.doc_id: r.class_id for r in got}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for a in rows:
        for b in rows:
            if a < b:
                j = jaccard(counts(rows[a]), counts(rows[b]))
                if (rows[a] or "") == (rows[b] or "") or j >= 0.85:
                    assert cls[a] == cls[b], (a, b, j)
                if j < 0.7 and (rows[a] or "") != (rows[b] or ""):
                    assert cls[a] != cls[b], (a, b, j)
    assert cls[None] is None
    assert minhash.near_duplicate_classes(empty).count() == 0
    kept = minhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 1 not in ids and 0 in ids and None in ids and 15 not in ids


def idf_by_count(texts, common=minhash.COMMON, floor=minhash.FLOOR):
    """Weights of all shingles from plain counts: texts is a list of shingle counters, one per row."""
    n, df = len(texts), collections.Counter(x for c in texts for x in c)
    scale = np.log(max(2.0, min(n, 1 / common)))
    return {x: 1.0 if m < max(2, np.ceil(common * n)) else floor + (1 - floor) * np.clip(np.log(n / m) / scale, 0, 1) for x, m in df.items()}


def weighted_similarity(x, y, idf):
    return sum(idf[s] * min(x[s], y[s]) for s in x) / max(1e-9, sum(idf[s] * max(x[s], y[s]) for s in x | y))


@pytest.mark.parametrize("width", [minhash.WIDTH, minhash.CHUNK])  # the second as crowded as for a very large corpus
def test_common_shingles_are_counted_exactly(docs, empty, monkeypatch, width):
    monkeypatch.setattr(minhash, "HELD", 64)  # several flushes a task
    for common in (1 / 1024, 0.1):
        got = minhash.common_shingles(docs.select("text"), 5, common, width)
        df = collections.Counter(x for r in docs.collect() for x in counts(r.text))
        least = max(2, np.ceil(common * docs.count()))
        want = minhash.Idf(docs.count(), got.flags, np.zeros(0, np.uint64), np.array([n for n in df.values() if n >= least], float), common)
        assert sorted(got.weights) == sorted(want.weights)
    assert len(minhash.common_shingles(empty.select("text"), 5, width=width).known) == 0


def test_minhash_decides_by_exact_frequencies(spark):
    words = lambda name, n: " ".join(f"{name}x{j}" for j in range(n))
    rows = []
    for p, shared in enumerate(range(470, 1120, 26)):  # similarity from 0.7 to 0.85
        rows += [(2 * p + i, words(f"b{p}", shared + 4) + " " + words(f"t{p}y{i}", 100)) for i in range(2)]
    rows += [(1000 + i, words("b13", 400) + " " + words(f"z{i}", 300)) for i in range(6)]  # some shingles of pair 13 are common
    for p, shared in enumerate(range(796, 840, 4)):  # close to 0.8
        rows += [(200 + 2 * p + i, words(f"c{p}", shared + 4) + " " + words(f"u{p}y{i}", 100)) for i in range(2)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: counts(t) for i, t in rows}
    idf = idf_by_count(list(texts.values()))
    close = 0
    for a in sorted(x for x in texts if x < 1000 and x % 2 == 0):
        j = weighted_similarity(texts[a], texts[a + 1], idf)
        assert (got[a] == got[a + 1]) == (j >= 0.8), (a, j)
        close += 0.7 <= j <= 0.85
    assert close > 20


def test_minhash_equals_brute_force_over_a_table(spark):
    """Classes of sf0.001 and sf0.01 against all pairs by weighted Jaccard similarity: recall and precision."""
    for sf in ("sf0.001", "sf0.01"):
        df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        rows = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        texts = {i: counts(t) for i, t in rows.items()}
        idf = idf_by_count(list(texts.values()))
        first = {}
        for i in sorted(rows):
            first.setdefault(rows[i], i)
        holders = collections.defaultdict(list)
        for i in first.values():
            for x in texts[i]:
                holders[x].append(i)
        label = {i: i for i in first.values()}

        def root(i):
            while label[i] != i:
                i = label[i]
            return i

        links = {(a, b) for v in holders.values() for a in v for b in v if a < b}
        near = [(a, b) for a, b in links if weighted_similarity(texts[a], texts[b], idf) >= 0.8]
        for a, b in near:
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
        got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(df).collect()}
        found = sum(got[a] == got[b] for a, b in near)
        assert found >= 0.9 * len(near)
        want = {i: root(first[rows[i]]) for i in rows}
        assert got == want, [(i, got[i], want[i]) for i in got if got[i] != want[i]][:5]


def test_a_group_of_edited_copies_stays_together(spark):
    """A third of all rows are copies of one text with a few words changed: its shingles are common, yet they decide."""
    rng = np.random.default_rng(8)
    base = [f"g{j}" for j in range(300)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.integers(0, 300, 3):
            w[p] = f"e{i}y{p}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, passage(100 + i, 120)) for i in range(300)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({got[i] for i in range(150)}) <= 3 and all(got[i] == i for i in got if i >= 1000)


def test_icws_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    h.sort()
    wa, wb = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    a = minhash.samples(h, wa, np.array([0]), 2000)
    b = minhash.samples(h, wb, np.array([0]), 2000)
    assert abs((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05
    assert abs(minhash.weighted_jaccard(h, wa, h, wb) - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 1e-12


def test_cross_pairs_finds_what_the_star_misses(spark):
    keys = spark.createDataFrame([(1, 10, 100.0), (1, 20, 100.0), (1, 30, 100.0), (1, 40, 100.0), (1, 50, 100.0), (1, 60, 79.0), (2, 10, 100.0)], "key long, rep long, weight double")
    none = spark.createDataFrame([], "node long, comp long")
    shared = minhash.shared_buckets(keys)
    assert {tuple(r) for r in minhash.star_pairs(shared, 0.8).collect()} == {(10, x) for x in (20, 30, 40, 50)}  # 60 is too light
    own = spark.createDataFrame([(30, 2.0), (40, 9.0), (50, 30.0), (60, 20.0)], "o long, own double")
    bounded = minhash.bounded_members(minhash.unsettled(shared, none), own, 0.8)
    assert {r.rep for r in bounded.collect()} == {20, 30, 40}
    assert {tuple(r) for r in minhash.clean_star_pairs(bounded, 0.8).collect()} == {(20, 30), (20, 40)}
    assert {tuple(r) for r in minhash.cross_pairs(bounded, 0.8).collect()} == {(20, 30), (20, 40), (30, 40)}
    one = spark.createDataFrame([(20, 20), (30, 20), (40, 20)], "node long, comp long")
    assert minhash.cross_pairs(minhash.relabelled(bounded, one), 0.8).count() == 0


def test_rare_pairs_are_those_that_share_a_short_list(spark):
    rows = [(1, 10, 64, 2), (1, 20, 64, 2), (2, 10, 64, 3), (2, 30, 64, 3), (2, 20, 64, 3), (3, 40, 64, 1)]
    found = spark.createDataFrame(rows, "h long, doc long, w int, n long")
    assert sorted(map(tuple, minhash.rare_pairs(found).collect())) == [(10, 20), (10, 30), (20, 30)]
    assert {r.o: r.own for r in minhash.rare_weights(found).collect()} == {10: 2.0, 20: 2.0, 30: 1.0, 40: 1.0}
    members = spark.createDataFrame([(5, x, 100.0 if x < 30 else 70.0, x) for x in (10, 20, 30)], "key long, rep long, weight double, comp long")
    none = spark.createDataFrame([], "node long, comp long")
    pairs = minhash.rare_pairs(found)
    assert [tuple(r) for r in minhash.across_classes(pairs, members, none, 0.8).collect()] == [(10, 20)]  # 30 is too light
    assert minhash.across_classes(pairs, members, spark.createDataFrame([(20, 10), (10, 10)], none.schema), 0.8).count() == 0


def test_bound_is_never_too_low():
    """Of texts that share no rare shingle: rare ones are on one side only."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        h = np.arange(40, dtype=np.uint64)
        a, b = rng.random(40) < 0.8, rng.random(40) < 0.8
        w = rng.uniform(0.8, 3, 40)
        j = minhash.weighted_jaccard(h[a], w[a], h[b], w[b])
        wa, wb, ua, ub = w[a].sum(), w[b].sum(), w[a & ~b].sum(), w[b & ~a].sum()
        assert j <= min(wa - ua, wb - ub) / max(wa + ub, wb + ua) + 1e-12


# ------------------------------------------------------------------ sharding


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs).collect()
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    slots = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty).count() == 0


def test_shares_follow_weights(spark):
    df = spark.range(40000).select(F.col("id").alias("doc_id"))
    w = {0: 4.0, 5: 0.0}
    n = {r.s: r["count"] for r in df.select(sharding.shard_of(F.col("doc_id"), sharding.tree_for(16, weights=w)).alias("s")).groupBy("s").count().collect()}
    assert 5 not in n and abs(n[0] / 40000 - 4 / 18) < 0.01 and abs(n[1] / 40000 - 1 / 18) < 0.008


def test_movement_is_confined(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"))
    a, b = sharding.tree_for(16), sharding.tree_for(16, weights={2: 3.0})
    rows = df.select(sharding.shard_of(F.col("doc_id"), a).alias("a"), sharding.shard_of(F.col("doc_id"), b).alias("b")).where("a <> b").collect()
    assert rows and all(r.b < 8 for r in rows)  # only region 0 gains, and inside its other rack nothing moves
    assert all(r.b < 4 or r.a >= 8 for r in rows)


def test_weights_that_are_all_zero_raise():
    with pytest.raises(ValueError):
        sharding.tree_for(4, weights=dict.fromkeys(range(4), 0.0))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"))
    a, b = sharding.tree_for(16, base=16), sharding.tree_for(17, base=16)
    rows = df.select(sharding.shard_of(F.col("doc_id"), a).alias("a"), sharding.shard_of(F.col("doc_id"), b).alias("b")).where("a <> b").collect()
    assert all(r.b == 16 for r in rows) and abs(len(rows) / 20000 - 1 / 17) < 0.008
