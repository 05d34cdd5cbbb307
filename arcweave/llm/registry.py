"""Registered queries of the text operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import license_scan, packing
from arcweave.llm.chat_format import digest_chat, format_chat, text_part
from arcweave.llm.draws import RANGES, SPAN, crc32_sql, draw_sql
from arcweave.llm.license_scan import scan_licenses
from arcweave.llm.minhash import near_duplicate_classes
from arcweave.llm.mixing import BLOCK, MAX_REPEAT, mix_report
from arcweave.llm.packing import pack
from arcweave.llm.quality_rules import COST, DELTA, GRIDS, RISK, judge
from arcweave.llm.sharding import assign_shards, tree_for
from arcweave.llm.simhash import simhash_report
from arcweave.llm.substring_dedup import substring_dedup
from arcweave.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).withColumn("longest_span", F.coalesce(F.array_max(F.transform("spans", lambda x: x["end"] - x["start"])), F.lit(0)).cast("long")).drop("spans")


ORACLES["op1_substring_dedup"] = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, s, array_to_string(ws[s:s + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as s from t)),
seen as (select k, min(doc_id) as lo from win group by k),
gone as (select distinct doc_id, unnest(range(s, s + 13)) as p from win join seen using (k) where lo < doc_id),
span as (select doc_id, count(*) as n from (select doc_id, p - row_number() over (partition by doc_id order by p) as island from gone) group by doc_id, island),
repeats as (select doc_id, count(*) as n, max(n) as longest from span group by doc_id),
word as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as p from t),
kept as (select word.doc_id, string_agg(w, ' ' order by word.p) as x, count(*) as n from word anti join gone on gone.doc_id = word.doc_id and gone.p = word.p group by word.doc_id)
select t.doc_id, len(ws) as n_words, len(ws) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.x, '')) as kept_sha256,
       coalesce(repeats.n, 0) as n_spans, coalesce(repeats.longest, 0) as longest_span
from t left join kept on kept.doc_id = t.doc_id left join repeats on repeats.doc_id = t.doc_id
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _packing_sql() -> str:
    """The dynamic program layer by layer over all pairs of lengths; a prefix's cuts travel with its cost."""
    return rf"""
with recursive
t as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n, {draw_sql('doc_id', 'text')} as key from documents),
h as (select n as len, count(*) as c from t group by n),
v as (select row_number() over (order by len) as j, len, (sum(c) over (order by len))::bigint as cum, (sum(c * len) over (order by len))::bigint as mass from h),
dp as (
  select 1 as m, j, len * cum - mass as cost, [len] as cuts from v
  union all
  select m + 1, j, step // (select count(*) + 1 from v), list_append(cuts, len) from (
    select dp.m, v.j, v.len, min((dp.cost + v.len * (v.cum - p.cum) - (v.mass - p.mass)) * (select count(*) + 1 from v) + dp.j) as step,
           arg_min(dp.cuts, (dp.cost + v.len * (v.cum - p.cum) - (v.mass - p.mass)) * (select count(*) + 1 from v) + dp.j) as cuts
    from dp join v p on p.j = dp.j join v on v.j > dp.j where dp.m < {packing.BUCKETS} group by dp.m, v.j, v.len)),
best as (select cuts from dp where m = (select least({packing.BUCKETS}, count(*)) from v) and j = (select count(*) from v)),
placed as (select t.*, len(list_filter(cuts, lambda u: u < n)) as bucket, cuts from t, best),
ranked as (select *, cuts[bucket + 1] as size, row_number() over (partition by bucket order by key, doc_id nulls first) - 1 as rank from placed)
select doc_id, n as n_tokens, cast(bucket as integer) as bucket, cast(size as bigint) as bucket_len, size - n as padding,
       rank // greatest(1, {packing.BUDGET} // greatest(size, 1)) as batch, rank % greatest(1, {packing.BUDGET} // greatest(size, 1)) as batch_slot
from ranked
"""


ORACLES["op4_packing"] = _packing_sql()


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = rows.unionByName(more).withColumn("parts", text_part(F.col("text")))
    return digest_chat(format_chat(turns))


ORACLES["op5_chat_format"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') as et,
         replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') as er
  from t
)
select conv_id,
       count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(er) + length(et) + 14) as bigint) as formatted_chars,
       cast(0 as bigint) as n_attachments,
       cast(0 as bigint) as placeholder_tokens
from e group by conv_id
"""


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


def _mixing_sql() -> str:
    """The exponent in closed form, the partial pass by a running total over all documents of a source."""
    source = "case when source is null then 'n' else 's' || source end"
    return rf"""
with t as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n,
                  {draw_sql("'key'", 'doc_id', 'case when doc_id is null then text end')} as key from documents),
s as (select source, sum(n)::bigint as tokens, count(*) as docs from t group by source),
e as (select ln(max(tokens) / min(tokens)) as spread, sum(tokens) as total from s where tokens > 0),
a as (select case when spread <= ln({MAX_REPEAT}) then 0.0::double else 1 - ln({MAX_REPEAT}) / spread end as a, total from e),
z as (select sum(pow(tokens / total, a)) as z from s, a where tokens > 0),
w as (select s.*, case when tokens > 0 then pow(tokens / total, a) / z else 0.0::double end as weight from s, a, z),
q as (select *, weight * (select max(tokens / weight) from w where tokens > 0) as quota from w),
c as (select *, case when tokens > 0 then floor(quota / tokens + 1e-9)::bigint else 1 end as epochs from q),
r as (select *, case when tokens > 0 then greatest(0, floor(quota - epochs * tokens + 1e-6))::bigint else 0 end as rest, ((docs + {BLOCK - 1}) // {BLOCK})::bigint as blocks from c),
b as (select t.*, r.weight, r.epochs, r.rest, t.key % r.blocks as block from t join r on r.source is not distinct from t.source),
o as (select *, {draw_sql("'order'", source, 'block', 'epochs')} as bo, {draw_sql("'doc'", 'key', 'epochs')} as d from b),
u as (select *, sum(n) over (partition by source order by bo, block, d) as upto from o)
select doc_id, source, n as n_tokens, epochs + case when rest > 0 and upto <= rest then 1 else 0 end as copies, round(weight, 9) as weight, block,
       {draw_sql("'order'", source, 'block', '0')} as block_order, {draw_sql("'doc'", 'key', '0')} as doc_order
from u
"""


ORACLES["op8_mixing"] = _mixing_sql()


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def _sharding_sql() -> str:
    """The trees as rows (tree, parent, node); a row takes its least draw level by level."""
    nodes = []
    for tree in (16, 17):
        stack = [tree_for(tree, base=16)]
        while stack:
            parent = stack.pop()
            nodes += [f"({tree}, {parent.key}, {i}, {c.key}, {c.weight}::double, {c.shard})" for i, c in enumerate(parent.children) if c.weight > 0]
            stack += parent.children
    remainders, crc = crc32_sql("coalesce(text, '')")
    level = lambda before, at: f"""
select x.rid, x.key, x.tree, arg_min(tree.node, -ln(({draw_sql('tree.node', 'x.key')} + 0.5) / {SPAN}) / tree.weight) as at, arg_min(tree.ord, -ln(({draw_sql('tree.node', 'x.key')} + 0.5) / {SPAN}) / tree.weight) as ord,
       arg_min(tree.shard, -ln(({draw_sql('tree.node', 'x.key')} + 0.5) / {SPAN}) / tree.weight) as shard
from {before} x join tree on tree.tree = x.tree and tree.parent = {at} group by x.rid, x.key, x.tree"""  # noqa: E731
    return rf"""
with tree(tree, parent, ord, node, weight, shard) as (values {", ".join(nodes)}),
c as (select row_number() over () as rid, doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, {crc} as crc from documents, {remainders}),
t as (select *, coalesce(doc_id, -1 - crc)::bigint as key from c),
pair as (select rid, key, tree from t, (values (16), (17)) v(tree)),
l1 as ({level('pair', '0')}),
l2 as ({level('l1', 'x.at')}),
l3 as ({level('l2', 'x.at')}),
s as (select rid, max(shard) filter (where tree = 16) as shard, max(shard) filter (where tree = 17) as grown from l3 group by rid)
select doc_id, cast(size as bigint) as size, crc as text_crc32, 'key' as law, cast(s.shard as integer) as shard,
       row_number() over (partition by s.shard order by {draw_sql("'slot'", 't.key')} // {int(SPAN) // RANGES}, doc_id nulls first, crc) - 1 as slot,
       cast(s.grown as integer) as grown_shard, cast(l1.ord as integer) as region, cast(l2.ord as integer) as rack
from t join s on s.rid = t.rid join l1 on l1.rid = t.rid and l1.tree = 16 join l2 on l2.rid = t.rid and l2.tree = 16
"""


ORACLES["op10_sharding"] = _sharding_sql()


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _quality_sql() -> str:
    grid = ", ".join(f"('{r}', {i}, cast({c!r} as double))" for r, cuts in GRIDS.items() for i, c in enumerate(cuts))
    score = lambda a, b: f"case when {b} > 0 then cast({a} as double) / {b} else cast(0 as double) end"
    return rf"""
with t as (
  select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
win as (select rid, s, array_to_string(ws[s:s + 7], ' ') as k from (select rid, ws, unnest(range(1, len(ws) - 6)) as s from t)),
twice as (select rid, k from win group by rid, k having count(*) > 1),
rep as (select rid, count(distinct p) as n from (select win.rid, unnest(range(s, s + 8)) as p from win join twice on twice.rid = win.rid and twice.k = win.k) group by rid),
f as (
  select t.rid, doc_id, lang, len(ws) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, len(ls) as n_lines,
         coalesce(rep.n, 0) as n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) as caps, length(regexp_replace(text, '[^!?]', '', 'g')) as marks
  from t left join rep on rep.rid = t.rid),
b as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {score('n_symbols', 'word_chars')} as symbols, {score('caps', 'word_chars')} as capitals,
         {score('n_dup_lines', 'n_lines')} as dup_lines, {score('n_repeat_words', 'n_words')} as repeats, {score('marks', 'n_words')} as exclaims from f),
grid(rule, i, cutoff) as (values {grid}),
scores as (
  select rid, lang, rule, value from (select rid, lang, unnest(['symbols', 'capitals', 'dup_lines', 'repeats', 'exclaims']) as rule, unnest([symbols, capitals, dup_lines, repeats, exclaims]) as value from b)),
held as (select b.rid, b.lang, l.quality = 1 as good from b join labels l on l.doc_id = b.doc_id where not base_failed and l.quality in (0, 1)),
c as (
  select h.lang, g.rule, g.i, g.cutoff, count(*) filter (where good) as n, count(*) filter (where good and s.value > g.cutoff) as k, count(*) filter (where not good and s.value > g.cutoff) as kb
  from held h join scores s on s.rid = h.rid join grid g on g.rule = s.rule group by 1, 2, 3, 4),
tail as (
  select c.lang, c.rule, c.i, c.cutoff, c.kb - {COST} * c.k as gain,
         (select sum(exp(lgamma(c.n + 1) - lgamma(j + 1) - lgamma(c.n - j + 1) + j * ln({RISK}) + (c.n - j) * ln(1 - {RISK}))) from (select unnest(range(0, c.k + 1)) as j)) as p
  from c where c.k < c.n * {RISK} and c.kb > 0),
best as (
  select lang, rule, cutoff from tail
  where p <= {DELTA} / ((select count(distinct coalesce(lang, '?')) from held) * {len(GRIDS)}) and gain > 0
  qualify row_number() over (partition by lang, rule order by gain desc, cutoff desc) = 1),
over as (select s.rid, count(*) as n from scores s join best on best.rule = s.rule and best.lang is not distinct from s.lang where s.value > best.cutoff group by s.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(over.n, 0) = 0 as kept, cast(coalesce(over.n, 0) as integer) as rules_exceeded
from b left join over on over.rid = b.rid
"""


ORACLES["op3_quality_rules"] = _quality_sql()


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """The scan on words themselves: no hashes."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    grams = []
    for t, (label, text) in enumerate(license_scan.TEMPLATES):
        w = license_scan.template_words(text)
        grams += [f"({t}, {quoted(label)}, {len(w)}, {i}, {quoted(' '.join(w[i : i + license_scan.K]))})" for i in range(len(w) - license_scan.K + 1)]
    phrases = ", ".join(f"({quoted(p)}, {quoted(lab)}, {len(p.split())})" for p, lab in license_scan.PHRASES.items())
    k = license_scan.K
    return rf"""
with t as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
tpl(template, label, t_len, t_pos, g) as (values {", ".join(grams)}),
phrase(p, label, n) as (values {phrases}),
w as (select rid, ws, unnest(range(0, len(ws))) as pos from t),
base as (select w.rid, w.pos, phrase.label from w, phrase where array_to_string(ws[pos + 1:pos + phrase.n], ' ') = phrase.p),
b as (select rid, count(*) as n, min(pos) as lo, max(pos) as hi, list(distinct label) as labels from base group by rid),
hit as (select w.rid, template, label, t_len, pos, t_pos from w join tpl on array_to_string(ws[pos + 1:pos + {k}], ' ') = tpl.g),
vote as (select distinct rid, template, pos - t_pos as diag from hit),
fresh as (select *, case when diag - lag(diag) over (partition by rid, template order by diag) <= {license_scan.MERGE} then 0 else 1 end as new from vote),
run as (select rid, template, diag, sum(new) over (partition by rid, template order by diag) as run from fresh),
place as (select distinct h.rid, h.template, h.label, h.t_len, run.run, h.t_pos + j as p from hit h join run on run.rid = h.rid and run.template = h.template and run.diag = h.pos - h.t_pos, (select unnest(range(0, {k})) as j)),
span as (select rid, label, count(*) / t_len as score from place group by rid, template, label, t_len, run having count(*) / t_len >= {license_scan.COVER}),
found as (select rid, list(distinct label) as more, max(score) as best, count(*) as n from span group by rid)
select doc_id, len(ws) as n_words, coalesce(b.n, 0) as n_base, b.lo as first_word, b.hi as last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(found.more, [])))), ','), '') as labels,
       cast(least(1.0, coalesce(found.best, case when b.n > 0 then {license_scan.COVER} else 0 end)) as double) as score, coalesce(found.n, 0) as n_spans
from t left join b on b.rid = t.rid left join found on found.rid = t.rid
"""


ORACLES["op6_license_scan"] = _license_sql()


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
