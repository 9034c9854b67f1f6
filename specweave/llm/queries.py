"""Registered queries of this package with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from specweave.llm import binary, bpe, chat, contamination, lines, lm, near, prefixes, quality, repair, rules, toxicity, wrapper
from specweave.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


@query("op2_bpe_trie")
def bpe_trie(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op5_winnowing",
    r"""
with w as (
  select doc_id, string_split(regexp_replace(trim(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' +', ' ', 'g'), ' ') ws from documents),
d as (select doc_id, case when ws = [''] then [] else ws end ws from w),
v as (
  select cast(item_id as varchar) item, string_split(trim(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') ws from benchmark),
b as (select item, ws, least(len(ws), 10) n from v where ws <> ['']),
win as (
  select distinct item, n, array_to_string(ws[i : i + n - 1], ' ') g
  from (select item, ws, n, unnest(range(1, len(ws) - n + 2)) i from b)),
sizes as (select distinct n from b),
dg as (
  select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') g
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from d, sizes where len(ws) >= n)),
hit as (select doc_id, dg.n, i, item from dg join win on dg.n = win.n and dg.g = win.g),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
items as (
  select doc_id, count(*) n_items, sha256(string_agg(item, ',' order by item)) items_sha256
  from (select distinct doc_id, item from hit) group by 1)
select d.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  coalesce(items_sha256, sha256('')) items_sha256, n_hit is not null contaminated
from d left join words using (doc_id) left join items using (doc_id)
""",
)
def winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op10_multi_index",
    r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ') g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i from w where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by 1),
links as (
  select a, b from (select x.doc_id a, y.doc_id b, count(*) m from s x join s y using (g) where x.doc_id <> y.doc_id group by all)
  join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * m >= 75 * (na.n + nb.n - m)),
reach(doc_id, r) as (
  select doc_id, doc_id from documents
  union
  select doc_id, links.b from reach join links on r = links.a),
low as (select doc_id, min(r) component_id from reach group by 1)
select doc_id, coalesce(n.n, 0) n_shingles, component_id, doc_id = component_id kept from low left join n using (doc_id)
""",
)
def multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


@query("op8_patience")
def patience(spark: SparkSession, folder: str) -> DataFrame:
    return lines.without_repeats(table(spark, folder, "documents"))


@query("op9_convolution")
def convolution(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_subword")
def subword(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_control_bytes")
def control_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return binary.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op1_perspectives",
    r"""
with c as (
  select distinct conv_id, turn, coalesce(nullif(regexp_replace(trim(role), '\s+', '_', 'g'), ''), 'unknown') speaker,
    replace(coalesce(text, ''), '<|', '< |') body from conversations),
s as (select distinct conv_id, speaker from c where speaker <> 'system'),
m as (
  select c.conv_id, s.speaker, turn, c.speaker said_by, body, c.speaker = s.speaker own,
    concat('<|im_start|>', case when c.speaker = 'system' then 'system' when c.speaker = s.speaker then 'assistant'
      else concat('user name=', c.speaker) end, chr(10)) head
  from c join s using (conv_id))
select conv_id, speaker, turn // 32 part, cast(0 as bigint) slot, count(*) n_messages, count(*) filter (own) n_own,
  string_agg(concat(head, body, '<|im_end|>', chr(10)), '' order by turn, said_by, body) "text",
  string_agg(concat(length(head), ':0,', length(body) + 11, case when own then ':1' else ':0' end), ','
    order by turn, said_by, body) mask
from m group by conv_id, speaker, turn // 32
""",
)
def perspectives(spark: SparkSession, folder: str) -> DataFrame:
    return chat.perspectives(table(spark, folder, "conversations"))


@query("op7_decision_list")
def decision_list(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return rules.judged(docs, rules.learned(docs, table(spark, folder, "labels")))


@query("op4_log_bilinear")
def log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"))


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1]))"
    last = "xor(c >> 1, 3988292384 * (c & 1))"
    step = f"case when e < 0 then {last} else xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)) end"
    return f"xor(list_reduce(list_prepend(4294967295, cast({bits} as bigint[])), lambda c, e: {step}), 4294967295)"


def _way(state: str, letter: str, cost: str, line: str = "''", when: str = "true") -> str:
    """A state's cost, audit and text after one more edit."""
    cost = f"{state}.c + case when {when} then {cost} else 1000000000 end"
    return f"{{'c': {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"


def _rows_after(states: str) -> str:
    """One row's edits on four states, between which up to two roles are inserted before it."""
    user, helper = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    kept, alive = "chr(10) || role || ':' || \"text\"", "fault not in ('blank', 'duplicate')"
    cut = "case when fault = 'truncated' then 1 else 0 end"
    to_user = [_way(f"j{q}", "R", f"2 + {cut}", f"{user} || \"text\"", alive) for q in (0, 1, 3)]
    to_user += [_way(f"j{q}", "K", cut, kept, f"{alive} and ini = 'u'") for q in (0, 1, 3)]
    to_helper = [_way("j2", "R", f"2 + {cut}", f"{helper} || \"text\"", alive), _way("j2", "K", cut, kept, f"{alive} and ini = 'a'")]
    after = [
        [_way("j0", "D", "3")],
        [_way("j1", "D", "3"), _way("j0", "K", cut, kept, f"{alive} and ini = 's'")],
        [_way("j2", "D", "3"), *to_user],
        [_way("j3", "D", "3"), *to_helper],
    ]
    inserted = ", ".join(_way(f"s{q}", "I", "2", user) for q in (0, 1, 3))
    return f"""
  select conv_id, k, {", ".join(f"list_min([{', '.join(ways)}]) s{q}" for q, ways in enumerate(after))}
  from (select conv_id, k, role, "text", ini, fault, j0, j1, j2, list_min([s3, {_way("j2", "I", "2", helper)}]) j3
    from (select {states}.conv_id, f.k, role, "text", ini, fault, s0 j0, s1 j1, list_min([s2, {inserted}]) j2, s3
      from {states} join f on {states}.conv_id is not distinct from f.conv_id and f.k = {states}.k + 1))"""


_REPAIRED = f"""
with recursive c as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce("text", ' ') "text",
    {_crc32("concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' '))")} % 20 roll
  from conversations),
d as (
  select conv_id, turn, case when roll = 4 then 'user' else role end role,
    case roll when 1 then '' when 2 then translate("text", '.!?', '') else "text" end "text",
    unnest(case when roll = 3 then [1, 2] else [1] end) from c where roll <> 0),
o as (
  select *, left(role, 1) ini, row_number() over (partition by conv_id order by turn nulls first, role, sha256("text")) k,
    rtrim("text", concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) bare from d),
f as (
  select *, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, "text" order by k) > 1 then 'duplicate'
    when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end fault,
    k > 1 and lag(ini) over (partition by conv_id order by k) || ini not in ('su', 'ua', 'au') illegal from o),
ways(conv_id, k, s0, s1, s2, s3) as (
  select distinct conv_id, cast(0 as bigint), {{'c': 0, 'a': '', 't': ''}},
    {", ".join("{'c': 1000000000, 'a': '', 't': ''}" for _ in range(3))} from f
  union all {_rows_after("ways")}),
best as (
  select conv_id, k, list_min([s0, s3, {_way("s2", "I", "2", "chr(10) || 'assistant:'")},
    {_way("s1", "II", "4", "chr(10) || 'user:' || chr(10) || 'assistant:'")}]) w from ways),
n as (
  select conv_id, max(k) k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank,
    count(*) filter (fault = 'duplicate') "duplicate", count(*) filter (fault = 'truncated') truncated,
    count(*) filter (illegal) illegal from f group by conv_id)
select i.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce("duplicate", 0) "duplicate",
  coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, cast(coalesce(w.c, 0) as bigint) "cost", coalesce(w.a, '') "audit",
  sha256(coalesce(w.t[2:], '')) repaired_sha256
from (select distinct conv_id from conversations) i
left join n on n.conv_id is not distinct from i.conv_id
left join best on best.conv_id is not distinct from n.conv_id and best.k = n.k
"""


@query("op12_hirschberg", _REPAIRED)
def hirschberg(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repaired_after_damage(table(spark, folder, "conversations"))


@query(
    "op13_count_min",
    f"""
with c as (
  select conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce("text", ''))
    order by turn nulls first, coalesce(role, ''), sha256(coalesce("text", ''))) own,
    {_crc32("cast(conv_id as varchar)")} % 6 h from conversations where conv_id is not null group by conv_id),
b as (
  select c.conv_id, list_concat(coalesce(base.own[1 : c.h], []), c.own[c.h + 1 :]) t
  from c left join c base on base.conv_id = c.conv_id - c.conv_id % 100),
p as (select conv_id, len(t) n, cast(d as bigint) d, t[1:d] k from (select conv_id, t, unnest(range(len(t) + 1)) d from b)),
v as (
  select k, d, min(conv_id) conv_id, count(*) n_convs,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = d), '')) ends_sha256
  from p group by k, d),
w as (select v.*, up.conv_id parent_conv_id from v left join v up on v.d > 0 and up.d = v.d - 1 and up.k = v.k[1 : v.d - 1]),
kids as (select k[1 : d - 1] k, count(*) n_children from v where d > 0 group by 1),
below as (
  select k[1:a] k, count(*) filter (n_children is null) n_leaves, sum(case when d > 0 then (n_convs - 1) * length(k[d].x) else 0 end) saved
  from (select v.*, n_children, unnest(range(d + 1)) a from v left join kids using (k)) group by 1)
select w.conv_id, d "depth", parent_conv_id, n_convs, coalesce(n_children, 0) n_children, n_leaves,
  cast(saved as bigint) saved_tokens, ends_sha256
from w left join kids using (k) join below using (k)
""",
)
def count_min(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(table(spark, folder, "conversations"))


@query("op11_wrapper")
def wrapped(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.main_text(table(spark, folder, "pages"))
