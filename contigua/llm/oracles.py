"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from contigua.llm.quality import RULES, STOP_WORDS, SYMBOLS

SQL: dict[str, str] = {}


def _rules() -> str:
    ratio = {
        "n_words": "n_words",
        "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
        "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    }
    return " and ".join(f"({ratio[n]}) {op} {b}" for n, low, high in RULES for op, b in ((">=", low), ("<=", high)) if b is not None)


SQL["op2_quality_rules"] = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from
      (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from d)),
t as (select doc_id, i, row(word, lead(word) over p, lead(word, 2) over p) as k, lead(word, 2) over p is not null as full_window
      from w window p as (partition by doc_id order by i)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from t where full_window) where n > 1),
rep as (select doc_id, count(distinct i + o) as n_repeat_words from dup, (select unnest([0, 1, 2]) as o) group by doc_id),
wc as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars,
       count(*) filter (lower(word) in ({", ".join(repr(x) for x in dict.fromkeys(STOP_WORDS))})) as n_stop_words from w group by doc_id),
ln as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from
       (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
m as (select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
      (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::bigint as n_symbols,
      coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
      coalesce(n_stop_words, 0)::bigint as n_stop_words, coalesce(n_lines, 0)::bigint as n_lines
      from d left join wc using (doc_id) left join rep using (doc_id) left join ln using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and ({_rules()}) as kept, n_stop_words, n_lines from f
"""

_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op9_decontamination"] = f"""
with b as (select cast(item_id as varchar) as item, {_WORDS.format(t="text")} as ws from benchmark where text is not null),
bw as (select distinct item, list_aggregate(ws[i : i + least(13, len(ws)) - 1], 'string_agg', ' ') as win, least(13, len(ws)) as m
       from (select item, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) as i from b where len(ws) > 0)),
d as (select doc_id, {_WORDS.format(t="coalesce(text, '')")} as ws from documents),
sizes as (select distinct m from bw),
dw as (select doc_id, m, i, list_aggregate(ws[i : i + m - 1], 'string_agg', ' ') as win
       from (select doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) as i from d, sizes where len(ws) >= m)),
h as (select doc_id, dw.m, i, item from dw join bw on dw.m = bw.m and dw.win = bw.win),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + m - 1)) as p from (select distinct doc_id, m, i from h)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as said from (select distinct doc_id, item from h where item is not null) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(said, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

SQL["op11_filter_audit"] = r"""
with l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by doc_id),
t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
d as materialized (select part, len(ws) < 100 as a, 100 * len(list_distinct(ws)) < 80 * len(ws) as b,
      100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
      coalesce(doc_id > min(doc_id) over (partition by text), false) as e, coalesce(good, false) as good, coalesce(toxic, false) as toxic
      from t left join l using (doc_id)),
cells as materialized (select part, [x for x in [case when a then 'A' end, case when b then 'B' end, case when c then 'C' end, case when d then 'D' end, case when e then 'E' end] if x is not null] as fails,
          count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from d group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from f a, f b, f c, f d, f e
           where b.x <> a.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)),
steps as (select filter_order, s as step, filter_order[s] as own, string_split(filter_order[1:s - 1], '') as before from orders, (select unnest([1, 2, 3, 4, 5]) as s)),
r as (select part, filter_order, step, own,
      sum(n) filter (not list_has_any(fails, before) and not list_contains(fails, own)) as kept,
      sum(n) filter (not list_has_any(fails, before) and list_contains(fails, own)) as removed,
      sum(n) filter (list_has_any(fails, before) and list_contains(fails, own)) as redundant,
      sum(n) filter (fails = [own]) as unique_fails,
      sum(good) filter (not list_has_any(fails, before) and list_contains(fails, own)) as good_lost,
      sum(toxic) filter (not list_has_any(fails, before) and list_contains(fails, own)) as toxic_lost
      from steps, cells group by all),
z as (select part, filter_order, step, own, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
      coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost from r)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from z
"""

SQL["op13_spelling_variants"] = r"""
with recursive tab as materialized (select list(x order by b) as tab from
      (select b, list_reduce(list_prepend(b, range(8)), lambda a, i: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) as x from (select unnest(range(256)) as b))),
r as materialized (select id, run, count(*) as c from (select coalesce(doc_id::varchar, '') as id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents) group by all),
x as (select *, hex(encode(id || ':' || run)) as hx from r),
y as (select id, run, c, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(hx) // 2),
      lambda i: 16 * (instr('0123456789ABCDEF', hx[2 * i + 1]) - 1) + instr('0123456789ABCDEF', hx[2 * i + 2]) - 1)),
      lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])) as z from x, tab),
h as (select run, c, xor(z, 4294967295) as h from y),
w as materialized (select word, sum(c)::bigint as n from (select c, case when h % 199 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word from h)
      where length(word) >= 6 group by word having sum(c) >= 5),
dels as materialized (select word, i, word[1:i - 1] || word[i + 1:] as rest from (select word, unnest(range(1, length(word) + 1)) as i from w)),
near as materialized (select distinct a.word, b.word as other from dels a join dels b on a.i = b.i and a.rest = b.rest and a.word <> b.word
      union select d.word, w.word from dels d join w on d.rest = w.word union select w.word, d.word from dels d join w on d.rest = w.word),
best as (select word, count(*) as n_near, arg_min(other, row(-n, other)) as other, max(n) as form_n from (select near.word, other, n from near join w on w.word = other) group by word),
f as materialized (select word, case when form_n >= 5 * n then other end as form, n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 5 * n then form_n end as form_n from w left join best using (word)),
walk as (select word, word as here, 0 as hop from f union all select walk.word, f.form, hop + 1 from walk join f on f.word = walk.here where f.form is not null)
select word, form, root, n, n_near, form_n from f join (select word, arg_max(here, hop) as root from walk group by word) using (word)
"""

SQL["op12_embedding_near_dedup"] = """
with recursive v as materialized (select row_number() over () as i, vec_id, label, embedding::double[] as e from embeddings),
good as materialized (select i, vec_id, label, list_transform(e, lambda x: x / m) as e from (select *, list_max(list_transform(e, lambda x: abs(x))) as m from v
      where label is not null and len(e) > 0 and not list_contains(list_transform(e, lambda x: x is null or not isfinite(x)), true)) where m > 0),
unit as materialized (select i, vec_id, label, list_transform(e, lambda x: x / n) as e from (select *, sqrt(list_dot_product(e, e)) as n from good)),
pairs as materialized (select a.i as a, b.i as b, b.vec_id from unit a join unit b on a.label = b.label and len(a.e) = len(b.e) and a.i <> b.i and list_dot_product(a.e, b.e) >= 0.98),
reach as (select i as a, i as b from v union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a),
low as (select a, min(vec_id) as component_id from reach join v on v.i = reach.b group by a),
n as (select a, count(*) as n_links from pairs group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept from v join low on low.a = v.i left join n on n.a = v.i
"""
