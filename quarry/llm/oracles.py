"""The training-data queries in DuckDB's SQL, where SQL can express them.

Not expressible: zstandard dictionaries (op1), the order of a 64-bit hash (op3), the scored spans of op4 with their look-behind patterns, packing (op9) and
XXH64 (op10); these are tested against brute force.
"""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
NUMBERED = "docs as (select *, row_number() over () as row from documents)"

OP2 = rf"""with {NUMBERED}, w as (select row, doc_id, {WORDS} as ws from docs),
win as (select row, unnest(range(1, len(ws) - 33)) as s, ws from w where len(ws) >= 35),
h as (select row, s, array_to_string(ws[s:s + 34], ' ') as k from win),
again as (select row, s from h where k in (select k from h group by k having count(*) > 1)),
gone as (select distinct row, unnest(range(s, s + 35)) as p from again),
lists as (select row, list(p) as ps from gone group by row)
select doc_id, len(ws)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
 sha256(array_to_string(case when ps is null then ws else list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(ps, i)), lambda i: ws[i]) end, ' ')) as kept_sha256 from w left join lists using (row)"""

OP5 = """with recursive ok as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as i, b.vec_id as j from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98::double),
reach(i, j) as (select vec_id, vec_id from embeddings union select r.i, l.j from reach r join links l on l.i = r.j),
n as (select i, count(*) as n from links group by 1), c as (select i, min(j) as c from reach group by 1)
select vec_id, coalesce(n.n, 0)::bigint as n_links, c.c as component_id, vec_id = c.c as kept from embeddings v left join n on n.i = v.vec_id join c on c.i = v.vec_id"""

OP6 = rf"""with {NUMBERED}, b as (select row, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from docs),
win as (select row, doc_id, s, substr(h, 2 * s + 1, 100) as k from (select row, doc_id, h, unnest(range(0, n - 49)) as s from b where n >= 50)),
least_ as (select k, min(coalesce(doc_id, 9223372036854775807)) as d from win group by k),
again as (select row, s from win join least_ using (k) where coalesce(doc_id, 9223372036854775807) > d),
marks as (select row, s, max(s + 50) over (partition by row order by s rows between unbounded preceding and 1 preceding) as upto from again),
runs as (select row, s, sum(case when upto is null or s > upto then 1 else 0 end) over (partition by row order by s) as run from marks),
spans as (select row, run, min(s) as b, max(s) + 50 as e from runs group by row, run),
gaps as (select row, b, e, lag(e, 1, 0) over (partition by row order by b) as before from spans),
kept as (select row, count(*)::bigint as n_spans, sum(e - b)::bigint as n_removed, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' order by b) || substr(any_value(h), 2 * max(e) + 1) as k from (select gaps.row, gaps.b, gaps.e, before, h from gaps join b as t on gaps.row = t.row) group by row)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256 from b left join kept using (row)"""

TOKENS = r"list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end)"
OP7 = rf"""with {NUMBERED}, l as (select row, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from docs where text is not null),
t as (select row, text, line, place, {TOKENS} as ts from l),
f as (select *, (len(ts) || ' ' || array_to_string(ts[1:3], ' ')) as leaf from t where len(ts) >= 1),
p as (select leaf, ts, text, unnest(range(1, len(ts) + 1)) as pos from (select distinct leaf, ts, text from f)),
usual as (select leaf, pos, ts[pos] as token from p group by 1, 2, 3 having count(distinct text) >= 20 and token <> '<*>'),
g as (select x.leaf, x.ts, list(case when u.token is null then '<*>' else u.token end order by x.pos) as template, avg(case when u.token is not null then 1.0 when x.ts[x.pos] <> '<*>' then 0.0 end) as share,
 count(u.token) as same, count(*) filter (where x.ts[x.pos] = '<*>') as digits from (select distinct leaf, ts, pos from p) x left join usual u on u.leaf = x.leaf and u.pos = x.pos and u.token = x.ts[x.pos] group by x.leaf, x.ts),
found as (select template from g join (select distinct leaf, ts, text from f) using (leaf, ts) where share >= 0.6 and same >= digits group by template having count(distinct text) >= 20),
gone as (select row, place from f join g using (leaf, ts) where share >= 0.6 and same >= digits and template in (select template from found)),
kept as (select row, count(*) filter (where len(ts) > 0) as n_lines, count(g.place) as n_dropped, string_agg(case when g.place is null then line end, chr(10) order by t.place) as k from t left join gone g using (row, place) group by row)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, sha256(coalesce(k, '')) as kept_sha256 from docs left join kept using (row)"""


# the production thresholds and words, written out a second time, so that a change of the operator's tables doesn't change what they are held against
STOP_SQL = "'the', 'of', 'and', 'to', 'in', 'is', 'a', 'that', 'der', 'die', 'das', 'und', 'in', 'zu', 'le', 'la', 'les', 'de', 'et', 'que', 'un', 'el', 'los', 'y', 'en'"
RULES_SQL = """n_words >= 20 and n_words <= 200000
 and (case when n_words > 0 then word_chars::double / n_words else 0 end) between 2.0::double and 14.0::double
 and (case when n_words > 0 then n_symbols::double / n_words else 0 end) <= 0.5::double
 and (case when n_lines > 0 then n_dup_lines::double / n_lines else 0 end) <= 0.3::double
 and (case when n_words > 0 then n_repeat_words::double / n_words else 0 end) <= 0.3::double
 and (case when n_words > 0 then n_stop_words::double / n_words else 0 end) >= 0.01::double"""

OP8 = rf"""with {NUMBERED}, w as (select row, doc_id, coalesce(text, '') as text, {WORDS} as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from docs),
h as (select row, s, array_to_string(ws[s:s + 7], ' ') as k from (select row, ws, unnest(range(1, len(ws) - 6)) as s from w where len(ws) >= 8)),
again as (select row, s from (select row, s, count(*) over (partition by row, k) as c from h) where c > 1),
rep as (select row, count(distinct p)::bigint as n from (select row, unnest(range(s, s + 8)) as p from again) group by row),
m as (select row, doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
 len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(list_filter(ws, lambda x: lower(x) in ({STOP_SQL})))::bigint as n_stop_words from w left join rep using (row))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
 not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and {RULES_SQL} as kept from m"""

ORACLE_SQL = {"op2_fmindex": OP2, "op5_embedding": OP5, "op6_suffix": OP6, "op7_lines": OP7, "op8_quality": OP8}
