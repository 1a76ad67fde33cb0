"""DuckDB SQL for the operators that SQL can express over whole tables: exact near-dedup classes and exact window repeats."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

NEAR_DEDUP = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as ws from documents),
s as (
  select distinct doc_id, sh from (
    select doc_id, ws[i] || ' ' || ws[i + 1] as sh from w, unnest(range(1, len(ws))) as t(i)
    union all select doc_id, ws[1] from w where len(ws) = 1)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
edges as (select x, y from links union all select y, x from links),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, e.y from reach r join edges e on r.b = e.x)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.b) as component_id, min(r.b) = d.doc_id as kept
from documents d join reach r on r.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id"""

SUBSTRINGS = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
win as (select doc_id, i as s, array_to_string(ws[i : i + 19], ' ') as k from w, unnest(range(1, len(ws) - 18)) as t(i)),
again as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as r from win) x where r > 1),
gone as (select distinct doc_id, s + o as pos from again, range(0, 20) as t(o)),
words as (select doc_id, i as pos, ws[i] as word from w, unnest(range(1, len(ws) + 1)) as t(i)),
kept as (select a.doc_id, string_agg(a.word, ' ' order by a.pos) as body from words a left join gone g on g.doc_id = a.doc_id and g.pos = a.pos where g.pos is null group by a.doc_id),
lost as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, cast(len(w.ws) as bigint) as n_words, coalesce(lost.n, 0) as n_removed, sha256(coalesce(kept.body, '')) as kept_sha256
from w left join lost on lost.doc_id = w.doc_id left join kept on kept.doc_id = w.doc_id"""
