"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_CONTROLS = r"'([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'"

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 5""",
    "op2_ngram_jaccard": f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, least(i + 2, len(w))), ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, l.b from reach join l on reach.b = l.a),
m as (select a, min(b) as component_id from reach group by 1),
k as (select doc_id, string_agg(s, chr(1) order by s) as k from s group by 1),
z as (select k, count(*) as class_size from k group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, coalesce(class_size, 1) as class_size from documents d join m on m.a = d.doc_id left join n on n.doc_id = d.doc_id left join k on k.doc_id = d.doc_id left join z on z.k = k.k""",
    "op3_chat": f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, 12 + length(role) + 1 + length(regexp_replace(text, {_CONTROLS})) + 11 as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars
from e group by 1""",
    "op6_remove_repeats": f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents),
x as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from w where len(w) >= 35)),
r as (select h from x group by 1 having count(*) > 1),
g as (select distinct doc_id, i + k as p from x semi join r using (h), range(0, 35) t(k)),
p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as t from p anti join g using (doc_id, p) group by 1),
gone as (select doc_id, count(*) as n from g group by 1)
select w.doc_id, cast(len(w) as bigint) as n_words, coalesce(gone.n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id) left join gone using (doc_id)""",
    "op10_warc": """
with p as (select page_id, coalesce(html, '') as html from pages), d as (select page_id, strlen(html) as n, sha256(html) as h from p),
f as (select h, min(page_id) as first from d where n >= 100 group by 1 having count(*) > 1)
select page_id, cast(n as bigint) as payload_bytes, d.h as payload_digest, case when first is not null and first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to
from d left join f on d.h = f.h""",
}
