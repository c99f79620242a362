"""DuckDB SQL for the corpus operators that SQL can express."""

from .reply_trees import DIGEST_SQL

_WORDS = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""

SUBSTRING_DEDUP = rf"""
with w as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos, len(ws) as n from (select doc_id, {_WORDS} as ws from documents)),
win as (select doc_id, pos, n, md5(string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and 19 following)) as h from w),
rep as (select doc_id, pos, rank() over (partition by h order by doc_id, pos) as nth from win where pos + 20 <= n),
edge as (select doc_id, pos, sum(d) as d from (select doc_id, pos, 1 as d from rep where nth > 1 union all select doc_id, pos + 20, -1 from rep where nth > 1) group by 1, 2),
flag as (select w.doc_id, w.pos, w.word, coalesce(sum(edge.d) over (partition by w.doc_id order by w.pos), 0) > 0 as gone from w left join edge on edge.doc_id = w.doc_id and edge.pos = w.pos),
got as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (where not gone), '') as kept from flag group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join got on got.doc_id = d.doc_id
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
k as (select *, max(page_id) over (partition by html) as best from p)
select page_id, cast(n as bigint) as payload_bytes, sha1(html) as payload_digest, case when n >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> best then best end as refers_to, true as intact from k
"""

JACCARD = rf"""
with recursive w as (select doc_id, {_WORDS} as ws from (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)),
s as (select distinct doc_id, s from (select doc_id, unnest(case when len(ws) < 3 then case when len(ws) = 0 then [] else [array_to_string(ws, ' ')] end
  else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as s from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
link as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2) join n p on p.doc_id = a join n q on q.doc_id = b where 100 * shared >= 90 * (p.n + q.n - shared)),
reach as (select doc_id, doc_id as node from documents union select reach.doc_id, link.b from reach join link on link.a = reach.node)
select reach.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(node) as component_id from reach left join n on n.doc_id = reach.doc_id group by reach.doc_id
"""

ORACLES = {"op1_substring_dedup": SUBSTRING_DEDUP, "op6_warc": WARC, "op7_reply_trees": DIGEST_SQL, "op10_jaccard_join": JACCARD}
