"""DuckDB twins of the queries that SQL can express; they share nothing with the operators."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = r"""
with recursive words as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') as w from documents
), same as (
  select min(r) over (partition by w) as node, * from words
), nodes as (
  select distinct on (node) node, w from same
), shingles as (
  select node, s, count(*) as c from (
    select node, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from nodes
  ) group by all
), sizes as (
  select node, sum(c) as n from shingles group by node
), links as (
  select a.node as a, b.node as b from shingles a join shingles b on a.s = b.s and a.node < b.node
  join sizes x on x.node = a.node join sizes y on y.node = b.node
  group by a.node, b.node, x.n, y.n
  having sum(least(a.c, b.c)) >= 0.8 * (x.n + y.n - sum(least(a.c, b.c)))
), edges as (
  select a, b from links union all select b, a from links
), reached as (
  select node, node as root from nodes
  union
  select e.b, r.root from reached r join edges e on e.a = r.node
), labels as (
  select node, min(root) as label from reached group by node
), placed as (
  select doc_id, label from same join labels using (node)
)
select doc_id, min(doc_id) over (partition by label) as class_id, count(*) over (partition by label) as class_size from placed
"""

DECONTAMINATION = rf"""
with docs as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select coalesce(cast(item_id as varchar), '') as item,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item, least(10, len(w)) as n,
    unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: array_to_string(w[i:i + 9], ' '))) as s from items where len(w) > 0
), places as (
  select r, n, unnest(range(1, greatest(1, len(w) - n + 2))) as i, w from docs, (select distinct n from windows)
), found as (
  select p.r, p.i, p.n, x.item from places p join windows x on x.n = p.n and x.s = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')
), hits as (
  select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from found) group by r
), hit_items as (
  select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from found group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (r) left join hit_items using (r)
"""

REVISITS = r"""
with base as (
  select page_id, url, md5(html) as digest, cast(length(html) as varchar) as size,
    1600000000 + (page_id * 7919) % 1000003 * 60 as "at", '"' || substr(md5(html), 1, 16) || '"' as tag from pages
), records as (
  select 'r' || page_id as record_id, url, "at", 'response' as kind, tag as etag, "at" - 3600 as modified, digest, size, 0 as k from base
  union all select 'v' || page_id || '-1', url || '#again', "at" + 86400, 'revisit', case when page_id % 4 = 0 then '"0"' else tag end, null, null, null, 1 from base
  union all select 'v' || page_id || '-2', url, "at" + 172800, 'revisit', null, "at" + 172800 - 176400 - case when page_id % 4 = 0 then 3600 else 0 end, null, null, 2 from base
  union all select 'v' || page_id || '-3', url, "at" - 86400, 'revisit', tag, null, null, null, 3 from base
), parts as (
  select * exclude (url), lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
    regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':(80|443)$', '') as host,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path,
    list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))) as query from records
), captures as (
  select * exclude (scheme, host, path, query),
    scheme || '://' || host || case when path = '' then '/' else path end || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end as url from parts
), full_responses as (
  select url, "at", max(record_id) as record_id, arg_max(etag, record_id) as etag, arg_max(modified, record_id) as modified,
    arg_max(digest, record_id) as digest, arg_max(size, record_id) as size from captures where kind = 'response' group by url, "at"
), matched as (
  select v.record_id, v.url, v."at", v.k, f.record_id as response_id, f.digest, f.size, f.etag,
    case when f.record_id is null then 'no_response' when coalesce(v.etag = f.etag, f.modified <= v.modified) then 'resolved' else 'validator_mismatch' end as status
  from (select * from captures where kind = 'revisit') v asof left join full_responses f on v.url = f.url and v."at" > f."at"
)
select record_id, url, "at", status, case when status = 'resolved' then response_id end as response_id, case when status = 'resolved' then digest end as digest,
  case when status = 'resolved' then concat('cache-control: max-age=', k * 100, chr(10), 'content-length: ', size, chr(10), 'content-type: text/html', chr(10),
    'date: ', "at", chr(10), 'etag: ', etag) end as headers
from matched
"""


FILTER_AUDIT = r"""
with words as (
  select doc_id, coalesce(cast(lang as varchar), '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by coalesce(text, '')) as first_id from documents
), failing as (
  select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(first_id < doc_id, false)] as fails from words
), flags as (
  select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id
), cases as (
  select part, fails, coalesce(good, 0) = 1 as good, coalesce(toxic, 0) = 1 as toxic, count(*) as n from failing left join flags using (doc_id) group by all
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
  select filter_order, cast(step as int) as step, substr(filter_order, step, 1) as name from orders, (select unnest(range(1, 6)) as step)
), outcomes as (
  select part, filter_order, step, name, n, good, toxic, fails[ascii(name) - 64] as fails_here, len(list_filter(fails, lambda f: f)) as n_fails,
    len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, i, 1)) - 64])) > 0 as gone from cases, steps
), counts as (
  select part, filter_order, step, name, sum(n) filter (not gone and not fails_here) as kept, sum(n) filter (not gone and fails_here) as removed,
    sum(n) filter (gone and fails_here) as redundant, sum(n) filter (fails_here and n_fails = 1) as unique_fails,
    sum(n) filter (not gone and fails_here and good) as good_lost, sum(n) filter (not gone and fails_here and toxic) as toxic_lost from outcomes group by all
)
select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
  cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost,
  cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(coalesce(sum(removed) over (partition by part, name), 0) as bigint) as shapley
from counts
"""

NEAREST = """
with good as (
  select vec_id, min(cast(embedding as double[])) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by vec_id
), pairs as (
  select q.vec_id as query_id, c.vec_id,
    sqrt(list_reduce(list_prepend(0.0, list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))), lambda x, y: x + y)) as score from good q join good c on len(q.v) = len(c.v) and q.vec_id <> c.vec_id
  where q.vec_id % 100 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as int) as "rank", vec_id, score from pairs qualify "rank" <= 10
"""

MANIFEST = r"""
with recursive docs as (
  select row_number() over () as r, coalesce('+' || cast(source as varchar), '') as tree, doc_id, text,
    concat(coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-'), coalesce(strlen(cast(source as varchar)) || ':' || source, '-'),
      coalesce(strlen(cast(lang as varchar)) || ':' || lang, '-'), coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-')) as head from documents
), bytes as (  -- the table of CRC-32, bit by bit
  select 0 as k, cast(b as bigint) as b, cast(b as bigint) as c from range(256) t(b)
  union all select k + 1, b, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bytes where k < 8
), crc_table as (
  select list(c order by b) as t from bytes where k = 8
), leaves as (
  select r, tree, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''), lambda x: cast(ascii(x) as bigint))),
      lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])) % 2 = 1 and contains(text, chr(10)) then replace(text, chr(10), '') else text end as changed, head
  from docs, crc_table
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as pos,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) as tampered from leaves
), nodes as (
  select 0 as level, tree, pos, leaf as h, count(*) over (partition by tree) as n from placed
  union all
  select level + 1, tree, pos // 3, sha256(string_agg(h, '' order by pos)), any_value((n + 2) // 3) from nodes where n > 1 group by level, tree, pos // 3
), subroots as (
  select tree, h as subroot, row_number() over (order by tree) - 1 as pos from nodes where n = 1
), tops as (
  select 0 as level, pos, subroot as h, count(*) over () as n from subroots
  union all
  select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), any_value((n + 2) // 3) from tops where n > 1 group by level, pos // 3
), steps as (
  select p.r, x.level, string_agg(x.h, '' order by x.pos) filter (x.pos < p.pos // pow3) as l, string_agg(x.h, '' order by x.pos) filter (x.pos > p.pos // pow3) as u
  from (select r, tree, pos, level, cast(pow(3, level) as bigint) as pow3 from placed join (select distinct tree, level from nodes where n > 1) using (tree)) p
  join nodes x on x.tree = p.tree and x.level = p.level and x.pos // 3 = p.pos // pow3 // 3 group by all
), top_steps as (
  select s.tree, 1000 + x.level as level, string_agg(x.h, '' order by x.pos) filter (x.pos < s.pos // pow3) as l,
    string_agg(x.h, '' order by x.pos) filter (x.pos > s.pos // pow3) as u
  from (select tree, pos, level, cast(pow(3, level) as bigint) as pow3 from subroots, (select distinct level from tops where n > 1)) s
  join tops x on x.level = s.level and x.pos // 3 = s.pos // pow3 // 3 group by all
), paths as (
  select r, list({'l': coalesce(l, ''), 'u': coalesce(u, '')} order by level) as path from (
    select r, level, l, u from steps union all select p.r, t.level, t.l, t.u from placed p join top_steps t using (tree)) group by r
), folds as (
  select r, 0 as k, tampered as h from placed
  union all
  select f.r, k + 1, sha256(path[k + 1].l || h || path[k + 1].u) from folds f join paths using (r) where k < len(path)
), folded as (
  select r, arg_max(h, k) as folded_root from folds group by r
)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda p: p.l || p.u), ''), '')) as proof_sha256, folded_root,
  folded_root = root as verified
from placed join subroots using (tree) left join paths using (r) join folded using (r), (select h as root from tops where n = 1)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_dart_minhash": NEAR_DUPLICATES, "op6_decontaminate": DECONTAMINATION, "op7_revisits": REVISITS,
            "op11_filter_audit": FILTER_AUDIT, "op12_one_bit_search": NEAREST, "op13_merkle_manifest": MANIFEST}
