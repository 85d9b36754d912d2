"""DuckDB statements of the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents
), sets as (
  select distinct doc_id, case when len(words) < 5 then array_to_string(words, ' ') else array_to_string(words[i:i + 4], ' ') end as s
  from w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as t(i) where len(words) > 0
), n as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as i
  from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y
  where 100 * i >= 75 * (nx.n + ny.n - i)
), both_ways as (select x, y from links union all select y, x from links),
reach(doc_id, r) as (
  select doc_id, doc_id from documents
  union
  select b.y, reach.r from reach join both_ways b on b.x = reach.doc_id
), component as (select doc_id, min(r) as component_id from reach group by doc_id)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, c.doc_id = component_id as kept
from component c left join n using (doc_id)
"""

OP3 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as r, vec_id, score from scored
)
select query_id, r::int as rank, vec_id, score from ranked where r <= 20
"""

OP8 = rf"""
with w as (
  select doc_id, {WORDS} as words from documents
), windows as (
  select doc_id, i, array_to_string(words[i:i + 19], ' ') as s
  from w, unnest(range(1, greatest(len(words) - 19, 0) + 1)) as t(i)
), firsts as (select s, min(struct_pack(d := doc_id, i := i)) as f from windows group by s having count(*) > 1),
gone as (
  select distinct doc_id, i + k as pos
  from (select doc_id, i from windows join firsts using (s) where doc_id <> f.d or i <> f.i), unnest(range(0, 20)) as t(k)
), removed as (select doc_id, list(pos) as removed from gone group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(len(removed), 0)::bigint as n_removed,
       sha256(array_to_string(case when removed is null then words
         else list_transform(list_filter(range(1, len(words) + 1), lambda k: not list_contains(removed, k)), lambda k: words[k]) end, ' ')) as kept_sha256
from w left join removed using (doc_id)
"""

OP10 = rf"""
with d as (
  select doc_id, source, len({WORDS})::bigint as size from documents
), by_source as (
  select source, sum(size)::bigint as source_size,
         (array[5.0, 2.0, 1.0])[1 + (row_number() over (order by source nulls last) - 1)::int % 3]::double as weight
  from d group by source
), level as (
  select *, 1.5::double * sum(source_size) over () as goal, 2.0::double * source_size as cap from by_source
), filled as (
  select *,
    coalesce(sum(cap) over w_before, 0)::double as capped,
    sum(weight) over w_from as left_weight
  from level
  window w_before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding),
         w_from as (order by cap / weight, source nulls last rows between current row and unbounded following)
), stop as (
  select max(goal) as goal, min(case when (goal - capped) / left_weight * weight <= cap then struct_pack(o := cap / weight, c := capped, w := left_weight) end) as knee from filled
), targets as (
  select f.source, f.source_size, case when knee is null then f.cap else least(f.cap, (stop.goal - knee.c) / knee.w * f.weight) end as target
  from filled f, stop
), taken as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as whole,
    sum(d.size) over (partition by d.source order by md5('mix:' || d.doc_id), d.size rows between unbounded preceding and current row) - d.size / 2.0::double as middle
  from d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (size * (whole + case when middle < target - whole * source_size then 1 else 0 end))::bigint as taken
from taken
"""
