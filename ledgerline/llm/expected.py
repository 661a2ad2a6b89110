"""The expected results of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

OP2 = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as h
  from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (
  select source, source_size,
    [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 as integer) + 1] as w from totals),
levels as (
  select *, row_number() over first_capped as place,
    cast(3 * sum(source_size) over () - 4 * coalesce(sum(source_size) over (first_capped rows between unbounded preceding
      and 1 preceding), 0) as double)
    / cast(2 * sum(w) over (first_capped rows between current row and unbounded following) as double) as level
  from ranked window first_capped as (order by source_size / w, source nulls last)),
filled as (select *, (select arg_min(level, place) from levels where level * w <= 2 * source_size) as fill from levels),
aimed as (
  select source, source_size, w,
    case when fill is null then cast(2 * source_size as double)
      else least(cast(2 * source_size as double), fill * w) end as target from filled),
budgets as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from aimed),
lefts as (select *, cast(floor(target - whole * source_size) as bigint) as rest from budgets),
hashes as (select source, h, sum(size) as size from sized group by source, h),
running as (select *, sum(size) over (partition by source order by h) as upto from hashes),
crossing as (
  select r.source, min(r.h - case when 2 * (l.rest - r.upto + r.size) >= r.size then 0 else 1 end) as last_hash
  from running r join lefts l on r.source is not distinct from l.source
  where l.rest > 0 and r.upto >= l.rest and r.upto - r.size < l.rest group by r.source)
select s.doc_id, cast(s.size as bigint) as size, l.source_size, l.target,
  cast(s.size * (l.whole + case when s.h <= coalesce(c.last_hash, -1) then 1 else 0 end) as bigint) as taken
from sized s join lefts l on s.source is not distinct from l.source
left join crossing c on c.source is not distinct from l.source
"""

OP4 = r"""
with recursive split as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, md5(array_to_string(w[i : i + 4], ' ')) as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from split where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reached as (
  select a as doc_id, b as other from both_ways
  union
  select r.doc_id, e.b from reached r join both_ways e on e.a = r.other),
smallest as (select doc_id, min(other) as low from reached group by doc_id)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) as component_id,
  d.doc_id <= coalesce(m.low, d.doc_id) as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join smallest m on m.doc_id = d.doc_id
"""

OP9 = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
  from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (
  select key, min(doc_id) as first_id from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (select k.*, coalesce(k.doc_id <> s.first_id, false) as gone from keyed k left join shared s on s.key = k.key)
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

OP11 = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
found as (
  select d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from found group by lang, term having count(distinct d) >= 3),
groups as (select distinct lang, source from docs),
counted as (select lang, source, term, count(*) as n from found group by all),
grid as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n
  from groups g join kept k using (lang) left join counted c using (lang, source, term)),
p_group as (
  select *, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over one + count(*) over one) as p
  from grid window one as (partition by lang, source)),
by_lang as (select lang, term, sum(n) as n from grid group by all),
p_lang as (
  select *, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over one + count(*) over one) as q
  from by_lang window one as (partition by lang)),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join p_group x on x.lang = a.lang and x.source = a.source
  left join p_group y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
terms as (
  select x.lang, x.source, x.term as item, (x.p - y.q) * (x.p - y.q) // y.q as value
  from p_group x join p_lang y using (lang, term) where x.n > 0 and x.p > y.q),
parts as (
  select lang, source, 'pair' as part, item, value from pairs union all
  select lang, source, 'term', item, value from terms)
select lang, source, part, item, cast(value as bigint) as value, cast(place as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as place from parts)
where part = 'pair' or place <= 200
"""


def _op13(rounds: int = 5, clusters: int = 40, seed: int = 2) -> str:
    nearest = """
  select vec_id, row, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from (
    select v.vec_id, v.row, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as distance
    from whole v, {} c) group by vec_id, row"""
    steps = []
    for i in range(rounds):
        steps.append(f"""near{i} as ({nearest.format(f'c{i}')}),
sums{i} as (
  select cluster, place, sum(x) as s, count(*) as n from (
    select cluster, unnest(x) as x, generate_subscripts(x, 1) as place from near{i} join whole using (row)) group by all),
c{i + 1} as (
  select c.cluster, coalesce(m.x, c.x) as x from c{i} c left join (
    select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by place) as x from sums{i} group by cluster) m
  using (cluster))""")
    return f"""
with whole as (
  select vec_id, row_number() over () as row, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as x
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
c0 as (
  select cast(row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as integer) as cluster, x from whole
  qualify row_number() over (order by sha256('{seed}:' || vec_id)) <= {clusters}),
{', '.join(steps)},
final as ({nearest.format(f'c{rounds}')})
select vec_id, cluster, cast(distance as bigint) as distance,
  cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256
from final join c{rounds} c using (cluster)
"""


EXPECTED = {
    "op2_mix_sources": OP2, "op4_near_duplicates": OP4, "op9_line_dedup": OP9, "op11_source_divergence": OP11,
    "op13_centroids": _op13(),
}
