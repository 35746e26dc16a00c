"""DuckDB statements for the operators that SQL can express, over whole tables and texts."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NIBBLES = "".join(f"{k:04b}" for k in range(16))
BASE32 = UPPER + "234567"


def warc_sql(pages: str = "pages") -> str:
    """Records by equal payloads; base32 of SHA-1 by way of its bits."""
    five = " + ".join(f"{1 << (4 - k)} * cast(substr(bits, 5 * i + {k + 1}, 1) as integer)" for k in range(5))
    return f"""
with p as (select page_id, coalesce(html, '') as html from {pages}),
h as (select page_id, html, list_aggregate(list_transform(string_split(sha1(html), ''), lambda c: substr('{NIBBLES}', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), 'string_agg', '') as bits from p),
m as (select *, min(page_id) over (partition by html) as first from h)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}', 1 + {five}, 1)), 'string_agg', '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from m"""


def decontam_sql(docs: str = "documents", window: int = 10) -> str:
    ws = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with b as (select item_id, {ws('text')} as w from benchmark),
bw as (select distinct item_id, n, list_slice(w, k, k + n - 1) as win from (select item_id, w, least({window}, len(w)) as n, unnest(range(1, len(w) - least({window}, len(w)) + 2)) as k from b where len(w) > 0)),
d as (select doc_id, {ws('text')} as w from {docs}),
sizes as (select distinct n from bw),
dw as (select doc_id, n, k, list_slice(w, k, k + n - 1) as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
hits as (select dw.doc_id, dw.k, dw.n, bw.item_id from dw join bw on dw.win = bw.win and dw.n = bw.n),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places on places.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""


def exact_sql(docs: str = "documents") -> str:
    return f"""
with n as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as norm from {docs})
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from n"""


def _means(members: str, by: str, old: str) -> str:
    """New cells by key: floored means of members' cells, old ones where nothing is assigned. Sums are exact as doubles."""
    return f"""select {by}, coalesce(m.cells, o.cells) as cells from {old} o left join (select {by}, list(floor(s / n) order by p) as cells
        from (select {by}, p, sum(cells[p]) as s, count(*) as n from (select *, unnest(range(1, len(cells) + 1)) as p from {members}) group by {by}, p) group by {by}) m using ({by})"""


def vqcodes_sql(vectors: str = "embeddings", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every distance to every entry; whole numbers as doubles, which inner products leave exact."""
    ctes = [
        f"v as materialized (select vec_id, label, row_number() over () as r, list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as cells from {vectors} where embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))",
        f"pt as materialized (select r, j, cells[j * (len(cells) // {parts}) + 1 : (j + 1) * (len(cells) // {parts})] as cells from v, range({parts}) t(j))",
        f"b0 as materialized (select j, e, pt.cells from pt join (select r, row_number() over (order by vec_id) - 1 as e from v qualify e < {entries}) using (r))",
    ]
    for k in range(rounds + 1):
        ctes.append(f"a{k} as materialized (select pt.r, pt.j, any_value(pt.cells) as cells, min(struct_pack(d := list_inner_product(pt.cells, pt.cells) - 2 * list_inner_product(pt.cells, b.cells) + list_inner_product(b.cells, b.cells), e := b.e)) as best from pt join b{k} b using (j) group by pt.r, pt.j)")
        if k < rounds:
            ctes.append(f"m{k} as materialized (select j, best.e as e, cells from a{k})")
            ctes.append(f"b{k + 1} as materialized ({_means(f'm{k}', 'j, e', f'b{k}')})")
    ctes.append(f"c as (select r, string_agg(printf('%02x', cast(best.e as int)), '' order by j) as code, cast(sum(best.d) as bigint) as error from a{rounds} group by r)")
    ctes.append(f"h as (select sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by j, e, p)) as codebooks_sha256 from (select j, e, unnest(cells) as x, unnest(range(len(cells))) as p from b{rounds}))")
    return "with " + ",\n".join(ctes) + "\nselect vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from v join c using (r), h"


def clusters_sql(vectors: str = "embeddings", k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64) -> str:
    ctes = [
        f"v as materialized (select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as cells from {vectors} where len(embedding) = {dim} and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))",
        f"b0 as materialized (select row_number() over (order by sha256('1:' || cast(vec_id as varchar)), cells) - 1 as e, cells from v qualify e < {k})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} as materialized (select v.r, any_value(v.cells) as cells, min(struct_pack(d := list_inner_product(v.cells, v.cells) - 2 * list_inner_product(v.cells, b.cells) + list_inner_product(b.cells, b.cells), e := b.e)) as best from v, b{i} b group by v.r)")
        if i < rounds:
            ctes.append(f"m{i} as materialized (select best.e as e, cells from a{i})")
            ctes.append(f"b{i + 1} as materialized ({_means(f'm{i}', 'e', f'b{i}')})")
    ctes.append(f"h as (select e, sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by p)) as centroid_sha256 from (select e, unnest(cells) as x, unnest(range(len(cells))) as p from b{rounds}) group by e)")
    return "with " + ",\n".join(ctes) + f"\nselect vec_id, cast(e as int) as cluster, cast(best.d as bigint) as distance, cast(sum(best.d) over (partition by e) as bigint) as cluster_inertia, cast(sum(best.d) over () as bigint) as inertia, centroid_sha256 from (select r, best, best.e as e from a{rounds}) join v using (r) join h using (e)"


def mixing_sql(docs: str = "documents", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 16, seed: int = 42, per_shard: int = 1000) -> str:
    """Every quotient listed and ranked; the tree of shards has one level here, enough for 256 shards."""
    return f"""
with s as materialized (select doc_id, source is null as unnamed, coalesce(source, '') as name, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size, sha256('{seed}:' || coalesce(cast(doc_id as varchar), 'null')) as place from {docs}),
t as (select case when count(*) // {per_shard} = 0 then 0 else cast(floor(log2(count(*) // {per_shard})) as bigint) + 1 end as bits from s),
d as materialized (select s.*, cast('0x' || substr(place, 1, 8) as bigint) // (1 << (32 - bits)) as shard from s, t),
src as materialized (select unnamed, name, cast(sum(size) as bigint) as source_size, row_number() over (order by unnamed, name) - 1 as rank from s group by unnamed, name),
w as (select *, [{', '.join(map(str, weights))}][rank % {len(weights)} + 1] as weight, {most} * source_size as cap from src),
o as (select *, coalesce(sum(cap) over lower, 0) as caps, coalesce(sum(weight) over lower, 0) as ws, sum(source_size) over () as total, sum(weight) over () as wsum from w
      window lower as (order by cast(cap as double) / weight, rank rows between unbounded preceding and 1 preceding)),
f as (select *, weight * (total - caps) > cap * (wsum - ws) as above from o),
r as (select max(total) - coalesce(sum(cap) filter (above), 0) as rest, coalesce(sum(weight) filter (not above), 1) as shares from f),
g as materialized (select unnamed, name, source_size, rank, case when above then cast(cap as double) else cast(weight as double) * cast(rest as double) / cast(shares as double) end as target from f, r),
n as (select (sum(source_size) + {block // 2}) // {block} as seats, count(*) as n, sum(target) as v from g),
q as (select rank, target / (2 * k + 1) as quotient, k from (select rank, target, seats, unnest(range(cast(floor(target * (seats + n) / greatest(v, 1) + 0.5) as bigint) + 1)) as k from g, n where target > 0)),
won as (select rank, count(*) as quota from (select rank, row_number() over (order by quotient desc, rank, k) as no from q) , n where no <= seats group by rank),
sh as materialized (select unnamed, name, shard, cast(sum(size) as bigint) as total from d group by unnamed, name, shard),
p as (select sh.*, coalesce(quota, 0) as seats, count(*) over one as n, sum(total) over one as v from sh join g using (unnamed, name) left join won using (rank) window one as (partition by unnamed, name)),
pq as (select unnamed, name, shard, seats, row_number() over (partition by unnamed, name order by cast(total as double) / (2 * k + 1) desc, shard, k) as no from (select *, unnest(range(cast(floor(total * (seats + n) / v + 0.5) as bigint) + 1)) as k from p where total > 0 and seats > 0)),
dealt as (select unnamed, name, shard, count(*) as quota from pq where no <= seats group by unnamed, name, shard),
y as (select sh.*, coalesce(quota, 0) * {block} as due, cast('0x' || substr(sha256('{seed}:' || cast(shard as varchar) || ':' || name), 1, 8) as bigint) % greatest(total // {block}, 1) * {block} as first from sh left join dealt using (unnamed, name, shard)),
z as (select *, case when total > 0 then least(due // total, {most}) else 0 end as passes from y),
u as (select *, case when total > 0 and passes < {most} then due - passes * total else 0 end as rest from z),
e as (select *, sum(size) over (partition by unnamed, name, shard order by place, doc_id, size rows unbounded preceding) as b from d),
x as (select e.*, b - size as a, total, passes, first, first + rest as stop from e join u using (unnamed, name, shard)),
part as (select *, greatest(0, least(b, stop, total) - greatest(a, first)) + greatest(0, least(b, stop - total) - a) as part from x)
select doc_id, case when not unnamed then name end as source, size, source_size, target, cast(size * passes + part as bigint) as taken, cast(passes + case when part = size and size > 0 then 1 else 0 end as bigint) as copies
from part join g using (unnamed, name)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_round_trip": warc_sql(),
        "op5_decontamination": decontam_sql(),
        "op8_exact_duplicates": exact_sql(),
        "op11_vector_codes": vqcodes_sql(),
        "op12_source_mixing": mixing_sql(),
        "op13_hamerly_clusters": clusters_sql(),
    }
