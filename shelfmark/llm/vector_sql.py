"""The same questions on vectors as SQL: every round is a common table of its own."""

from __future__ import annotations


def codes_sql(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    places = range(1, width + 1)
    distance = " + ".join(f"(v.x{k} - c.x{k}) * (v.x{k} - c.x{k})" for k in places)
    steps = [
        f"""
kept as materialized (
  select vec_id, label, [floor({scale} * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
cut as materialized (
  select vec_id, label, p, {", ".join(f"v[{width} * p + {k}] as x{k}" for k in places)}
  from kept, (select unnest(range({parts})) as p)),
book0 as materialized (
  select p, n - 1 as e, {", ".join(f"x{k}" for k in places)}
  from (select *, row_number() over (partition by p order by vec_id) as n from cut) where n <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""
near{r} as materialized (
  select v.vec_id, v.label, v.p, {", ".join(f"any_value(v.x{k}) as x{k}" for k in places)},
    min(({distance}) * {entries} + c.e) as best
  from cut v join book{r} c using (p) group by v.vec_id, v.label, v.p)"""
        )
        if r < rounds:
            means = ", ".join(f"coalesce((m.s{k} - ((m.s{k} % m.n) + m.n) % m.n) // m.n, b.x{k}) as x{k}" for k in places)
            sums = ", ".join(f"sum(x{k})::bigint as s{k}" for k in places)
            steps.append(
                f"""
book{r + 1} as materialized (
  select b.p, b.e, {means}
  from book{r} b left join (select p, best % {entries} as e, count(*) as n, {sums} from near{r} group by p, e) m using (p, e))"""
            )
    listed = " || ',' || ".join(f"x{k}" for k in places)
    return f"""with {",".join(steps)},
coded as (
  select vec_id, label, string_agg(printf('%02x', best % {entries}), '' order by p) as code, sum(best // {entries})::bigint as error
  from near{rounds} group by vec_id, label)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg({listed}, ',' order by p, e)) from book{rounds}) as codebooks_sha256
from coded"""


def clusters_sql(width: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024) -> str:
    apart = "list_sum([(a.v[k] - c.v[k]) * (a.v[k] - c.v[k]) for k in range(1, {w} + 1)])::bigint".format(w=width)
    steps = [
        f"""
kept as materialized (
  select vec_id, [floor({scale} * x::double)::bigint for x in embedding] as v from embeddings
  where len(embedding) = {width} and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
book0 as materialized (
  select n - 1 as c, v from (select v, row_number() over (order by sha256('3:' || vec_id)) as n from kept) where n <= {clusters})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""
near{r} as materialized (
  select a.vec_id, any_value(a.v) as v, min({apart} * {clusters} + c.c) as best from kept a, book{r} c group by a.vec_id)"""
        )
        if r < rounds:
            steps.append(
                f"""
sums{r} as materialized (
  select c, k, sum(v[k])::bigint as s, count(*) as n
  from (select best % {clusters} as c, v, unnest(range(1, {width} + 1)) as k from near{r}) group by c, k),
book{r + 1} as materialized (
  select b.c, coalesce(m.v, b.v) as v
  from book{r} b left join (select c, list((s - ((s % n) + n) % n) // n order by k) as v from sums{r} group by c) m using (c))"""
            )
    return f"""with {",".join(steps)}
select n.vec_id, c.c::integer as cluster, n.best // {clusters} as distance,
  sum(n.best // {clusters}) over (partition by c.c)::bigint as cluster_inertia, sum(n.best // {clusters}) over ()::bigint as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from near{rounds} n join book{rounds} c on n.best % {clusters} = c.c"""


CODES_SQL = codes_sql()
CLUSTERS_SQL = clusters_sql()
