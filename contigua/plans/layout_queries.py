"""Queries on scaffold layout: from distance estimates to scaffolds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from contigua.operators import layout, scaffold
from contigua.plans.registry import DS, query
from contigua.plans.stat_queries import _ASTAT, _contigs
from contigua.runtime import materialize

#: Contigs in groups of eight lie one after another, some turned; links reach three contigs, some are missing, some are wrong by 600 bases.
_PLACED = """ct as materialized (select doc_id as id, length(seq) as len, (length(seq) // 2) * (1 + (doc_id % 8 = 4)::int) as n from ds),
bl as (select id, len, (id % 4 = 1)::int as st, sum(len + 40 + id % 30) over (partition by id // 8 order by id) - len as s from ct where id % 8 >= 1),
lk as materialized (select a.id as x, a.st as xs, b.id as y, b.st as ys, (b.s - a.s - a.len + (a.id * 37 + b.id * 211) % 61 - case when (a.id + b.id) % 11 = 0 then 600 else 0 end)::double as dist, (10 + a.id % 7)::double as sd
       from bl a join bl b on a.id // 8 = b.id // 8 and b.id > a.id and b.id - a.id <= 3 where (a.id * 7 + b.id) % 5 <> 0)"""


def _estimates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _contigs(spark, sf_dir).select("id", "len")
    c = materialize(c.withColumn("n", F.floor(F.col("len") / 2) * (1 + (F.col("id") % 8 == 4).cast("int"))), "layout-contigs")
    group = W.partitionBy(F.floor(F.col("id") / 8)).orderBy("id")
    b = c.filter("id % 8 >= 1").select("id", "len", (F.col("id") % 4 == 1).cast("int").alias("st"), (F.sum(F.col("len") + 40 + F.col("id") % 30).over(group) - F.col("len")).alias("s"), F.floor(F.col("id") / 8).alias("g"))
    z = b.select("g", F.col("id").alias("y"), F.col("st").alias("ys"), F.col("s").alias("sy"))
    j = b.withColumnRenamed("id", "x").withColumnRenamed("st", "xs").join(z, "g").filter("y > x and y - x <= 3 and (x * 7 + y) % 5 <> 0")
    dist = F.col("sy") - F.col("s") - F.col("len") + (F.col("x") * 37 + F.col("y") * 211) % 61 - F.when((F.col("x") + F.col("y")) % 11 == 0, 600).otherwise(0)
    return c, materialize(j.select("x", "xs", "y", "ys", dist.cast("double").alias("dist"), (10 + F.col("x") % 7).cast("double").alias("sd"), (3 + F.col("x") % 5).alias("n_pairs")), "layout-estimates")


def _walks(links: str) -> str:
    """SQL of the links of every component's walk of most bases, by listing all walks."""
    return f"""tw as materialized (select x * 2 + xs as a, y * 2 + ys as b, dist from {links} union all select y * 2 + 1 - ys, x * 2 + 1 - xs, dist from {links}),
hd as (select distinct a from tw anti join (select b as a from tw) using (a)), va as (select v, len from (select id * 2 + st as v, len from ct, (select unnest([0, 1]) as st))),
pa as (select a as s, a as v, 0::double as d, len::bigint as bases, [a] as p from hd join va on v = a union all select s, b, d + dist, bases + len, list_append(p, b) from pa join tw on pa.v = tw.a join va on va.v = tw.b),
fin as materialized (select s, v, bases, p from pa anti join (select distinct a as v from tw) using (v) qualify row_number() over (partition by s, v order by d, bases desc, p) = 1),
nb as (select distinct a // 2 as i, b // 2 as j from tw), re as (select i, j from nb union select re.i, nb.j from re join nb on re.j = nb.i), cp as (select i, least(i, min(j)) as comp from re group by i),
ch as (select s, v, p from fin join cp on s // 2 = i qualify row_number() over (partition by comp order by bases desc, s, v) = 1),
st as (select p[k] as a, p[k + 1] as b from (select p, unnest(generate_series(1, len(p) - 1)) as k from ch)),
ly as materialized (select a, b, dist from tw semi join (select a, b from st union select case when b % 2 = 0 then b + 1 else b - 1 end, case when a % 2 = 0 then a + 1 else a - 1 end from st) using (a, b))"""


@query(f"with recursive {DS}, {_PLACED}, {_walks('lk')} select (a // 2)::bigint as x, (a % 2)::int as xs, (b // 2)::bigint as y, (b % 2)::int as ys, dist from ly")
def scaffold_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every component the shortest-gap walk from end to end that holds most bases."""
    c, e = _estimates(spark, sf_dir)
    return layout.layout_links(c, scaffold.twins(e))


_KEPT = """ok as (select id from ast where copy_number >= 0.3 and a_stat > 20), l0 as materialized (select * from lk semi join (select id as x from ok) using (x) semi join (select id as y from ok) using (y)),
t0 as materialized (select x, xs, y, ys, dist from l0 union all select y, 1 - ys, x, 1 - xs, dist from l0), ov as (select x, xs, y, dist as s, dist + len - 1 as e from t0 join ct on y = id),
bad as materialized (select distinct a.x, a.xs from ov a join ov b on a.x = b.x and a.xs = b.xs and a.y < b.y where least(a.e, b.e) - greatest(a.s, b.s) + 1 >= 400),
cu as materialized (select x, xs from bad union select y, 1 - ys from t0 semi join bad using (x, xs)),
l1 as materialized (select * from l0 anti join cu using (x, xs) anti join (select x as y, 1 - xs as ys from cu) using (y, ys))"""


@query(f"""with recursive {DS}, {_PLACED}, {_ASTAT}, {_KEPT}, {_walks('l1')},
vs as (select id * 2 + s as v from ct, (select unnest([0, 1]) as s)), h2 as (select v from vs anti join (select b as v from ly) using (v)),
wk as (select v as head, v, 0 as ord from h2 union all select head, b, ord + 1 from wk join ly on v = a),
en as (select head, arg_max(v, ord) as last from wk group by head), kp as (select head from en where head <= case when last % 2 = 0 then last + 1 else last - 1 end)
select (head // 2)::bigint as scaffold, ord::bigint as ord, (v // 2)::bigint as id, (v % 2)::int as st, dist from wk semi join kp using (head) left join ly on v = a""")
def scaffold_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaffolds from estimates of both roots: repeats by the arrival-rate statistic, validation, cycles, layout, chains."""
    c, e = _estimates(spark, sf_dir)
    back = e.select(F.col("y").alias("x"), (1 - F.col("ys")).alias("xs"), F.col("x").alias("y"), (1 - F.col("xs")).alias("ys"), "dist", (F.col("sd") + 1).alias("sd"), "n_pairs")
    return layout.build(c, e.unionByName(back), scaffold.a_statistic(c))
