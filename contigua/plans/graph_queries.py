"""Queries on overlap graphs, from reads to contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.functions import batches as B
from contigua.functions import sequence as S
from contigua.operators import bubbles, correct, dedup, graph, overlap
from contigua.operators import reads as R
from contigua.plans.read_queries import _BOTH, _IRR, _OVL, unique_reads
from contigua.plans.registry import ERR, canon, occ, query, rc
from contigua.runtime import materialize


def _graph(spark: SparkSession, sf_dir: str, reduced: bool = True) -> tuple[DataFrame, DataFrame]:
    u = unique_reads(spark, sf_dir)
    o = materialize(overlap.exact_overlaps(u), "overlaps", tidy=True)
    e = materialize(overlap.irreducible(o, 100), "edges", tidy=True) if reduced else o.select("x", "xs", "y", "ys", (100 - F.col("ov")).alias("lab"))
    return u.select(F.col("read_idx").alias("id"), "seq"), e


_DEG = "dg as materialized (select u.read_idx as id, count(x) filter (xs = 0) as s, count(x) filter (xs = 1) as a from u left join irr on u.read_idx = x group by 1)"


@query(f"""with {_IRR}, {_DEG} select count(*)::bigint as n_vertex, sum(s + a)::bigint as n_edges, count(*) filter (s = 0 and a = 0)::bigint as n_island,
count(*) filter ((s = 0 or a = 0) and s + a > 0)::bigint as n_terminal, count(*) filter ((s > 1 or a > 1) and not (s > 1 and a > 1))::bigint as n_monobranch,
count(*) filter (s > 1 and a > 1)::bigint as n_dibranch, count(*) filter (s = 1 or a = 1)::bigint as n_simple from dg""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(*_graph(spark, sf_dir))


@query(f"with {_IRR}, {_DEG} select read_idx as id from u join dg on u.read_idx = dg.id where (s = 0 or a = 0) and length(seq) < 300")
def graph_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tips(*_graph(spark, sf_dir))


@query(f"""with {_IRR}, {_DEG}, tip as (select id from dg where s = 0 or a = 0)
select x, xs, y, ys, lab::int as lab from irr anti join tip on x = tip.id anti join tip t2 on y = t2.id""")
def graph_trim_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trim(*_graph(spark, sf_dir), rounds=1)[1].select("x", "xs", "y", "ys", "lab")


@query(f"""with {_OVL}, e as (select x, xs, y, ys, 100 - ov as lab from ov), bd as (select x, xs, max(lab) + 10 as bound from e group by all),
t as (select distinct a.x, a.xs, b.y, b.ys from e a join e b on a.y = b.x and a.ys = b.xs join bd on a.x = bd.x and a.xs = bd.xs where a.lab + b.lab <= bound),
tt as (select x, xs, y, ys from t union select y, 1 - ys, x, 1 - xs from t) select x, xs, y, ys, lab::int as lab from e anti join tt using (x, xs, y, ys)""")
def graph_transitive_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitive_reduction(_graph(spark, sf_dir, reduced=False)[1]).select("x", "xs", "y", "ys", "lab")


@query(f"""with {_OVL}, p as materialized (select x, xs, max(ov) as best, min(ov) as worst from ov group by all)
select o.x, o.xs, o.y, o.ys, (100 - ov)::int as lab from ov o join p a on o.x = a.x and o.xs = a.xs join p b on b.x = o.y and b.xs = 1 - o.ys
where ov = a.worst and ov = b.worst and a.best - ov > 10 and b.best - ov > 10""")
def graph_small_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.small_repeat_edges(_graph(spark, sf_dir, reduced=False)[1], 100, 10)


@query(f"""with {_OVL} select x, xs, y, ys, lab::int as lab from (select x, xs, y, ys, 100 - ov as lab, row_number() over (partition by x, xs, y order by 100 - ov, ys) as r from ov) where r = 1""")
def graph_duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_of_duplicates(_graph(spark, sf_dir, reduced=False)[1])


@query(f"""with {_OVL}, e as (select x, xs, y from ov), d as materialized (select x as id from e group by x having count(*) > 6), g as materialized (select id from d union select y from e semi join d on e.x = d.id)
select x, xs, y, ys, (100 - ov)::int as lab from ov anti join g on x = g.id anti join g g2 on y = g2.id""")
def graph_without_super_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.without_super_repeats(_graph(spark, sf_dir, reduced=False)[1], 6).select("x", "xs", "y", "ys", "lab")


@query(f"with {_OVL} select distinct x as id from (select x, xs from ov group by x, xs having count(*) > 3)")
def graph_super_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with more than three edges on a side."""
    return graph.super_repeats(_graph(spark, sf_dir, reduced=False)[1], 3)


@query(f"""with {_IRR}, u2 as (select y as x, 1 - ys as xs, x as y, 1 - xs as ys from e)
select x, xs, y, ys, 'no twin' as error from e anti join u2 using (x, xs, y, ys) union all select x, xs, y, ys, 'missing' from irr anti join e using (x, xs, y, ys)
union all select x, xs, y, ys, 'extra' from e anti join irr using (x, xs, y, ys)""")
def graph_structure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps held against the irreducible ones."""
    o = materialize(overlap.exact_overlaps(unique_reads(spark, sf_dir)), "overlaps", tidy=True)
    return graph.structure_errors(o, overlap.irreducible(o, 100))


@query(f"""with {_OVL}, r as (select x, xs, ov, row_number() over (partition by x, xs order by ov desc, y, ys) as n from ov)
select x, xs, max(ov)::int as longest, (max(ov) - coalesce(max(ov) filter (n = 2), 0))::int as ahead from r where n <= 2 group by x, xs""")
def graph_longest_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = overlap.exact_overlaps(unique_reads(spark, sf_dir))
    return graph.longest_overlaps(o).select("x", "xs", F.col("longest").cast("int").alias("longest"), F.col("ahead").cast("int").alias("ahead"))


@query(f"""with recursive {_IRR}, hops as (select 0::bigint as id, 0 as hop union select y, hop + 1 from hops join irr on x = id where hop < 5)
select id, min(hop)::int as hop from hops group by id""")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(_graph(spark, sf_dir)[1], 0, 5)


_COMP = "reach as (select read_idx as id, read_idx as c from u union select irr.y, reach.c from reach join irr on irr.x = reach.id), comp as (select id, min(c) as component from reach group by id)"


@query(f"with recursive {_IRR}, {_COMP} select id, component from comp")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(*_graph(spark, sf_dir))


@query(f"""with recursive {_IRR}, {_COMP}, sizes as (select component, count(*) as size from comp group by component having count(*) >= 2)
select component as cluster_id, size, id from comp join sizes using (component)""")
def cluster_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clusters(*_graph(spark, sf_dir), min_size=2)


#: Chains of an edge table ``irr`` over vertices ``ori`` (v = id * 2 + st, seq): walks along arcs without branches, from heads and, on
#: rings, from the smallest vertex of each; of both strands the one whose head is not larger than the turned end.
_CHAINS = """ori as materialized (select read_idx * 2 as v, seq from u union all select read_idx * 2 + 1, {rc} from u),
arc as materialized (select a, b, lab from (select x * 2 + xs as a, y * 2 + ys as b, lab, x, y, count(*) over (partition by x, xs) as n_out, count(*) over (partition by y, ys) as n_in from irr) where n_out = 1 and n_in = 1 and x <> y),
up as (select v, v as top, 0 as k from ori anti join arc on arc.b = ori.v union all select arc.b, up.top, k + 1 from up join arc on arc.a = up.v),
ringed as materialized (select v from ori anti join up using (v)),
low as (select v, v as here from ringed union select low.v, arc.b from low join arc on arc.a = low.here),
cut as materialized (select v from (select v, min(here) as m from low group by v) where v = m),
turned as materialized (select v, xor(v, 1) as w from cut),
arc2 as materialized (select arc.* from arc anti join (select v from cut where v % 2 = 0) c on arc.b = c.v anti join (select w from turned where v % 2 = 0) t on arc.a = t.w),
wk as (select v, v as head, 0 as steps, 0::bigint as lab from ori anti join arc2 on arc2.b = ori.v union all select arc2.b, wk.head, steps + 1, arc2.lab from wk join arc2 on arc2.a = wk.v),
ch as materialized (select head, arg_max(v, steps) as last, count(*) as n_vertices, string_agg(case when steps = 0 then seq else right(seq, lab::int) end, '' order by steps) as seq from wk join ori using (v) group by head),
chain as materialized (select * from ch where head <= xor(last, 1))""".format(rc=rc("seq"))


@query(f"with recursive {_IRR}, {_CHAINS} select (head // 2)::bigint as head, (head % 2)::int as head_st, n_vertices, seq from chain")
def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unitigs(*_graph(spark, sf_dir))


@query(f"""with recursive {_IRR}, {_CHAINS} select 'contig-' || (row_number() over (order by length(seq) desc, seq, head) - 1) as id, n_vertices, length(seq)::int as length, seq from chain""")
def assemble_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, duplicates out, overlaps, irreducible edges, chains: contigs by length."""
    return graph.rename_contigs(graph.unitigs(*_graph(spark, sf_dir))).select("id", "n_vertices", F.length("seq").alias("length"), "seq")


#: The graph of chains: ``cv`` (id, seq, coverage) and ``ce`` (oriented a, b, lab).
_COMPACT = f"""{_CHAINS},
cv as materialized (select head // 2 as id, seq, n_vertices as coverage from chain),
co as (select last as a, head as c, 0 as st from chain union all select xor(head, 1), head, 1 from chain),
ci as (select head as b, head as c, 0 as st, length(seq) as n from chain union all select xor(last, 1), head, 1, length(seq) from chain),
ce as materialized (select distinct co.c // 2 * 2 + co.st as a, ci.c // 2 * 2 + ci.st as b, n - (100 - lab) as lab from irr join co on co.a = x * 2 + xs join ci on ci.b = y * 2 + ys)"""


def _chain_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, e = graph.compact(*_graph(spark, sf_dir))
    return materialize(v, "chain-vertices"), e


@query(f"with recursive {_IRR}, {_COMPACT} select (a // 2)::bigint as x, (a % 2)::int as xs, (b // 2)::bigint as y, (b % 2)::int as ys, lab::bigint as lab from ce")
def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the chains of the graph, with the bases that each adds."""
    return _chain_graph(spark, sf_dir)[1].select("x", "xs", "y", "ys", F.col("lab").cast("long").alias("lab"))


#: Walks from forks, all rounds of them; a walk that can't grow stays.
_VARIANTS = f"""{_COMPACT},
fork as (select a from ce group by a having count(*) > 1),
gw as (select a as bubble, [a] as path, []::bigint[] as labels, 0::bigint as dist, 0 as round, true as open from fork
       union all
       select gw.bubble, case when b is null then path else list_append(path, b) end, case when b is null then labels else list_append(labels, lab) end, dist + coalesce(lab, 0), round + 1, b is not null
       from gw left join ce on open and ce.a = path[-1] and dist + ce.lab <= 2000 and not list_contains(list_transform(path, lambda v: v // 2), ce.b // 2) where round < 8),
sz as (select bubble, round, count(*) as n, count(*) filter (open) as n_open from gw group by all),
pv as (select bubble, round, v // 2 as v, i from (select bubble, round, unnest(path[2:]) as v, unnest(range(len(path) - 1)) as i from gw)),
mt as (select bubble, round, v, max(i) as i from pv join sz using (bubble, round) group by bubble, round, v, n having count(*) = n),
fm as (select bubble, round, meet from (select *, row_number() over (partition by bubble order by round) as nth from (select bubble, round, arg_min(v, row(i, v)) as meet from mt group by bubble, round)) where nth = 1),
ended as (select bubble, min(round) as r from sz where n > 500 or n_open = 0 group by bubble),
cw as materialized (select distinct gw.bubble, path[1:list_position(list_transform(path, lambda v: v // 2), meet)] as path, labels[1:list_position(list_transform(path, lambda v: v // 2), meet) - 1] as labels
       from gw join fm using (bubble, round) left join ended using (bubble) where r is null or fm.round <= r),
gd as materialized (select bubble, min(path[-1]) as last from cw group by bubble having count(*) between 2 and 10 and min(path[-1]) = max(path[-1])),
mb as materialized (select distinct bubble, v // 2 as v from (select bubble, unnest(path) as v from cw semi join gd using (bubble))),
tp as (select bubble, bubble as a from gd union all select bubble, xor(last, 1) from gd union all
       select bubble, unnest([v * 2, v * 2 + 1]) from mb join gd using (bubble) where v <> bubble // 2 and v <> last // 2),
bad as (select distinct bubble from (select distinct bubble, b // 2 as v from tp join ce using (a)) anti join mb using (bubble, v)),
vw as materialized (select cw.* from cw semi join gd using (bubble) anti join bad using (bubble)),
on_ as materialized (select c.id * 2 as v, seq from cv c union all select c.id * 2 + 1, {rc("seq")} from cv c),
st as (select bubble, path, labels, string_agg(case when i = 1 then on_.seq else right(on_.seq, labels[i - 1]::int) end, '' order by i) as seq, coalesce(sum(coverage) filter (i > 1 and i < len(path)), 0)::bigint as coverage
       from (select bubble, path, labels, unnest(path) as v, unnest(generate_series(1, len(path))) as i from vw) join on_ using (v) join cv on cv.id = v // 2 group by bubble, path, labels),
ln as (select st.bubble, st.path, st.labels, st.seq, st.coverage, length(s.seq) as n_start, length(f.seq) - labels[1] as ov1, length(e.seq) - labels[-1] as ov2, length(e.seq) as n_last from st join on_ s on s.v = path[1] join on_ f on f.v = path[2] join on_ e on e.v = path[-1]),
rg as (select *, n_start - min(ov1) over (partition by bubble) as lo, length(seq) - (n_last - min(ov2) over (partition by bubble)) as hi, row_number() over (partition by bubble order by coverage desc, path) - 1 as rank from ln)"""


@query(f"""with recursive {_IRR}, {_VARIANTS}
select bubble::bigint as bubble, rank::int as rank, len(path)::int as n_vertices, coverage, seq, case when hi > lo then substr(seq, (lo + 1)::bigint, (hi - lo)::bigint) else '' end as region from rg""")
def variant_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of the graph of chains that part and meet again, of up to 2000 added bases and 8 edges, and what varies between them."""
    v, e = _chain_graph(spark, sf_dir)
    w = bubbles.variant_strings(bubbles.variant_walks(e, 2000, 10, 8), v)
    return w.select("bubble", F.col("rank").cast("int").alias("rank"), F.size("path").alias("n_vertices"), "coverage", "seq", "region")


@query()
def bubble_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that one round of smoothing writes, the kept walk and those that differ from it little enough."""
    return bubbles.smooth_round(*_chain_graph(spark, sf_dir))[2]


@query()
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole assembly: chains, ten trim rounds, chains, three rounds of smoothing, chains; contigs by length."""
    v, _, _ = bubbles.assemble(*_graph(spark, sf_dir))
    named = graph.rename_contigs(v.withColumnRenamed("coverage", "n_vertices"))
    return named.select("id", F.col("n_vertices").alias("coverage"), F.length("seq").alias("length"), "seq")


@query(f"""with {ERR}, c as {_BOTH('err', 31)}, l as (select n from {occ('err', 31)} o join c on {canon('o.kmer')} = c.kmer),
h as (select n, count(*) as kmers from l where n <= 1000 group by n), d as (select i as n, coalesce(kmers, 0) as kmers from generate_series(0, 1000) t(i) left join h on i = h.n),
mode as (select n as mode from d where n >= 5 order by kmers desc, n limit 1), x as (select n, kmers, lead(kmers) over (order by n) as after from d)
select coalesce(min(n), -1)::bigint as threshold from x, mode where n >= 1 and n < mode - 1 and after > 0 and kmers::double / after < 2.0""")
def correct_learn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.learned_threshold(R.with_errors(R.derive(spark, sf_dir)), 31)


_NEED = "case when list_min(list_transform(generate_series(p, p + 30), lambda i: ascii(substr(qual, i, 1)) - 33)) >= 20 then 2 else 3 end"


@query(f"""with {ERR}, c as {_BOTH('err', 31)}, w as (select read_idx, p, {canon('substr(seq, p, 31)')} as kmer, {_NEED} as need from (select *, unnest(generate_series(1, length(seq) - 30)) as p from err)),
ok as (select read_idx, p from w join c using (kmer) where n >= need),
cov as (select distinct read_idx, i from ok, (select unnest(generate_series(0, 30)) as o) t, lateral (select p + o as i))
select read_idx, min(i)::int as weak_at from (select read_idx, unnest(generate_series(1, length(seq))) as i from err) b anti join cov using (read_idx, i) group by read_idx""")
def correct_weak_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contigua.operators import kmers

    reads = materialize(R.with_errors(R.derive(spark, sf_dir)), "error-reads")
    return correct.weak_positions(reads, kmers.both_strands(reads, 31), 31, 2).withColumnRenamed("at", "weak_at")


@query()
def correct_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = materialize(R.with_errors(R.derive(spark, sf_dir)), "error-reads")
    return correct.correct(reads, 31, support=2)


@query()
def correct_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = materialize(R.with_errors(R.derive(spark, sf_dir)), "error-reads")
    return correct.metrics(reads, correct.correct(reads, 31, support=2))


@query()
def overlap_inexact(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "seq")
    return overlap.inexact_overlaps(dedup.remove_duplicates(reads), 55, 0.02)


@query(f"""with {ERR} select read_idx, {canon('seq')} as canonical, greatest(length(seq) - length(replace(seq, 'A', '')), length(seq) - length(replace(seq, 'C', '')),
length(seq) - length(replace(seq, 'G', '')), length(seq) - length(replace(seq, 'T', '')))::double / length(seq) as max_share,
list_max(list_transform(regexp_extract_all(seq, '(A+|C+|G+|T+)'), lambda r: length(r)))::int as longest_run from err""")
def read_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.with_errors(R.derive(spark, sf_dir))
    return r.select("read_idx", B.canonical_udf("seq").alias("canonical"), B.max_share_udf("seq").alias("max_share"), B.longest_run_udf("seq")["length"].alias("longest_run"))
