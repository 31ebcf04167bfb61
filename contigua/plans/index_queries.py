"""Queries on index lookups, the read filter, read columns and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.functions import coords as C
from contigua.functions import statistics as D
from contigua.operators import dedup, index, kmers, pileup, preqc, qc
from contigua.operators import reads as R
from contigua.plans.read_queries import _BOTH
from contigua.plans.registry import DS, ERR, ORACLES, READS, canon, occ, query, rc
from contigua.runtime import materialize


@query(f"with {READS} select read_idx, row_number() over (order by seq, read_idx) - 1 as rank from reads")
def lexicographic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lexicographic_index(R.derive(spark, sf_dir))


def _suffix_sql(shortest: int) -> str:
    """CTE ``sx`` of the ranked suffixes of ``shortest`` bases at least."""
    return f"""{READS}, sx as (select read_idx, p::int as pos, case when p = 1 then '$' else substr(seq, p - 1, 1) end as before,
row_number() over (order by substr(seq, p), read_idx) - 1 as rank from (select *, unnest(generate_series(1, length(seq) - {shortest - 1})) as p from reads))"""


@query(f"with {_suffix_sql(80)} select rank, read_idx, pos, before from sx")
def suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.suffix_order(R.derive(spark, sf_dir), 80)


@query(f"""with {_suffix_sql(1)}, f as (select rank, before is distinct from lag(before) over (order by rank) as new from sx),
g as (select sum(new::int) over (order by rank) as run from f), n as (select run, count(*) as length from g group by run) select length, count(*) as runs from n group by length""")
def suffix_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over all suffixes, however short."""
    return index.suffix_runs(materialize(R.derive(spark, sf_dir).select("read_idx", "seq"), "reads"))


@query(f"with {READS} select 'read-' || (row_number() over (order by read_idx) - 1) as name, seq from reads")
def index_to_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.in_index_order(R.derive(spark, sf_dir), "read")


@query(f"""with {READS}, w as materialized (select '$' || left(seq, 31) as word from reads union select right(seq, 31) || '$' from reads union select substr(seq, 20, 31) from reads),
o as materialized (select o.*, p = length(seq) - 30 as at_end from {occ('reads', 31)} o join reads using (read_idx)),
n as (select word, count(*) as n from w join o on replace(word, '$', '') = kmer where (not starts_with(word, '$') or p = 1) and (not ends_with(word, '$') or at_end) group by word)
select word, coalesce(n, 0)::bigint as n from w left join n using (word)""")
def anchored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    words = r.select(F.explode(F.array(F.concat(F.lit("$"), F.left("seq", F.lit(31))), F.concat(F.right("seq", F.lit(31)), F.lit("$")), F.substring("seq", 20, 31))).alias("word")).distinct()
    return index.anchored_counts(r, words, 31)


@query(f"""with {READS}, h as (select left(seq, 60) as w, substr(seq, 61, 1) as b from reads)
select read_idx, count(*) filter (b = 'A') as n_a, count(*) filter (b = 'C') as n_c, count(*) filter (b = 'G') as n_g, count(*) filter (b = 'T') as n_t
from reads join h on right(seq, 60) = w group by read_idx""")
def exact_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.exact_extensions(R.derive(spark, sf_dir), 60)


@query(f"with {READS} select read_idx, (1 + read_idx % 50)::int as pos, (10 + read_idx % 30)::int as n, substr(seq, 1 + read_idx % 50, 10 + read_idx % 30) as piece from reads")
def extract_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, i = R.derive(spark, sf_dir), F.col("read_idx")
    return index.substrings(r, r.select("read_idx", (1 + i % 50).cast("int").alias("pos"), (10 + i % 30).cast("int").alias("n")))


@query(f"""with {READS}, w as (select distinct left(seq, 61) as word from ds where length(seq) >= 61), r as (select read_idx, row_number() over (order by seq, read_idx) - 1 as rank from reads)
select word, read_idx, p::int as pos, rank, left(seq, p - 1) as prefix, substr(seq, p) as suffix from {occ('reads', 61)} join w on kmer = word join reads using (read_idx) join r using (read_idx)""")
def ranked_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.doc_sequences(R.documents(spark, sf_dir))
    words = d.filter(F.length("seq") >= 61).select(F.left("seq", F.lit(61)).alias("word")).distinct()
    return index.around_hits(R.tile_reads(d), words, 61)


@query(f"""with {READS}, c as {_BOTH('reads', 25)}, w as (select distinct left(seq, 25) as word from ds where length(seq) >= 25),
x as (select word, left(word, p - 1) || b || substr(word, p + 1) as other from w, (select unnest(generate_series(1, 25)) as p), (select unnest(['A', 'C', 'G', 'T']) as b) where substr(word, p, 1) <> b),
m as (select word, max(n) as most from x join c on {canon('x.other')} = c.kmer group by word) select word, coalesce(most, 0)::bigint as most from w left join m using (word)""")
def best_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.doc_sequences(R.documents(spark, sf_dir))
    words = d.filter(F.length("seq") >= 25).select(F.left("seq", F.lit(25)).alias("word")).distinct()
    return index.best_neighbour(words, R.tile_reads(d), 25)


@query(f"""with {READS}, h as (select doc_id as read_idx, seq from ds), o as (select read_idx as haplotype, {canon('kmer')} as c from {occ('h', 61)}),
sole as (select c, min(haplotype) as haplotype from o group by c having count(*) = 1)
select distinct haplotype, read_idx from {occ('reads', 61)} r join sole on {canon('r.kmer')} = sole.c""")
def haplotype_specific_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.doc_sequences(R.documents(spark, sf_dir))
    return index.specific_reads(R.tile_reads(d), d.select(F.col("doc_id").alias("haplotype"), "seq"), 61)


_RUNS = """rr as (select read_idx, r, i, sum(length(r)) over (partition by read_idx order by i) - length(r) as beg
      from (select read_idx, unnest(l) as r, generate_subscripts(l, 1) as i from (select read_idx, regexp_extract_all(seq, '(A+|C+|G+|T+)') as l from {t}))),
lr as (select read_idx, beg::int as run_start, length(r)::int as run_length, left(r, 1) as run_base from (select *, row_number() over (partition by read_idx order by length(r) desc, beg) as k from rr) where k = 1)"""


@query(f"with {ERR}, {_RUNS.format(t='err')} select read_idx, run_start, run_length, run_base from lr")
def longest_homopolymer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "seq")
    return qc.longest_run(r).select("read_idx", "run_start", "run_length", "run_base")


def _homopolymer_sql(reads: str, k: int) -> str:
    """CTE ``hp`` (read_idx) of reads of ``lr`` that fail, counted in ``reads``."""
    return f"""
sp as (select read_idx, seq, run_start, run_length, run_base, case when g + {k} > length(seq) then length(seq) - {k} else greatest(g, 0) end as f
       from (select *, run_start + run_length // 2 - {k // 2} as g from lr join {reads} using (read_idx) where length(seq) >= {k} and run_length between 6 and {k // 2 - 1})),
ht as (select read_idx, run_length, run_base, substr(seq, f + 1, run_start - f) as head, substr(seq, run_start + run_length + 1, f + {k} - run_start - run_length) as tail from sp),
cw as (select read_idx, more, head || repeat(run_base, run_length + more) || tail as word from ht, (select unnest([-2, -1, 0, 1, 2]) as more) where length(head) >= 5 and length(tail) >= 5),
ow as (select seq, p from (select seq, unnest(generate_series(1, length(seq) - 30)) as p from (select seq from {reads} union all select {rc('seq')} from {reads}))),
wn as (select word, count(*) as n from (select distinct word from cw) join ow on substr(seq, p, 31) = left(word, 31) and substr(seq, p, length(word)) = word group by word),
cn as (select read_idx, more, coalesce(n, 0) as n from cw left join wn using (word)),
hp as (select read_idx from (select read_idx, max(n) as top, min(case when n = best then more end) as short, max(case when more = 0 then n end) as own
       from (select *, max(n) over (partition by read_idx) as best from cn) group by read_idx) where short <> 0 and own < 10 and own::double / top < 0.1)"""


@query(f"""with {ERR}, {_RUNS.format(t='err')}, {_homopolymer_sql('err', 51)}, dup as materialized (select read_idx from (select read_idx, row_number() over (partition by {canon('seq')} order by read_idx) as r from err) where r > 1),
c as materialized {_BOTH('err', 27)}, solid as materialized (select read_idx from {occ('err', 27)} o join c on {canon('o.kmer')} = c.kmer group by read_idx having min(n) > 3),
dg as materialized (select read_idx from err where greatest(length(seq) - length(replace(seq, 'A', '')), length(seq) - length(replace(seq, 'C', '')), length(seq) - length(replace(seq, 'G', '')), length(seq) - length(replace(seq, 'T', ''))) > 0.6 * length(seq))
select read_idx, case when dup.read_idx is not null then 'duplicate' when solid.read_idx is null then 'kmer' when hp.read_idx is not null then 'homopolymer' when dg.read_idx is not null then 'degenerate' else 'pass' end as verdict
from err left join dup using (read_idx) left join solid using (read_idx) left join (select distinct read_idx from hp) hp using (read_idx) left join dg using (read_idx)""")
def filter_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = materialize(R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "seq"), "error-reads")
    return qc.check(reads, 27, 3, share=0.6)


@query(f"""with {ERR}, v as ({ORACLES['filter_reads']}) select verdict, count(*) as reads, sum(length(seq))::bigint as bases from v join err using (read_idx) group by verdict""")
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the read filter keeps and drops: its two outputs, counted."""
    reads = materialize(R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "seq"), "error-reads")
    kept, dropped = qc.split(reads, materialize(filter_reads(spark, sf_dir), "verdicts"))
    both = kept.select(F.lit("pass").alias("verdict"), "seq").unionByName(dropped.select("verdict", "seq"))
    return both.groupBy("verdict").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))


@query(f"with {ERR}, {_RUNS.format(t='err')}, {_homopolymer_sql('err', 51)} select read_idx from hp")
def filter_homopolymer(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = materialize(R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "seq"), "error-reads")
    return qc.homopolymer_failures(reads, reads)


@query(f"""with {READS}, c as (select c, least(count(*) filter (kmer = c), count(*) filter (kmer <> c)) as n from (select kmer, {canon('kmer')} as c from {occ('reads', 27)}) group by c)
select read_idx from {occ('reads', 27)} o join c on {canon('o.kmer')} = c.c group by read_idx having min(n) > 0""")
def filter_kmer_both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    return kmers.solid_reads(r, 27, 0, both_strands=True)


_COLUMNS = f"""{ERR}, own as (select doc_id as root, p as pos, substr(seq, p, 1) as base from (select doc_id, seq, unnest(generate_series(1, length(seq))) as p from ds)),
pl as (select read_idx // 1000000 as root, (read_idx % 1000000) * 40 + p as pos, substr(seq, p, 1) as b from (select *, unnest(generate_series(1, length(seq))) as p from err)),
cl as (select root, pos, any_value(base) as base, count(*) filter (b = 'A') as n_a, count(*) filter (b = 'C') as n_c, count(*) filter (b = 'G') as n_g, count(*) filter (b = 'T') as n_t
       from own join (select root, pos, base as b from own union all select * from pl) using (root, pos) group by root, pos),
cx as (select *, n_a + n_c + n_g + n_t as d, greatest(n_a, n_c, n_g, n_t) as top, case base when 'A' then n_a when 'C' then n_c when 'G' then n_g else n_t end as mine from cl),
cb as (select *, case top when n_a then 'A' when n_c then 'C' when n_g then 'G' else 'T' end as best, list_sort([n_a, n_c, n_g, n_t])[3] as second from cx)"""


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = materialize(R.doc_sequences(R.documents(spark, sf_dir)), "roots")
    placed = R.with_errors(R.tile_reads(d)).select(F.col("doc_id").alias("root"), (F.col("read_idx") % R.TILES * 40).cast("int").alias("offset"), "seq")
    return d.select(F.col("doc_id").alias("root"), "seq"), placed


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.counts(*_placed(spark, sf_dir))


@query(f"with {_COLUMNS} select root, pos::int as pos, base, n_a, n_c, n_g, n_t from cl")
def pileup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(spark, sf_dir)


@query(f"with {_COLUMNS} select root, string_agg(best, '' order by pos) as seq from cb group by root")
def pileup_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.consensus_of(*_placed(spark, sf_dir))


_SUMMARY = f"""{_COLUMNS}, sm as (select root, count(*) filter (best <> base and mine < 3) as wrong, count(*) filter (d > 1) as covered, sum(d)::double / count(*) as mean_depth, bool_and(mine >= 2) as supported,
bool_or(second > 5) as conflicted from cb group by root)"""


@query(f"with {_SUMMARY} select * from sm")
def pileup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.summary(_columns(spark, sf_dir))


@query(f"""with {_SUMMARY} select coalesce(sum(covered), 0)::bigint as bases_counted, coalesce(sum(wrong), 0)::bigint as bases_wrong, count(*) as n_reads, count(*) filter (wrong = 0) as n_perfect, round(avg(mean_depth), 9) as mean_depth from sm""")
def read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.totals(pileup.summary(_columns(spark, sf_dir))).withColumn("mean_depth", F.round("mean_depth", 9))


@query(f"""with {_COLUMNS} select root, pos::int as pos, round(n_a * ln(0.99) + (d - n_a) * ln(0.01), 6) as ll_a, round(n_c * ln(0.99) + (d - n_c) * ln(0.01), 6) as ll_c,
round(n_g * ln(0.99) + (d - n_g) * ln(0.01), 6) as ll_g, round(n_t * ln(0.99) + (d - n_t) * ln(0.01), 6) as ll_t from cb""")
def pileup_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _columns(spark, sf_dir)
    return c.select("root", "pos", *pileup.log_likelihoods(0.01)).select("root", "pos", *[F.round(f"ll_{b}", 6).alias(f"ll_{b}") for b in "acgt"])


@query(f"""with {READS}, a as (select 'src' as s, * from reads where source < 'src2'), b as (select * from reads where source >= 'src2'),
x as (select {canon('kmer')} as c, kmer from {occ('reads', 21)}) select c as kmer, count(*) filter (kmer = c)::bigint as n_fwd, count(*) filter (kmer <> c)::bigint as n_rc from x group by c""")
def merge_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    return kmers.merge_counts(r.filter("source < 'src2'"), r.filter("source >= 'src2'"), 21)


@query(f"""with {READS}, w as (select distinct {canon('left(seq, 31)')} as c from ds where length(seq) >= 31), h as (select distinct read_idx from {occ('reads', 31)} o join w on {canon('o.kmer')} = w.c)
select read_idx, seq from reads where read_idx in (select read_idx from h union select read_idx + case when read_idx % 2 = 0 then 1 else -1 end from h)""")
def reads_sharing_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.doc_sequences(R.documents(spark, sf_dir))
    from contigua.functions import sequence as S

    words = d.filter(F.length("seq") >= 31).select(S.canonical(F.left("seq", F.lit(31))).alias("kmer")).distinct()
    mate = F.col("read_idx") + F.when(F.col("read_idx") % 2 == 0, 1).otherwise(-1)
    return kmers.reads_with(R.tile_reads(d), words, 31, mate).select("read_idx", "seq")


_COVER = "union all ".join(f"select read_idx, {k} as k from {occ('reads', k)} o join {_BOTH('reads', k)} c on {canon('o.kmer')} = c.kmer group by read_idx having min(n) >= 3 " for k in (91, 61, 41))


@query(f"with {READS}, x as ({_COVER}) select read_idx, max(k)::int as max_k from x group by read_idx")
def max_covering_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    return kmers.max_covering_k(r, r.select("read_idx", "seq"), [91, 61, 41], 3)


@query(f"""with {READS}, a as (select * from reads where source < 'src2'), b as (select * from reads where source >= 'src2')
select read_idx, seq from a union all select read_idx + (select max(read_idx) + 1 from a), seq from b""")
def union_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir).select("read_idx", "source", "seq")
    return dedup.concatenate(r.filter("source < 'src2'"), r.filter("source >= 'src2'")).select("read_idx", "seq")


@query(f"with {READS} select read_idx, seq from reads where read_idx not in (select min(read_idx) from reads group by {canon('seq')} having count(*) > 1)")
def except_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    return dedup.without(r, dedup.firsts(r).filter("copies > 1").select(F.col("keep_idx").alias("read_idx"))).select("read_idx", "seq")


@query(f"""with {READS}, n as (select source as sample, count(*) as n from reads group by source), x as (select sample, sum(n) over (order by sample) - n as first_read, sum(n) over (order by sample) - 1 as last_read from n),
r as (select row_number() over (order by read_idx) - 1 as read_idx from reads) select r.read_idx, sample from r join x on r.read_idx between first_read and last_read""")
def sample_of_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contigua.sources import population

    r = R.derive(spark, sf_dir)
    numbered = index.global_rank(r.select(F.col("read_idx").alias("old")), "old", name="read_idx").select("read_idx")
    return population.sample_of(numbered, population.ranges(r, "source"))


_KN = "(doc_id % 7)::int as k, (10 + doc_id % 13)::int as n, (1 + doc_id % 5)::int as a, (2 + doc_id % 3)::int as b, (1 + doc_id % 9) / 10.0::double as p"
_LF = lambda x: f"lgamma(({x}) + 1)"
_LC = f"({_LF('n')} - {_LF('k')} - {_LF('n - k')})"
_LB = lambda a, b: f"({_LF(f'{a} - 1')} + {_LF(f'{b} - 1')} - {_LF(f'{a} + {b} - 1')})"


@query(f"""with x as (select doc_id, {_KN} from documents) select doc_id, round(k * ln(p * 10) - p * 10 - {_LF('k')}, 6) as log_poisson, round({_LC} + k * ln(p) + (n - k) * ln(1 - p), 6) as log_binomial,
round((a - 1) * ln(p) + (b - 1) * ln(1 - p) - {_LB('a', 'b')}, 6) as log_beta, round({_LC} + {_LB('k + a', 'n - k + b')} - {_LB('a', 'b')}, 6) as log_beta_binomial from x""")
def log_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    x = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (i % 7).alias("k"), (10 + i % 13).alias("n"), (1 + i % 5).alias("a"), (2 + i % 3).alias("b"), ((1 + i % 9) / F.lit(10.0)).alias("p"))
    k, n, a, b, p = (F.col(c) for c in "knabp")
    return x.select(
        "doc_id", F.round(D.log_poisson(k, p * 10), 6).alias("log_poisson"), F.round(D.log_binomial(k, n, p), 6).alias("log_binomial"),
        F.round(D.log_beta(p, a, b), 6).alias("log_beta"), F.round(D.log_beta_binomial(k, n, a, b), 6).alias("log_beta_binomial"),
    )


_MATCH = """select read_idx, (read_idx % 20)::int as s1, (60 + read_idx % 30)::int as e1, 100 as l1, (read_idx % 7)::int as s2, (60 + read_idx % 30 - read_idx % 20 + read_idx % 7)::int as e2, 95 as l2,
(read_idx % 20 + 5)::int as s3, (55 + read_idx % 30)::int as e3, (read_idx % 2 = 1) as rc from reads"""


@query(f"""with {READS}, m as ({_MATCH}), t as (select *, case when rc then l2 - 1 - e2 else s2 end - s1 as shift from m),
x as (select *, s3 + shift as ts, e3 + shift as te, least(s1, case when rc then l2 - 1 - e2 else s2 end) as gl, least(l1 - 1 - e1, l2 - 1 - case when rc then l2 - 1 - s2 else e2 end) as gr from t)
select read_idx, (l1 - 1 - e1)::int as flip_start, (l1 - 1 - s1)::int as flip_end, case when s1 = 0 then e1 + 1 when e1 = l1 - 1 then 0 else 0 end::int as rest_start, case when s1 = 0 then l1 - 1 else s1 - 1 end::int as rest_end,
case when rc then l2 - 1 - te else ts end::int as to_start, case when rc then l2 - 1 - ts else te end::int as to_end,
(s1 - gl)::int as grown_start, (e1 + gr)::int as grown_end, case when rc then s2 - gr else s2 - gl end::int as grown2_start, case when rc then e2 + gl else e2 + gr end::int as grown2_end,
case when least(e1, e3) > greatest(s1, s3) then greatest(s1, s3) else 0 end::int as meet_start, case when least(e1, e3) > greatest(s1, s3) then least(e1, e3) else 0 end::int as meet_end from x""")
def match_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("read_idx")
    m = R.derive(spark, sf_dir).select("read_idx", C.coord(i % 20, 60 + i % 30, F.lit(100)).alias("c1"), C.coord(i % 7, 60 + i % 30 - i % 20 + i % 7, F.lit(95)).alias("c2"), C.coord(i % 20 + 5, 55 + i % 30, F.lit(100)).alias("c3"), (i % 2 == 1).alias("rc"))
    c1, c2, c3, turned = F.col("c1"), F.col("c2"), F.col("c3"), F.col("rc")
    grown = C.expand(c1, c2, turned)
    parts = {"flip": C.flip(c1), "rest": C.complement(c1), "to": C.translate(c3, c1, c2, turned), "grown": grown[0], "grown2": grown[1], "meet": C.intersect(c1, c3)}
    return m.select("read_idx", *[v[f].cast("int").alias(f"{n}_{f}") for n, v in parts.items() for f in ("start", "end")])


@query(f"""with {READS}, a as (select doc_id, seq as s1, lead(seq) over (partition by doc_id order by read_idx) as s2 from reads), b as (select * from a where s2 is not null)
select doc_id, sum(len(list_filter(generate_series(1, 60), lambda i: substr(s1, 41 + i - 1, 1) <> substr(s2, i, 1))))::bigint as straight,
sum(len(list_filter(generate_series(1, 60), lambda i: substr(s1, 41 + i - 1, 1) <> substr({rc('substr(s2, 1, 60)')}, i, 1))))::bigint as turned from b group by doc_id""")
def match_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    pairs = r.select("read_idx", "doc_id", F.col("seq").alias("s1")).join(r.select((F.col("read_idx") - 1).alias("read_idx"), F.col("seq").alias("s2")), "read_idx")
    c = lambda a, b: C.coord(F.lit(a), F.lit(b), F.lit(100))
    n = lambda turned: C.differences(F.col("s1"), F.col("s2"), c(40, 99), c(0, 59), F.lit(turned))
    return pairs.groupBy("doc_id").agg(F.sum(n(False)).alias("straight"), F.sum(n(True)).alias("turned"))


@query(f"""with {READS}, c as {_BOTH('reads', 31)}, h as (select n, sum(n) as kmers from c group by n), d as (select i as n, coalesce(kmers, 0) as kmers from generate_series(1, 10000) t(i) left join h on i = h.n),
l as (select coalesce(min(n), 10000) as low from (select n, kmers, lead(kmers) over (order by n) as after from d) where after > kmers), p as (select n, kmers from d, l where n >= low and n < 10000 order by kmers desc, n limit 1)
select p.n::bigint as highest, (case when p.kmers * 0.5 < coalesce((select kmers from h where h.n = 2 * p.n), 0) then 2 * p.n else p.n end)::bigint as single_copy from p""")
def single_copy_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = kmers.count_levels(R.derive(spark, sf_dir), 31)
    return preqc.single_copy_peak(levels.select("n", (F.col("n") * F.col("kmers")).alias("kmers")))
