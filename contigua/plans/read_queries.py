"""Queries on reads, k-mers, duplicates and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.functions import sequence as S
from contigua.operators import dedup, kmers, overlap
from contigua.operators import reads as R
from contigua.plans.registry import DS, ERR, READS, canon, occ, query, rc
from contigua.runtime import materialize


@query(f"with {READS} select read_idx, doc_id, source, seq from reads")
def reads_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.derive(spark, sf_dir)


@query(f"with {ERR} select read_idx, seq, qual from err")
def reads_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "seq", "qual")


@query(f"""with {DS} select doc_id, {rc('seq')} as rc, translate(seq, 'ACGT', 'TGCA') as comp, {canon('seq')} as canonical,
left(seq, 10) as prefix10, right(seq, 10) as suffix10,
length(translate(seq, 'AT', ''))::double / nullif(length(seq), 0) as gc from ds""")
def sequence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    d = R.doc_sequences(R.documents(spark, sf_dir))
    return d.select("doc_id", S.reverse_complement(s).alias("rc"), S.complement(s).alias("comp"), S.canonical(s).alias("canonical"), S.prefix(s, 10).alias("prefix10"), S.suffix(s, 10).alias("suffix10"), S.gc_fraction(s).alias("gc"))


_TRIM = """
qs as (select read_idx, p, 20 - (ascii(substr(qual, p, 1)) - 33) as short from (select read_idx, qual, unnest(generate_series(1, length(qual))) as p from err)),
ss as (select read_idx, p, short, sum(short) over (partition by read_idx order by p desc) as s, max(p) over (partition by read_idx) as n from qs),
best as (select read_idx, max(s) as m from ss group by read_idx),
cut as (select ss.read_idx, case when bool_or(p = n and short <= 0) then max(n) else max(case when s = m then p end) - 1 end as keep
        from ss join best using (read_idx) group by ss.read_idx),
trimmed as (select read_idx, substr(seq, 1, keep::bigint) as seq, substr(qual, 1, keep::bigint) as qual from err join cut using (read_idx)),
tri as (select read_idx, substr(seq, p, 3) as m, count(*) as c from (select read_idx, seq, unnest(generate_series(1, length(seq) - 3)) as p from trimmed where length(seq) > 3) group by all),
du as (select read_idx, sum(c * (c - 1) / 2) as d from tri group by read_idx),
pp as (select t.read_idx, t.seq, t.qual from trimmed t left join du using (read_idx)
       where length(seq) >= 40 and coalesce(d, 0) / (length(seq) - 2) < 4.0
       and len(list_filter(string_split(qual, ''), lambda x: ascii(x) - 33 <= 3)) <= 9
       and length(translate(seq, 'AT', ''))::double / length(seq) between 0.2 and 0.8
       and not contains('AATGATACGGCGACCACCGAGATCTACA', left(seq, 14)) and not contains('GATCGGAAGAGCGGTTCAGCAGGAATGC', left(seq, 14)))"""


def _preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.preprocess(R.with_errors(R.derive(spark, sf_dir)), quality_trim=20, quality_filter=9, min_gc=0.2, max_gc=0.8)


@query(f"with {ERR}, {_TRIM} select read_idx, seq, qual from pp")
def preprocess_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preprocessed(spark, sf_dir).select("read_idx", "seq", "qual")


@query(f"with {ERR} select read_idx, substr(seq, 1, 60) as seq, substr(qual, 1, 60) as qual from err")
def hard_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads cut down to their first 60 bases."""
    r = R.with_errors(R.derive(spark, sf_dir))
    return R.preprocess(r, hard_clip=60, dust_threshold=None, primer_check=False).select("read_idx", "seq", "qual")


@query(f"""with {ERR} select a.read_idx, levenshtein(a.seq, b.seq)::int as to_next from err a join err b on b.read_idx = a.read_idx + 1""")
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between every read and the next tile of its document."""
    from contigua.operators import align
    from contigua.runtime import ship

    ship(spark)
    r = R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "seq")
    then = r.select((F.col("read_idx") - 1).alias("read_idx"), F.col("seq").alias("then"))
    return r.join(then, "read_idx").select("read_idx", align.edit_distance_udf("seq", "then").alias("to_next"))


@query(f"""with {ERR}, {_TRIM},
m as (select r.read_idx, r.read_idx // 2 as pair_id, (pp.read_idx is not null)::int as kept from reads r left join pp using (read_idx)),
b as (select pair_id, sum(kept) as n, count(*) as of_all from m group by pair_id)
select read_idx, case when n = 2 and of_all = 2 then 'pair' when kept = 1 then 'orphan' else 'lost' end as status from m join b using (pair_id)""")
def preprocess_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = R.derive(spark, sf_dir).select("read_idx", F.floor(F.col("read_idx") / 2).alias("pair_id"))
    return R.pair_rule(pairs, _preprocessed(spark, sf_dir))


@query(f"""with {READS} select read_idx from reads where greatest(length(seq) - length(replace(seq, 'A', '')), length(seq) - length(replace(seq, 'C', '')),
length(seq) - length(replace(seq, 'G', '')), length(seq) - length(replace(seq, 'T', ''))) > 0.6 * length(seq)""")
def filter_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.degenerate(R.derive(spark, sf_dir), 0.6).select("read_idx")


@query(f"""with {READS}, o as {occ('reads', 27)}, c as (select {canon('kmer')} as c, kmer from o)
select c as kmer, count(*) filter (kmer = c)::bigint as n_fwd, count(*) filter (kmer <> c)::bigint as n_rc from c where c <> {rc('c')} group by c""")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.kmer_count(R.derive(spark, sf_dir), 27)


@query(f"""with {READS}, ra as (select * from reads where source < 'src2'), rb as (select * from reads where source >= 'src2'),
oa as (select {canon('kmer')} as c, kmer from {occ('ra', 27)}), ob as (select {canon('kmer')} as c, kmer from {occ('rb', 27)}),
a as (select c, count(*) filter (kmer = c) as n_fwd, count(*) filter (kmer <> c) as n_rc from oa where c <> {rc('c')} group by c),
b as (select c, count(*) filter (kmer = c) as n_fwd, count(*) filter (kmer <> c) as n_rc from ob group by c)
select c as kmer, a.n_fwd::bigint as n_fwd, a.n_rc::bigint as n_rc, coalesce(b.n_fwd, 0)::bigint as n_fwd_b, coalesce(b.n_rc, 0)::bigint as n_rc_b from a left join b using (c)""")
def kmer_count_two_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    return kmers.kmer_count(r.filter("source < 'src2'"), 27, {"b": r.filter("source >= 'src2'")})


_BOTH = lambda t, k: f"(select c as kmer, count(*) * case when c = {rc('c')} then 2 else 1 end as n from (select {canon('kmer')} as c from {occ(t, k)}) group by c)"


@query(f"""with {READS}, ra as (select * from reads where source < 'src2'), c as {_BOTH('reads', 31)}, d as {_BOTH('ra', 31)}
select read_idx, p::int as pos, o.kmer, coalesce(c.n, 0)::bigint as n_all, coalesce(d.n, 0)::bigint as n_a
from {occ('reads', 31)} o left join c on {canon('o.kmer')} = c.kmer left join d on {canon('o.kmer')} = d.kmer""")
def kmer_count_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    return kmers.position_counts(r, {"all": r, "a": r.filter("source < 'src2'")}, 31)


@query(f"with {READS}, c as {_BOTH('reads', 21)} select n::bigint as n, count(*)::bigint as kmers from c group by n")
def kmer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count_levels(R.derive(spark, sf_dir), 21)


_HIST = f"{READS}, c as {_BOTH('reads', 21)}, h as (select n, count(*) as kmers from c where n <= 1000 group by n), d as (select i as n, coalesce(kmers, 0) as kmers from generate_series(0, 1000) t(i) left join h on i = h.n)"


@query(f"with {_HIST} select n::bigint as n, kmers::bigint as kmers, sum(kmers) over (order by n)::double / sum(kmers) over () as proportion_leq from d")
def kmer_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.cumulative(kmers.count_levels(R.derive(spark, sf_dir), 21))


@query(f"""with {_HIST}, mode as (select n as mode from d where n >= 5 order by kmers desc, n limit 1), top as (select max(n) as top, sum(kmers) as total from h),
x as (select n, kmers, lag(kmers) over (order by n) as before, lead(kmers) over (order by n) as after, sum(kmers) over (order by n) as upto,
      sum(case when n >= 1 then kmers end) over (order by n) as upto1 from d)
select (select coalesce(min(n), -1) from x, top where n >= 2 and before > 0 and kmers::double / before > 0.75 and n <= top)::bigint as first_local_minimum,
(select mode from mode)::bigint as mode,
(select coalesce(arg_min(n, row(kmers::double / upto1, n)), -1) from x, mode where n >= 1 and n < mode and upto1 > 0)::bigint as error_boundary,
(select coalesce(min(n), -1) from x, mode where n >= 1 and n < mode - 1 and after > 0 and kmers::double / after < 2.0)::bigint as boundary_by_ratio,
(select coalesce(min(n), 1000) from x, top where upto::double / total > 0.95)::bigint as cutoff""")
def kmer_distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.distribution_summary(kmers.count_levels(R.derive(spark, sf_dir), 21))


@query(f"""with {READS}, c as {_BOTH('reads', 27)}
select read_idx from {occ('reads', 27)} o join c on {canon('o.kmer')} = c.kmer group by read_idx having min(n) > 3""")
def filter_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    return kmers.solid_reads(r, 27, 3)


@query(f"""with {READS}, c as {_BOTH('reads', 41)} select read_idx, list(least(n, 20)::bigint order by p) as profile
from {occ('reads', 41)} o join c on {canon('o.kmer')} = c.kmer group by read_idx""")
def kmer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    return kmers.own_profile(r, 41, 20)


@query(f"""with {READS}, c as {_BOTH('reads', 25)}, o as (select kmer as o, n from c union all select {rc('kmer')}, n from c where kmer <> {rc('kmer')})
select left(o, 24) as vertex, sum(case when right(o, 1) = 'A' then n else 0 end)::bigint as n_a, sum(case when right(o, 1) = 'C' then n else 0 end)::bigint as n_c,
sum(case when right(o, 1) = 'G' then n else 0 end)::bigint as n_g, sum(case when right(o, 1) = 'T' then n else 0 end)::bigint as n_t from o group by 1""")
def de_bruijn_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.next_bases(R.derive(spark, sf_dir), 25)


@query(f"""with {READS}, c as (select *, {canon('seq')} as c from reads)
select read_idx, min(read_idx) over (partition by c) as keep_idx, count(*) over (partition by c) as copies from c""")
def duplicate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicates(R.derive(spark, sf_dir))


_UNIQ = f"{READS}, u as materialized (select read_idx, doc_id, source, seq, copies from (select *, row_number() over (partition by {canon('seq')} order by read_idx) as r, count(*) over (partition by {canon('seq')}) as copies from reads) where r = 1)"


@query(f"with {_UNIQ} select read_idx, seq, copies from u")
def rmdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.remove_duplicates(R.derive(spark, sf_dir)).select("read_idx", "seq", "copies")


@query(f"""with {READS} select read_idx from (select *, row_number() over (partition by {canon('seq')} order by cast(read_idx as varchar)) as r from reads) where r = 1""")
def rmdup_decimal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.remove_duplicates(R.derive(spark, sf_dir), by_decimal_string=True).select("read_idx")


@query(f"""with {ERR}, {_TRIM}, one as (select distinct {canon('seq')} as seq from pp),
l as (select seq as long, substr(seq, p, 40) as w, p from (select seq, unnest(generate_series(1, length(seq) - 39)) as p from one)),
b as (select seq, seq as o from one union all select seq, {rc('seq')} from one),
f as (select distinct b.seq from b join l on left(b.o, 40) = l.w and length(l.long) > length(b.seq) and substr(l.long, l.p, length(b.seq)) = b.o)
select read_idx from pp where {canon('seq')} in (select seq from f)""")
def contained_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.contained(_preprocessed(spark, sf_dir), 40)


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.remove_duplicates(R.derive(spark, sf_dir)).select("read_idx", "seq")


def unique_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a written table."""
    return materialize(_unique(spark, sf_dir), "unique-reads", tidy=True)


_OVL = f"""{_UNIQ}, o as materialized (select read_idx as id, 0 as st, seq from u union all select read_idx, 1, {rc('seq')} from u),
hd as (select id as y, st as ys, seq as t, left(seq, 45) as w from o),
tl as (select id as x, st as xs, substr(seq, p) as tail, substr(seq, p, 45) as w from (select *, unnest(generate_series(2, length(seq) - 44)) as p from o)),
ov as materialized (select x, xs, y, ys, max(length(tail)) as ov from tl join hd using (w) where x <> y and length(t) > length(tail) and left(t, length(tail)) = tail group by all)"""


@query(f"with {_OVL} select x, xs, y, ys, ov::int as ov from ov")
def overlap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.exact_overlaps(unique_reads(spark, sf_dir))


_IRR = f"""{_OVL}, e as materialized (select x, xs, y, ys, 100 - ov as lab from ov),
cmp as materialized (select distinct c.x, c.xs, c.y, c.ys from e a join e b on a.y = b.x and a.ys = b.xs
       join e c on c.x = a.x and c.xs = a.xs and c.y = b.y and c.ys = b.ys and c.lab = a.lab + b.lab),
irr as materialized (select * from e anti join cmp using (x, xs, y, ys))"""


@query(f"with {_IRR} select x, xs, y, ys, lab::int as lab from irr")
def overlap_irreducible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.irreducible(materialize(overlap.exact_overlaps(unique_reads(spark, sf_dir)), "overlaps", tidy=True), 100)


@query(f"""with {ERR}, {_TRIM}, u1 as materialized (select read_idx, seq from (select *, row_number() over (partition by {canon('seq')} order by read_idx) as r from pp) where r = 1),
w1 as materialized (select seq, p, substr(seq, p, 31) as k from (select seq, unnest(generate_series(1, length(seq) - 30)) as p from u1)), h1 as materialized (select read_idx, seq as o from u1 union all select read_idx, {rc('seq')} from u1),
ct as materialized (select distinct read_idx from h1 join w1 on left(o, 31) = k and length(w1.seq) > length(o) and substr(w1.seq, p, length(o)) = o), u as materialized (select * from u1 anti join ct using (read_idx)),
o as materialized (select read_idx as id, 0 as st, seq from u union all select read_idx, 1, {rc('seq')} from u),
hd as materialized (select id as y, st as ys, seq as t, left(seq, 45) as w from o where length(seq) >= 45),
tl as materialized (select id as x, st as xs, substr(seq, p) as tail, substr(seq, p, 45) as w from (select *, unnest(generate_series(2, length(seq) - 44)) as p from o where length(seq) > 45)),
e as materialized (select x, xs, y, ys, any_value(length(t)) - max(length(tail)) as lab from tl join hd using (w) where x <> y and length(t) > length(tail) and left(t, length(tail)) = tail group by x, xs, y, ys),
cmp as materialized (select distinct c.x, c.xs, c.y, c.ys from e a join e b on a.y = b.x and a.ys = b.xs join e c on c.x = a.x and c.xs = a.xs and c.y = b.y and c.ys = b.ys and c.lab = a.lab + b.lab)
select x, xs, y, ys, lab::int as lab from e anti join cmp using (x, xs, y, ys)""")
def overlap_irreducible_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irreducible overlaps of trimmed reads, whose lengths differ."""
    reads = materialize(dedup.remove_duplicates(_preprocessed(spark, sf_dir).select("read_idx", "seq")), "trimmed-reads", tidy=True)
    return overlap.irreducible(materialize(overlap.exact_overlaps(reads), "overlaps", tidy=True), reads.select(F.col("read_idx").alias("id"), F.length("seq").alias("n")))


@query(f"""with {_UNIQ}, occs as (select distinct read_idx, {canon('kmer')} as c from {occ('u', 61)}),
cold as (select c from occs group by c having count(*) between 2 and 200), w as (select * from occs semi join cold using (c))
select a.read_idx as x, b.read_idx as y, count(*)::bigint as shared from w a join w b on a.c = b.c and a.read_idx < b.read_idx group by all""")
def overlap_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.shared_kmer_pairs(unique_reads(spark, sf_dir), 61)


@query(f"""with {_UNIQ}, o as (select read_idx as id, seq from u union all select read_idx, {rc('seq')} from u),
t as (select doc_id as target, seq as long, substr(seq, p, 31) as w, p from (select *, unnest(generate_series(1, length(seq) - 30)) as p from ds)),
h as (select id, min(target) as a, max(target) as b from o join t on left(o.seq, 31) = t.w and substr(t.long, t.p, length(o.seq)) = o.seq group by id)
select u.read_idx, case when a is null then '-' when a = b then cast(a as varchar) else 'MM' end as placed from u left join h on u.read_idx = h.id""")
def gmap_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.doc_sequences(R.documents(spark, sf_dir))
    return overlap.place(_unique(spark, sf_dir), docs.select(F.col("doc_id").alias("target"), "seq"))
