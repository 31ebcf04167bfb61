"""Queries on read-set statistics, scaffold links and variant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.operators import alignments, kmers, preqc, scaffold, variants
from contigua.operators import reads as R
from contigua.plans.read_queries import _BOTH
from contigua.plans.registry import DS, ERR, READS, canon, occ, query
from contigua.runtime import materialize


@query(f"""with {ERR} select p::int as pos, count(*)::bigint as n, avg(q) as mean_quality, avg((q >= 30)::int) as fraction_q30
from (select p, ascii(substr(qual, p, 1)) - 33 as q from (select qual, unnest(generate_series(1, length(qual))) as p from err)) group by p""")
def preqc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preqc.quality_by_position(R.with_errors(R.derive(spark, sf_dir)))


@query(f"""with {READS}, c as {_BOTH('reads', 31)}, f as (select floor(length(translate(seq, 'AT', ''))::double / length(seq) / 0.05 + 1e-9)::bigint as bin, {canon('left(seq, 31)')} as kmer from reads)
select bin, count(*)::bigint as reads, avg(n) as mean_coverage from f join c using (kmer) group by bin""")
def preqc_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    return preqc.gc_distribution(r)


@query(f"""with {ERR}, c as {_BOTH('err', 31)}, l as (select read_idx, p, n from {occ('err', 31)} o join c on {canon('o.kmer')} = c.kmer),
f as (select read_idx, min(case when n < 2 then p end) as pos, max(case when p = 1 then n end) as first from l group by read_idx)
select pos::int as pos, count(*)::bigint as reads from f where first >= 2 and pos is not null group by pos""")
def preqc_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = materialize(R.with_errors(R.derive(spark, sf_dir)), "error-reads")
    return preqc.own_first_error(r, 31, 2, 2)


@query(f"""with {READS}, pr as (select a.seq as seq1, b.seq as seq2 from reads a join reads b on a.read_idx % 2 = 0 and b.read_idx = a.read_idx + 1),
g as (select count(*) as c from pr group by least(left(seq1, 50), left(seq2, 50)), greatest(left(seq1, 50), left(seq2, 50)))
select sum(c)::bigint as pairs, sum(c - 1)::bigint as duplicates from g""")
def preqc_pcr_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir).select("read_idx", "seq")
    a = r.filter("read_idx % 2 = 0").select("read_idx", F.col("seq").alias("seq1"))
    return preqc.pair_duplicates(a.join(r.select((F.col("read_idx") - 1).alias("read_idx"), F.col("seq").alias("seq2")), "read_idx"))


@query(f"""with {READS}, c as {_BOTH('reads', 25)}, o as (select kmer as o, n from c union all select reverse(translate(kmer, 'ACGT', 'TGCA')), n from c where kmer <> reverse(translate(kmer, 'ACGT', 'TGCA'))),
v as (select left(o, 24) as v, sum(n) as n from o group by left(o, 24), right(o, 1)), m as (select v, n, max(n) over (partition by v) as top from v)
select b::int as branches, count(*)::bigint as vertices from (select v, count(*) filter (n >= 2 and n >= 0.25 * top) as b from m group by v) group by b""")
def preqc_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preqc.branch_ratio(kmers.next_bases(R.derive(spark, sf_dir), 25))


@query()
def preqc_genome_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    hist = [(x["n"], x["n"] * x["kmers"]) for x in kmers.count_levels(r, 31).collect()]  # one row a count level
    n, mean = r.agg(F.count("*"), F.avg(F.length("seq"))).first()
    return spark.createDataFrame([(31, n, float(preqc.genome_size(n, mean or 0.0, 31, hist)))], "k int, reads long, genome_size double")


_LINKS = """ct as (select doc_id as id, length(seq) as len, 1 + (doc_id * 13) % 40 as n from ds),
lk as (select doc_id as x, 0 as xs, doc_id + o as y, 0 as ys, ((doc_id * 37 + o * 211) % 600 - 100)::double as dist, (10 + doc_id % 7 + o)::double as sd, 3 + doc_id % 5 as n_pairs
       from ds, (select unnest([1, 2, 3]) as o) where doc_id + o in (select doc_id from ds)),
tw as (select * from lk union all select y, 1 - ys, x, 1 - xs, dist, sd, n_pairs from lk)"""


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.doc_sequences(R.documents(spark, sf_dir))
    return d.select(F.col("doc_id").alias("id"), F.length("seq").alias("len"), (1 + (F.col("doc_id") * 13) % 40).alias("n"), "seq")


def _links(contigs: DataFrame) -> DataFrame:
    i, o = F.col("id"), F.col("o")
    x = contigs.select("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("o"))
    x = x.select(i.alias("x"), F.lit(0).alias("xs"), (i + o).alias("y"), F.lit(0).alias("ys"), ((i * 37 + o * 211) % 600 - 100).cast("double").alias("dist"), (10 + i % 7 + o).cast("double").alias("sd"), (3 + i % 5).alias("n_pairs"))
    return x.join(contigs.select(i.alias("y")), "y", "left_semi").select("x", "xs", "y", "ys", "dist", "sd", "n_pairs")


_ASTAT = """r0 as (select sum(n)::double / sum(len) as r from (select n, len from ct order by len desc, id limit 20)),
r1 as (select coalesce((select sum(n)::double / sum(len) from ct where r0.r * len - n * ln(2) > 30), r0.r) as r from r0),
r2 as (select coalesce((select sum(n)::double / sum(len) from ct where r1.r * len - n * ln(2) > 30), r1.r) as r from r1),
r3 as (select coalesce((select sum(n)::double / sum(len) from ct where r2.r * len - n * ln(2) > 30), r2.r) as r from r2),
ast as (select id, len, n, n / (r * len) as copy_number, r * len - n * ln(2) as a_stat from ct, r3)"""


@query(f"with {DS}, {_LINKS}, {_ASTAT} select id, len::int as len, n::bigint as n, copy_number, a_stat from ast")
def scaffold_a_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.a_statistic(_contigs(spark, sf_dir))


@query(f"with {DS}, {_LINKS}, {_ASTAT} select id, case when copy_number < 0.3 then 'low_copy' when a_stat > 20 then 'unique' else 'repeat' end as class from ast")
def scaffold_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.classify(scaffold.a_statistic(_contigs(spark, sf_dir)))


@query(f"""with {DS}, l as (select length(seq) as len from ds), c as (select len, sum(len) over (order by len desc) as run, sum(len) over () as total from l)
select max(len)::int as n50 from c where run * 2 > total""")
def scaffold_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.n50(_contigs(spark, sf_dir))


@query(f"""with {DS}, l as (select length(seq) as len from ds), c as (select len, sum(len) over (order by len desc) as run, sum(len) over () as total from l)
select max(len)::int as n50 from c where run * 2 >= total""")
def report_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.n50(_contigs(spark, sf_dir), strict=False)


@query(f"""with {DS}, {_LINKS}, es as (select x, xs, y, ys, dist, sd, n_pairs from lk union all select y, 1 - ys, x, 1 - xs, dist + (x % 4) * 60, sd + 1, n_pairs from lk),
nm as (select case when f then y else x end as x, case when f then 1 - ys else xs end as xs, case when f then x else y end as y, case when f then 1 - xs else ys end as ys, dist, sd, n_pairs
       from (select *, x > y or (x = y and xs > 1 - ys) as f from es))
select x, xs, y, ys, arg_min(dist, row(sd, dist)) as dist, min(sd) as sd, sum(n_pairs)::bigint as n_pairs, max(dist) - min(dist) > 100 as conflict from nm group by x, xs, y, ys""")
def scaffold_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lk = _links(_contigs(spark, sf_dir))
    back = lk.select(F.col("y").alias("x"), (1 - F.col("ys")).alias("xs"), F.col("x").alias("y"), (1 - F.col("xs")).alias("ys"), (F.col("dist") + (F.col("x") % 4) * 60).alias("dist"), (F.col("sd") + 1).alias("sd"), "n_pairs")
    return scaffold.symmetric_links(lk.unionByName(back))


@query(f"""with {DS}, {_LINKS}, pl as (select x, xs, y, dist as s, dist + len - 1 as e from tw join ct on y = id)
select a.x, a.xs, max(least(a.e, b.e) - greatest(a.s, b.s) + 1) as overlap from pl a join pl b on a.x = b.x and a.xs = b.xs and a.y < b.y group by all having max(least(a.e, b.e) - greatest(a.s, b.s) + 1) >= 400""")
def scaffold_overlapping_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contigs(spark, sf_dir)
    return scaffold.overlapping_sides(scaffold.twins(_links(c)), c.select("id", "len"))


@query(f"""with {DS}, {_LINKS}, f as (select *, row_number() over (partition by x, xs order by dist, n_pairs desc, y, ys) as r from tw), g as (select * from f where r = 1)
select x, xs, y, ys, dist, sd, n_pairs::bigint as n_pairs from g semi join (select y as x, 1 - ys as xs, x as y, 1 - xs as ys from g) b using (x, xs, y, ys)""")
def scaffold_best_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.best_next(scaffold.twins(_links(_contigs(spark, sf_dir))))


#: The error function's complement, for z >= 0, as a rational approximation of fixed coefficients.
_TAIL = """0.5 * (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-w * w)"""


@query(f"""with {DS}, {_LINKS}, {_ASTAT}, wd as materialized (select x, xs, y, dist, sd * 20 as sd from tw),
pr as (select a.y as a, b.y as b, (b.dist - a.dist) / sqrt(a.sd * a.sd + b.sd * b.sd) / sqrt(2) as w from wd a join wd b on a.x = b.x and a.xs = b.xs and (a.dist < b.dist or (a.dist = b.dist and a.y < b.y))),
am as (select a, b from (select *, 1 / (1 + 0.3275911 * w) as t from pr) where {_TAIL} > 0.01)
select distinct case when ca.copy_number < cb.copy_number or (ca.copy_number = cb.copy_number and a > b) then a else b end as id
from am join ast ca on a = ca.id join ast cb on b = cb.id where ca.copy_number + cb.copy_number < 3.0""")
def scaffold_polymorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contigs(spark, sf_dir)
    wide = _links(c).withColumn("sd", F.col("sd") * 20)
    return scaffold.polymorphic(scaffold.twins(wide), scaffold.a_statistic(c), most_copies=3.0)


@query(f"""with {DS}, {_LINKS}, o as (select id // 4 as scaffold, id, row_number() over (partition by id // 4 order by id) as ord, seq from ct join ds on id = doc_id),
g as (select o.*, case when lead(id) over (partition by scaffold order by ord) is not null then (id * 53) % 300 end as gap from o)
select scaffold, string_agg(seq || repeat('N', (case when gap is null then 0 else greatest(gap, 25) end)::bigint), '' order by ord) as seq from g group by scaffold""")
def scaffold_to_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window as W

    c = _contigs(spark, sf_dir).select(F.floor(F.col("id") / 4).alias("scaffold"), "id", "seq")
    w = W.partitionBy("scaffold").orderBy("id")
    placed = c.select("scaffold", F.row_number().over(w).alias("ord"), "seq", F.when(F.lead("id").over(w).isNotNull(), ((F.col("id") * 53) % 300).cast("double")).alias("dist"))
    return scaffold.layout(placed)


_VAR = """v as (select l_orderkey * 8 + l_linenumber as row_no, l_suppkey % 20 as chrom, l_partkey * 11 + l_linenumber * 3 as pos,
substr('ACGTACGT', (1 + l_orderkey % 4)::bigint, (1 + l_linenumber % 3)::bigint) as ref, substr('ACGTACGT', (1 + l_partkey % 4)::bigint, (1 + l_suppkey % 3)::bigint) as alt,
l_extendedprice as qual, l_returnflag, l_quantity, l_discount, l_tax, l_orderkey, l_linenumber from lineitem)"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    sub = lambda i, n: F.substring(F.lit("ACGTACGT"), (1 + i % 4).cast("int"), (1 + n % 3).cast("int"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("row_no"), (c("l_suppkey") % 20).alias("chrom"), (c("l_partkey") * 11 + c("l_linenumber") * 3).alias("pos"),
        sub(c("l_orderkey"), c("l_linenumber")).alias("ref"), sub(c("l_partkey"), c("l_suppkey")).alias("alt"), c("l_extendedprice").alias("qual"),
        "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_orderkey", "l_linenumber",
    )


@query(f"""with {_VAR} select row_no, case when length(ref) = length(alt) then 'SUB' when length(ref) > length(alt) and starts_with(ref, alt) then 'DEL'
when length(ref) < length(alt) and starts_with(alt, ref) then 'INS' else 'COMPLEX' end as class from v""")
def vcf_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("row_no", variants.variant_class(F.col("ref"), F.col("alt")).alias("class"))


@query(f"with {_VAR} select row_no, chrom, pos, ref, alt from (select *, row_number() over (partition by chrom, pos, ref, alt order by row_no) as r from v) where r = 1")
def vcf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.first_of_each(_variants(spark, sf_dir), "row_no").select("row_no", "chrom", "pos", "ref", "alt")


@query(f"""with {_VAR}, a as (select chrom, pos from v where l_returnflag = 'R'), b as (select chrom, pos from v where l_returnflag = 'A')
select a.chrom, a.pos as pos_a, b.pos as pos_b from a join b on a.chrom = b.chrom and abs(a.pos - b.pos) < 7""")
def vcf_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _variants(spark, sf_dir)
    return variants.near_variants(v.filter("l_returnflag = 'R'"), v.filter("l_returnflag = 'A'"), 7)


@query(f"""with {_VAR}, a as (select chrom, pos, ref, alt, qual from v where l_returnflag = 'R' and l_quantity > 10), b as (select chrom, pos, qual as base_qual from v where l_returnflag = 'N' and l_quantity <= 25)
select chrom, pos, ref, alt, qual, base_qual from a join b using (chrom, pos)""")
def vcf_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _variants(spark, sf_dir)
    a = v.filter("l_returnflag = 'R'").withColumn("filter", F.when(F.col("l_quantity") > 10, "PASS").otherwise("LowQuality"))
    b = v.filter("l_returnflag = 'N'").withColumn("filter", F.when(F.col("l_quantity") <= 25, "NoCall").otherwise("PASS"))
    return variants.contrast_calls(a, b).select("chrom", "pos", "ref", "alt", "qual", "base_qual")


@query(f"""with {_VAR}, m as (select row_no, (l_orderkey % 12) as homopolymer, l_discount * 40 as dust, l_tax * 10 as af, l_quantity as var_dp, l_linenumber * 50 as hap_len, l_discount * 30 as strand_bias,
l_linenumber % 3 as normal_var_reads, l_quantity as normal_depth, l_quantity as median_quality, l_tax * 8 as zero_quality_share, l_quantity as mapping_quality, l_quantity * 10 as depth from v)
select row_no, case when f = '' then 'PASS' else f end as filter from (select row_no, concat_ws(';', case when homopolymer > 7 then 'Homopolymer' end, case when dust >= 2.0 then 'LowComplexity' end,
case when af < 0.1 then 'LowAlleleFrequency' end, case when var_dp < 5 then 'LowVarDP' end, case when hap_len < 100 then 'ShortHaplotype' end, case when strand_bias >= 2.0 then 'StrandBias' end,
case when normal_var_reads > 1 then 'NormalEvidence' end, case when normal_depth < 5 then 'LowNormalDepth' end, case when median_quality < 15 then 'LowQuality' end,
case when zero_quality_share > 0.5 then 'PossibleError' end, case when mapping_quality < 10 then 'LowMappingQuality' end, case when depth >= 450 then 'DepthLimitReached' end) as f from m)""")
def vcf_somatic_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    m = _variants(spark, sf_dir).select(
        "row_no", (c("l_orderkey") % 12).alias("homopolymer"), (c("l_discount") * 40).alias("dust"), (c("l_tax") * 10).alias("af"), c("l_quantity").alias("var_dp"), (c("l_linenumber") * 50).alias("hap_len"),
        (c("l_discount") * 30).alias("strand_bias"), (c("l_linenumber") % 3).alias("normal_var_reads"), c("l_quantity").alias("normal_depth"), c("l_quantity").alias("median_quality"),
        (c("l_tax") * 8).alias("zero_quality_share"), c("l_quantity").alias("mapping_quality"), (c("l_quantity") * 10).alias("depth"),
    )
    out = variants.somatic_filters(m, min_af=0.1, min_var_dp=5, min_haplotype=100, max_normal_reads=1, min_mapping_quality=10.0, depth_limit=450)
    return out.select("row_no", "filter")


@query(f"with {_VAR} select chrom, median(qual) as median_qual, count(*)::bigint as n from v group by chrom")
def vcf_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).groupBy("chrom").agg(F.median("qual").alias("median_qual"), F.count("*").alias("n"))


@query(f"""with {READS}, ra as (select * from reads where source < 'src2'), rb as (select * from reads where source >= 'src2'),
oa as (select {canon('kmer')} as c, kmer from {occ('ra', 41)}), ob as (select distinct {canon('kmer')} as c from {occ('rb', 41)}),
a as (select c as kmer, count(*) filter (kmer = c) as f, count(*) filter (kmer <> c) as r from oa group by c)
select kmer, f::bigint as n_fwd, r::bigint as n_rc from a where f > 0 and r > 0 and f + r >= 2 and f + r < 500 and kmer not in (select c from ob)""")
def graph_diff_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    return kmers.unique_to(r.filter("source < 'src2'"), r.filter("source >= 'src2'"), 41, 2, 500)


@query(f"""with {READS}, n as (select source, count(*) as n from reads group by source), s as (select source as sample, sum(n) over (order by source) - n as start, sum(n) over (order by source) - 1 as "end" from n)
select sample, start::bigint as first_read, "end"::bigint as last_read from s""")
def population_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contigua.sources import population

    return population.ranges(R.derive(spark, sf_dir), "source").select("sample", F.col("start").alias("first_read"), F.col("end").alias("last_read"))


_REC = "select l_orderkey as name, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as r, count(*) over (partition by l_orderkey) as k, l_suppkey % 30 as ref, l_partkey * 3 as pos, l_partkey * 3 + 100 as end_pos, l_quantity as mapq, (l_orderkey + l_linenumber) % 8 as nm, l_partkey % 2 = 1 as rev, l_returnflag <> 'N' as mapped, 300000 as len from lineitem"


@query(f"""with rec as ({_REC}), a as (select * from rec where r = 1 and k = 2), b as (select * from rec where r = 2 and k = 2)
select name, case when a.nm / 100.0 > 0.05 or b.nm / 100.0 > 0.05 then 'error_rate' when a.mapq < 10 or b.mapq < 10 then 'quality'
when a.ref = b.ref and not (case when a.pos < b.pos then a.rev else b.rev end) and (case when a.pos < b.pos then b.rev else a.rev end) then 'forward_reverse'
when a.ref <> b.ref and (least(a.pos, a.len - a.end_pos) < 500 or least(b.pos, b.len - b.end_pos) < 500) then 'near_end' else 'pass' end as reason
from a join b using (name) where a.mapped and b.mapped""")
def filter_bam_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rec = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        c("l_orderkey").alias("name"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("rec"), F.lit(True).alias("is_primary"), (c("l_returnflag") != "N").alias("is_mapped"), (c("l_partkey") % 2 == 1).alias("is_reverse"), (c("l_suppkey") % 30).alias("ref"),
        (c("l_partkey") * 3).alias("pos"), (c("l_partkey") * 3 + 100).alias("end_pos"), c("l_quantity").alias("mapq"), ((c("l_orderkey") + c("l_linenumber")) % 8).alias("nm"), F.repeat(F.lit("A"), F.lit(100)).alias("seq"),
    )
    lengths = spark.range(30).select(c("id").alias("ref"), F.lit(300000).alias("ref_length"))
    return alignments.filter_pairs(alignments.pairs(rec), lengths, max_error=0.05, min_quality=10, min_to_end=500)
