"""Queries on text formats (written to the shared folder and read again), names, qualities and scaffold clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.functions import sequence as S
from contigua.operators import alignments as A
from contigua.operators import kmers, overlap, preqc, scaffold, variants
from contigua.operators import reads as R
from contigua.plans.read_queries import _BOTH, _OVL, unique_reads
from contigua.plans.registry import DS, ERR, READS, query, rc
from contigua.plans.stat_queries import _LINKS, _contigs, _links
from contigua.runtime import scratch_path
from contigua.sources import alignments, graphs, sequences


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "seq", "qual")


@query(f"with {ERR} select 'r' || read_idx as id, '' as meta, seq, qual from err")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fastq")
    sequences.write(_errors(spark, sf_dir).withColumn("id", F.concat(F.lit("r"), F.col("read_idx").cast("string"))), path, compress=True)
    return sequences.read_fastq(spark, path).select("id", "meta", "seq", "qual")


@query(f"with {DS} select 'd' || doc_id as id, seq from ds where length(seq) > 0")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    d = R.doc_sequences(R.documents(spark, sf_dir)).filter(F.length("seq") > 0)
    sequences.write(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "seq", F.lit(None).cast("string").alias("qual")), path, wrap=60)
    return sequences.read_fasta(spark, path).select("id", "seq")


@query(f"with {DS} select 'd' || doc_id as id, length(seq)::int as length from ds where length(seq) >= 200")
def sequence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    d = R.doc_sequences(R.documents(spark, sf_dir))
    sequences.write(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "seq", F.lit(None).cast("string").alias("qual")), path)
    return sequences.lengths(sequences.as_vertices(sequences.read_fasta(spark, path), 200))


@query(f"with {READS} select row_number() over (order by read_idx) - 1 as read_idx, seq from reads")
def number_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    r = R.derive(spark, sf_dir).select(F.col("read_idx").alias("id"), "seq", F.lit(None).cast("string").alias("qual"))
    sequences.write(r.repartitionByRange("id").sortWithinPartitions("id"), path)
    return sequences.numbered(sequences.read_fasta(spark, path)).select("read_idx", "seq")


_PAIRED = "pr as (select 'p' || (read_idx // 2) || case when read_idx % 2 = 0 then '/1' else '/2' end as id, read_idx // 2 as pair, read_idx % 2 as i, seq, qual from err)"


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("read_idx")
    return _errors(spark, sf_dir).select(F.concat(F.lit("p"), F.floor(i / 2).cast("string"), F.when(i % 2 == 0, "/1").otherwise("/2")).alias("id"), "seq", "qual")


@query(f"with {ERR}, {_PAIRED} select id, seq, qual, i::int as file from pr")
def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.numbered_pairs(_paired(spark, sf_dir))


@query(f"""with {ERR}, {_PAIRED}, a as (select * from pr where i = 0), b as (select * from pr where i = 1)
select 'p' || pair as id, a.seq || b.seq as seq, a.qual || b.qual as qual, length(a.seq)::int as join_pos from a join b using (pair)""")
def join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.join_pairs(_paired(spark, sf_dir)).filter("seq is not null")


@query(f"with {ERR}, {_PAIRED} select id, seq, qual from pr where pair in (select pair from pr group by pair having count(*) = 2)")
def unjoin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.unjoin_pairs(sequences.join_pairs(_paired(spark, sf_dir)).filter("seq is not null"))


@query(f"""with {ERR}, {_PAIRED} select id, left(id, length(id) - 1) || case i when 0 then '2' else '1' end as mate, 'p' || pair as base, i::int as i from pr""")
def pair_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return _paired(spark, sf_dir).select("id", S.pair_id(i).alias("mate"), S.pair_basename(i).alias("base"), S.pair_index(i).alias("i"))


_ED = f"""{_OVL}, ed as (select x::varchar as id1, y::varchar as id2, case xs when 0 then 100 - ov else 0 end::int as s1, case xs when 0 then 99 else ov - 1 end::int as e1, 100 as l1,
case ys when 0 then 0 else 100 - ov end::int as s2, case ys when 0 then ov - 1 else 99 end::int as e2, 100 as l2, (xs <> ys)::int as is_rc, 0 as num_diff from ov)"""


@query(f"with {_ED} select * from ed where id1 <= id2 and e1 - s1 + 1 >= 60")
def asqg_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, u = scratch_path(spark, "asqg"), unique_reads(spark, sf_dir)
    graphs.write_asqg(u.select(F.col("read_idx").alias("id"), "seq"), graphs.match_columns(overlap.exact_overlaps(u), 100), path, 45)
    return graphs.read_asqg(spark, path, 60)[1]


@query(f"""with {DS}, {_LINKS} select '"' || id || '" [label="' || id || '"];' as value from ct union all select '"' || x || '" -> "' || y || '" [label="' || dist::bigint || '"];' from tw""")
def dot_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contigs(spark, sf_dir)
    return graphs.dot_lines(c.select("id"), scaffold.twins(_links(c)).select("x", "y", F.col("dist").alias("lab")))


@query(f"with {DS}, {_LINKS} select x::varchar as x, xs, y::varchar as y, ys, dist, sd, n_pairs::int as n_pairs from tw")
def distance_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written one root a line, the sense side before the semicolon, and read again."""
    path, t = scratch_path(spark, "de"), scaffold.twins(_links(_contigs(spark, sf_dir)))
    sign = F.when(F.col("xs") == F.col("ys"), "+").otherwise("-")
    record = F.concat(F.col("y").cast("string"), sign, F.lit(","), F.col("dist").cast("int").cast("string"), F.lit(","), F.col("n_pairs").cast("string"), F.lit(","), F.col("sd").cast("string"))
    side = lambda s: F.array_join(F.collect_list(F.when(F.col("xs") == s, record)), " ")
    lines = t.groupBy("x").agg(side(0).alias("sense"), side(1).alias("anti"))
    lines.select(F.concat(F.col("x").cast("string"), F.lit(" "), "sense", F.lit(" ; "), "anti").alias("value")).write.mode("overwrite").text(path)
    # the part before the semicolon begins with the root
    return graphs.read_distance_estimates(spark, path)


@query(f"with {DS}, {_LINKS} select id::varchar as id, len::int as len, len::int as nlen, n::int as n, 1.5 as copy_number, (len - n)::double as a_stat from ct")
def a_statistic_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, c = scratch_path(spark, "astat"), _contigs(spark, sf_dir)
    c.select("id", "len", F.col("len").alias("nlen"), "n", F.lit(1.5).alias("copy_number"), (F.col("len") - F.col("n")).cast("double").alias("a_stat")).write.csv(path, sep="\t")
    return graphs.read_a_statistic(spark, path)


@query(f"with {DS}, {_LINKS} select x::varchar as root, y::varchar as id, dist::int as dist, sd, xs as dir, (xs <> ys)::int as comp, 'D' as type from lk")
def scaf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lk = _links(_contigs(spark, sf_dir))
    link = F.struct(F.col("y").alias("o"), F.col("y").cast("string").alias("id"), F.col("dist").cast("int").alias("dist"), "sd", F.col("xs").alias("dir"), (F.col("xs") != F.col("ys")).cast("int").alias("comp"), F.lit("D").alias("type"))
    s = lk.groupBy(F.col("x").cast("string").alias("root")).agg(F.array_sort(F.collect_list(link)).alias("links"))
    path = scratch_path(spark, "scaf")
    s.select(graphs.scaf_line().alias("value")).write.text(path)
    return graphs.parse_scaf(spark.read.text(path)).select("root", F.explode("links").alias("l")).select("root", "l.*")


_CALLS = """vc as (select l_orderkey * 8 + l_linenumber as row_no, 'chr' || (l_suppkey % 20) as chrom, (l_partkey * 11 + l_linenumber * 3)::int as pos, substr('ACGT', (1 + l_orderkey % 4)::bigint, 1) as ref,
substr('CGTA', (1 + l_orderkey % 4)::bigint, 1) as alt, (l_quantity)::double as qual, case when l_linenumber % 3 = 0 then 'PASS' else 'NoCall' end as filter from lineitem)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    base = lambda s: F.substring(F.lit(s), (1 + o % 4).cast("int"), F.lit(1))
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return v.select(
        (o * 8 + n).alias("row_no"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 20).cast("string")).alias("chrom"), (F.col("l_partkey") * 11 + n * 3).cast("int").alias("pos"),
        base("ACGT").alias("ref"), base("CGTA").alias("alt"), F.col("l_quantity").cast("double").alias("qual"), F.when(n % 3 == 0, "PASS").otherwise("NoCall").alias("filter"),
    )


@query(f"with {_CALLS} select chrom, pos, 'v' || row_no as id, ref, alt, qual, filter, (row_no % 50)::varchar as depth from vc")
def vcf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vcf")
    info = F.create_map(F.lit("DP"), (F.col("row_no") % 50).cast("string"), F.lit("AF"), F.lit("0.5"))
    v = _calls(spark, sf_dir).select("chrom", "pos", F.concat(F.lit("v"), F.col("row_no").cast("string")).alias("id"), "ref", "alt", "qual", "filter", info.alias("info"), F.lit(None).cast("string").alias("format"), F.array().cast("array<string>").alias("samples"))
    v.select(graphs.vcf_line().alias("value")).write.text(path)
    return graphs.read_vcf(spark, path).select("chrom", "pos", "id", "ref", "alt", "qual", "filter", F.col("info")["DP"].alias("depth"))


@query(f"with {DS} select 0 as part, '##fileformat=VCFv4.1' as value union all select 1, '##source=calls' union all select 2, '##contig=<ID=' || doc_id || ',length=' || length(seq) || '>' from ds union all select 3, '#CHROM' || chr(9) || 'POS' || chr(9) || 'ID' || chr(9) || 'REF' || chr(9) || 'ALT' || chr(9) || 'QUAL' || chr(9) || 'FILTER' || chr(9) || 'INFO'")
def vcf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.vcf_header(spark, _contigs(spark, sf_dir).select("id", F.col("len").alias("length")), "calls")


@query(f"""with {_CALLS} select v.row_no, v.chrom, v.pos, 'DP=' || (v.row_no % 50) || ';BQ=' || b.qual as info from vc v join vc b using (chrom, pos) where v.filter = 'PASS' and b.row_no % 2 = 0""")
def vcf_contrast_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _calls(spark, sf_dir).withColumn("info", F.concat(F.lit("DP="), (F.col("row_no") % 50).cast("string")))
    base = v.withColumn("filter", F.when(F.col("row_no") % 2 == 0, "NoCall").otherwise("PASS"))
    return variants.with_base_quality(variants.contrast_calls(v, base)).select("row_no", "chrom", "pos", "info")


@query(f"with {_CALLS} select row_no, (row_no % 50)::varchar as depth, 'yes' as somatic from vc")
def vcf_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _calls(spark, sf_dir).withColumn("info", F.concat(F.lit("DP="), (F.col("row_no") % 50).cast("string"), F.lit(";SOM=yes")))
    m = variants.info_map(F.col("info"))
    return v.select("row_no", m["DP"].alias("depth"), m["SOM"].alias("somatic"))


@query(f"""with {READS}, x as (select read_idx, seq, (20 + read_idx % 50)::int as p from reads), y as (select *, substr(seq, p, 1) as b from x)
select read_idx, (length(regexp_extract(substr(seq, p), '^' || b || '+')) + length(regexp_extract(reverse(left(seq, p)), '^' || b || '+')) - 1)::int as run, substr(seq, p - 1, 3) as context from y""")
def variant_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir).withColumn("p", (20 + F.col("read_idx") % 50).cast("int"))
    return r.select("read_idx", variants.homopolymer_at(F.col("seq"), F.col("p")).alias("run"), variants.three_mer_context(F.col("seq"), F.col("p")).alias("context"))


@query(f"""with {READS}, x as (select read_idx, seq, (20 + read_idx % 50)::int as p, (1 + read_idx % 3)::int as n from reads), y as (select *, substr(seq, p + 2, n) as unit, length(left(seq, p)) as st from x),
f as (select *, instr(substr(seq, p + 1), unit) + p - 1 as first from y), g as (select *, first <= p + n + 1 and instr(substr(seq, p + 1), unit) > 0 as ok from f)
select read_idx, unit, case when ok then (length(regexp_extract(substr(seq, first + 1), '^(' || unit || ')+')) // n + length(regexp_extract(reverse(left(seq, first)), '^(' || reverse(unit) || ')+')) // n)::int else 0 end as units from g""")
def variant_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion of one to three bases in every read."""
    i = F.col("read_idx")
    r = R.derive(spark, sf_dir).select("read_idx", "seq", (20 + i % 50).cast("int").alias("p"), (1 + i % 3).cast("int").alias("n"))
    ref, alt = F.substring("seq", F.col("p") + 1, F.col("n") + 1), F.substring("seq", F.col("p") + 1, F.lit(1))
    unit, units = variants.repeat_units(F.col("seq"), F.col("p"), ref, alt)
    return r.select("read_idx", unit.alias("unit"), units.alias("units"))


_SAM = f"""{READS}, al as (select 'idx-' || row_number() over (order by read_idx) as name, read_idx % 11 <> 0 as is_primary, read_idx % 5 <> 0 as is_mapped, read_idx % 2 = 1 as is_reverse, 'd' || doc_id as ref,
((read_idx % 1000000) * 40)::int as pos, ((read_idx % 1000000) * 40 + 98)::int as end_pos, (read_idx % 61)::int as mapq, '50M2I48M' as cigar, seq, case when read_idx % 3 = 0 then null else (read_idx % 3)::int end as nm from reads)"""


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contigua.operators import index

    i = F.col("read_idx")
    r = index.global_rank(R.derive(spark, sf_dir), "read_idx")
    return r.select(
        F.concat(F.lit("idx-"), (F.col("rank") + 1).cast("string")).alias("name"), (i % 11 != 0).alias("is_primary"), (i % 5 != 0).alias("is_mapped"), (i % 2 == 1).alias("is_reverse"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("ref"),
        (i % 1000000 * 40).cast("int").alias("pos"), (i % 61).cast("int").alias("mapq"), F.lit("50M2I48M").alias("cigar"), "seq", F.lit("*").alias("qual"), F.when(i % 3 != 0, (i % 3).cast("int")).alias("nm"),
    )


@query(f"with {_SAM} select name, is_primary, is_mapped, is_reverse, ref, pos, end_pos, mapq, cigar, seq, nm from al")
def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, a = scratch_path(spark, "sam"), _alignments(spark, sf_dir)
    refs = _contigs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("ref"), F.col("len").alias("ref_length"))
    alignments.write_sam(a, refs, path)
    return alignments.read_sam(spark, path).drop("qual")


@query(f"with {_SAM} select case when r.read_idx is null then name else 'r' || r.read_idx end as name, coalesce(r.seq, al.seq) as seq, ref, pos from al left join (select read_idx, seq, row_number() over (order by read_idx) as k from reads) r on name = 'idx-' || (k - 1)")
def restore_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contigua.operators import index

    r = index.global_rank(R.derive(spark, sf_dir).select(F.col("read_idx").alias("old"), "seq"), "old", name="read_idx")
    r = r.select("read_idx", F.concat(F.lit("r"), F.col("old").cast("string")).alias("id"), "seq", F.lit(None).cast("string").alias("qual"))
    return A.restore_reads(_alignments(spark, sf_dir), r).select("name", "seq", "ref", "pos")


@query(f"with {READS} select (doc_id)::varchar as cluster_id, count(*) over (partition by doc_id)::int as size, read_idx::varchar as read, seq, true as complete from reads")
def cluster_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, path = R.derive(spark, sf_dir), scratch_path(spark, "clusters")
    n = r.groupBy("doc_id").agg(F.count("*").alias("size"))
    graphs.cluster_lines(r.join(n, "doc_id").select(F.col("doc_id").alias("cluster_id"), "size", F.col("read_idx").alias("read"), "seq")).write.text(path)
    return graphs.read_clusters(spark, path)


@query(f"""with {ERR}, c as {_BOTH('reads', 31)}, h as (select n::bigint as n, count(*) as kmers from c group by n), q as (select p, count(*) as n, sum(ascii(substr(qual, p, 1)) - 33) as total from (select *, unnest(generate_series(1, length(qual))) as p from err) group by p)
select '{{"counts":[' || (select string_agg('{{"n":' || n || ',"kmers":' || kmers || '}}', ',' order by n) from h) || '],"quality":[' || (select string_agg('{{"pos":' || p || ',"n":' || n || ',"total":' || total || '}}', ',' order by p) from q) || ']}}' as json""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir)
    hist = kmers.count_levels(r, 31)
    q = preqc.quality_by_position(R.with_errors(r))
    return graphs.report_json(counts=hist, quality=q.select("pos", "n", F.round(F.col("mean_quality") * F.col("n")).cast("long").alias("total")))


@query(f"""with {READS}, a as (select read_idx, seq, {rc('seq')} as other from reads)
select read_idx, len(list_filter(generate_series(1, 40), lambda i: substr(seq, i, 1) <> substr(other, i, 1)))::int as first40, len(list_filter(generate_series(1, 100), lambda i: substr(seq, i, 1) <> substr(other, i, 1)))::int as hamming,
list_aggregate(list_transform(generate_series(1, 100), lambda i: case when substr(seq, i, 1) = substr(other, i, 1) then '.' else substr(other, i, 1) end), 'string_agg', '') as diff from a""")
def sequence_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir).select("read_idx", "seq", S.reverse_complement(F.col("seq")).alias("other"))
    a, b = F.col("seq"), F.col("other")
    return r.select("read_idx", S.hamming(a, b, F.lit(40)).alias("first40"), S.hamming(a, b).alias("hamming"), S.diff_string(a, b).alias("diff"))


@query("""with x as (select doc_id, translate(left(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 50), 'EFIJLOPQUXZ', 'MRWSYKVHDBN') as s from documents where text is not null), y as (select * from x where length(s) > 0)
select doc_id, translate(lower(s), 'acgtmrwsykvhdbn', 'tgcakywsrmbdhvn') as comp, reverse(translate(s, 'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN')) as rc, left(s, 1) not in ('A', 'C', 'G', 'T') as ambiguous,
case left(s, 1) when 'A' then 'A' when 'C' then 'C' when 'G' then 'G' when 'T' then 'T' when 'M' then 'AC' when 'R' then 'AG' when 'W' then 'AT' when 'S' then 'CG' when 'Y' then 'CT' when 'K' then 'GT'
when 'V' then 'ACG' when 'H' then 'ACT' when 'D' then 'AGT' when 'B' then 'CGT' else 'ACGT' end as bases from y""")
def iupac_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.left(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), F.lit(50))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select("doc_id", F.translate(t, "EFIJLOPQUXZ", "MRWSYKVHDBN").alias("s")).filter(F.length("s") > 0)
    s, first = F.col("s"), F.left("s", F.lit(1))
    return d.select("doc_id", S.complement_iupac(F.lower(s)).alias("comp"), S.reverse_complement_iupac(s).alias("rc"), S.is_ambiguous(first).alias("ambiguous"), S.possible_bases(first).alias("bases"))


@query(f"""with {ERR} select read_idx, list_transform(generate_series(1, length(qual)), lambda i: (ascii(substr(qual, i, 1)) - 33)::int) as scores, chr((33 + least(read_idx % 120, 93))::int) as capped,
list_aggregate(list_transform(generate_series(1, length(qual)), lambda i: chr((ascii(substr(qual, i, 1)) + 31 - 31)::int)), 'string_agg', '') as from64, ((read_idx % 100) / 1000.0 - 0.000001 <= 0.05) as acceptable,
round(ln(exp(-(read_idx % 7)) + exp(-(read_idx % 5))), 9) as log_sum from err""")
def quality_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, i = _errors(spark, sf_dir), F.col("read_idx")
    shifted = F.array_join(F.transform(S.phreds(F.col("qual")), lambda q: F.char(q + 64)), "")
    return r.select(
        "read_idx", S.phreds(F.col("qual")).alias("scores"), S.phred_char((i % 120).cast("int")).alias("capped"), S.phred64_to_phred33(shifted).alias("from64"),
        S.error_rate_acceptable(i % 100 / F.lit(1000.0), 0.05).alias("acceptable"), F.round(S.log_sum_exp(-(i % 7).cast("double"), -(i % 5).cast("double")), 9).alias("log_sum"),
    )


@query(f"""with {READS}, t as (select read_idx, s, substr(seq, s + q, 3) as m from reads, (select unnest(generate_series(1, 5)) as s), (select unnest(generate_series(0, 92)) as q)),
c as (select read_idx, s, m, count(*) as n from t group by all), d as (select read_idx, s, sum(n * (n - 1) / 2) / 94.0 as dust from c group by all) select read_idx, round(max(dust), 9) as dust from d group by read_idx""")
def max_dust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.derive(spark, sf_dir).select("read_idx", F.round(S.max_dust_window(F.col("seq"), 96, 96), 9).alias("dust"))


@query("""with x as (select doc_id, '/data/' || source || '/run.' || doc_id || case when doc_id % 3 = 0 then '' else '.fq' end as path from documents) select doc_id, regexp_replace(regexp_replace(path, '^.*/', ''), '[.][^.]*$', '') as stem, regexp_extract(regexp_replace(path, '^.*/', ''), '[.]([^.]*)$', 1) as extension from x where path is not null""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("/data/"), "source", F.lit("/run."), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(".fq"))
    return d.withColumn("path", path).filter("path is not null").select("doc_id", S.file_stem(F.col("path")).alias("stem"), S.file_extension(F.col("path")).alias("extension"))


@query(f"""with {READS}, n as (select read_idx, substr(seq, 1, 4) as s from reads), m as (select read_idx, 4 - length(replace(s, 'A', '')) as a, 4 - length(replace(s, 'C', '')) as c, 4 - length(replace(s, 'G', '')) as g, 4 - length(replace(s, 'T', '')) as t from n)
select read_idx, case when (a > 0)::int + (c > 0)::int + (g > 0)::int + (t > 0)::int = 1 then case when a > 0 then 'A' when c > 0 then 'C' when g > 0 then 'G' else 'T' end end as only_base,
list_aggregate(list_transform(list_sort([row(-a, 0, 'A'), row(-c, 1, 'C'), row(-g, 2, 'G'), row(-t, 3, 'T')]), lambda x: x[3]), 'string_agg', '') as by_count from m""")
def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.derive(spark, sf_dir).select("read_idx", F.left("seq", F.lit(4)).alias("s"))
    n = {b: F.length("s") - F.length(F.replace(F.col("s"), F.lit(b), F.lit(""))) for b in "ACGT"}
    return r.select("read_idx", S.unique_base(n).alias("only_base"), S.bases_by_count(n).alias("by_count"))


@query(f"""with {ERR}, x as (select read_idx, seq, substr(seq, 41, 12) as a from err), y as (select read_idx, seq, instr(seq, 'ACGTACG') as f, instr(seq, 'GGCAT') as r from x)
select read_idx, case when f > 0 then left(seq, f - 1) || substr(seq, f + 7) when r > 0 then left(seq, r - 1) || substr(seq, r + 5) else seq end as seq from y""")
def adapter_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.remove_adapter(_errors(spark, sf_dir), "ACGTACG", "GGCAT").select("read_idx", "seq")


_SIDES = f"""{DS}, {_LINKS}, one as (select x, xs from tw group by all having count(*) = 1)"""


@query(f"with {_SIDES} select x, xs, y, ys, dist, sd, n_pairs from tw semi join one using (x, xs) semi join (select x as y, 1 - xs as ys from one) b using (y, ys)")
def scaffold_single_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.single_sided(scaffold.twins(_links(_contigs(spark, sf_dir))))


@query(f"""with {DS}, {_LINKS}, tl as (select tw.*, len as len_m from tw join ct on y = id) select distinct c.x, c.xs, c.y, c.ys from tl a join tw b on a.y = b.x and a.ys = b.xs and a.x <> b.y
join tw c on c.x = a.x and c.xs = a.xs and c.y = b.y and c.ys = b.ys where abs(c.dist - (a.dist + b.dist + a.len_m)) <= 3.0 * sqrt(c.sd * c.sd + (a.sd * a.sd + b.sd * b.sd))""")
def scaffold_transitive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contigs(spark, sf_dir)
    t = scaffold.twins(_links(c))
    return scaffold.transitive_links(t.join(c.select(F.col("id").alias("y"), F.col("len").alias("len_y")), "y"))


_BEST = f"""{DS}, {_LINKS}, f as (select *, row_number() over (partition by x, xs order by dist, n_pairs desc, y, ys) as r from tw), g as (select * from f where r = 1),
bn as (select x * 2 + xs as a, y * 2 + ys as b, dist from g semi join (select y as x, 1 - ys as xs, x as y, 1 - xs as ys from g) h using (x, xs, y, ys)),
vs as (select id * 2 + s as v from ct, (select unnest([0, 1]) as s)), hd as (select v from vs where v not in (select b from bn)),
wk as (select v as head, v, 0 as ord from hd union all select head, b, ord + 1 from wk join bn on v = a),
en as (select head, arg_max(v, ord) as last from wk group by head), kp as (select head from en where head <= case when last % 2 = 0 then last + 1 else last - 1 end)"""


@query(f"with recursive {_BEST} select (head // 2)::bigint as scaffold, ord::bigint as ord, (v // 2)::bigint as id, (v % 2)::int as st, dist from wk semi join kp using (head) left join bn on v = a")
def scaffold_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contigs(spark, sf_dir)
    return scaffold.chains(c, scaffold.best_next(scaffold.twins(_links(c))))


@query(f"with recursive {_BEST}, sz as (select head, count(*) as n from wk semi join kp using (head) group by head), pd as (select v // 2 as id from wk semi join (select head from sz where n > 1) using (head)) select id, seq from ct join ds on id = doc_id where length(seq) >= 200 and id not in (select id from pd)")
def scaffold_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contigs(spark, sf_dir)
    placed = scaffold.chains(c, scaffold.best_next(scaffold.twins(_links(c))))
    many = placed.groupBy("scaffold").agg(F.count("*").alias("n")).filter("n > 1")
    return scaffold.unplaced(c.select("id", "seq"), placed.join(many, "scaffold"), 200)
