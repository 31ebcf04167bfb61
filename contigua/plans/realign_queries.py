"""Queries on realignment windows, haplotypes against references, and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.operators import bubbles, events, realign
from contigua.operators import reads as R
from contigua.plans.graph_queries import _chain_graph
from contigua.plans.registry import DS, ERR, canon, occ, query, rc
from contigua.runtime import materialize


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three haplotypes of 140 bases for every tile of a document: as it is, with one base changed, without three bases."""
    d = materialize(R.doc_sequences(R.documents(spark, sf_dir)), "roots")
    at = R.tile_reads(d, 140, 40).select(F.col("read_idx").alias("window"), F.col("seq").alias("ref"))
    alt = F.concat(F.left("ref", F.lit(69)), F.translate(F.substring("ref", 70, 1), "ACGT", "CGTA"), F.substring("ref", 71, 140))
    gone = F.concat(F.left("ref", F.lit(69)), F.substring("ref", 73, 140))
    haps = F.array(*[F.struct(F.lit(i).alias("hap"), s.alias("seq")) for i, s in enumerate((F.col("ref"), alt, gone))])
    return materialize(at.select("window", F.explode(haps).alias("h")).select("window", "h.*"), "windows")


_HAPS = f"""{ERR}, wr as (select doc_id * 1000000 + t as w, substr(seq, (t * 40 + 1)::bigint, 140) as ref from (select *, unnest(generate_series(0, (length(seq) - 140) // 40)) as t from ds where length(seq) >= 140)),
hp as materialized (select w * 4 + h as read_idx, case h when 0 then ref when 1 then left(ref, 69) || translate(substr(ref, 70, 1), 'ACGT', 'CGTA') || substr(ref, 71) else left(ref, 69) || substr(ref, 73) end as seq from wr, (select unnest([0, 1, 2]) as h)),
hw as materialized (select distinct read_idx // 4 as w, {canon('kmer')} as c, kmer = {canon('kmer')} as f from {occ('hp', 31)}),
rw as materialized (select read_idx, {canon('kmer')} as c, kmer = {canon('kmer')} as f from {occ('err', 31)}),
ht as materialized (select distinct w, rw.read_idx, hw.f <> rw.f as turned from hw join rw using (c))"""


@query(f"""with {_HAPS}, dp as (select w, count(*) as n_reads, count(*) filter (turned) as n_turned from ht group by w)
select w as window, n_reads, n_turned, n_reads > 200 as over_depth from dp""")
def window_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that share a k-mer with the haplotypes of a window, those on the other strand, and whether there are too many."""
    reads = materialize(R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "seq", "qual"), "error-reads")
    hits = realign.window_hits(_windows(spark, sf_dir), reads)
    return hits.groupBy("window").agg(F.count("*").alias("n_reads"), F.count_if("turned").alias("n_turned"), (F.count("*") > 200).alias("over_depth"))


@query()
def realign_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window's haplotypes under all reads with errors: status, reads, gain, frequency."""
    reads = materialize(R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "seq", "qual"), "error-reads")
    return realign.realign(_windows(spark, sf_dir), reads, max_reads=200)


@query()
def variant_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walks of every bubble as haplotypes, the kept one as the reference: which of them the reads of later sources call
    and those of the first two don't."""
    v, e = _chain_graph(spark, sf_dir)
    w = bubbles.variant_strings(bubbles.variant_walks(e, 2000, 10, 8), v)
    haps = materialize(w.select(F.col("bubble").alias("window"), F.col("rank").cast("int").alias("hap"), "seq"), "bubble-haplotypes")
    reads = materialize(R.with_errors(R.derive(spark, sf_dir)).select("read_idx", "source", "seq", "qual"), "error-reads")
    return realign.comparative_calls(haps, reads.filter("source < 'src2'"), reads.filter("source >= 'src2'"))


@query(f"""with {DS}, h as (select doc_id as hap, seq from ds where length(seq) >= 31), b as materialized (select hap, false as turned, seq from h union all select hap, true, {rc('seq')} from h),
en as materialized (select hap, turned, 0 as side, left(seq, 31) as kmer from b union all select hap, turned, 1, right(seq, 31) from b),
rk as materialized (select doc_id as ref_id, p as pos, substr(seq, p, 31) as kmer from (select doc_id, seq, unnest(generate_series(1, length(seq) - 30)) as p from ds where length(seq) >= 31)),
hits as materialized (select * from rk semi join en using (kmer)), few as (select kmer from hits group by kmer having count(*) <= 3),
loc as materialized (select hap, turned, side, ref_id, pos from en join (select * from hits semi join few using (kmer)) using (kmer)),
pr as (select a.hap, a.turned, a.ref_id, a.pos as start, z.pos + 30 as "end" from loc a join loc z on a.hap = z.hap and a.turned = z.turned and a.ref_id = z.ref_id and a.side = 0 and z.side = 1 where z.pos >= a.pos)
select hap, ref_id, turned, start::int as start, "end"::int as "end" from pr qualify count(*) over (partition by hap) = 1""")
def haplotype_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents lie on documents by their ends: copies make a place ambiguous."""
    d = materialize(R.doc_sequences(R.documents(spark, sf_dir)), "roots")
    placed = events.places(d.select(F.col("doc_id").alias("hap"), "seq"), d.select(F.col("doc_id").alias("ref_id"), "seq"))
    return placed.select("hap", "ref_id", "turned", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query(f"""with {DS}, tl as (select doc_id * 1000000 + t as hap, substr(seq, (t * 300 + 1)::bigint, 300) as seq from (select *, unnest(generate_series(0, (length(seq) - 300) // 300)) as t from ds where length(seq) >= 300)),
h as materialized (select hap, string_agg(case when (hap * 7919 + p * 104729) % 500 = 0 then translate(substr(seq, p, 1), 'ACGT', 'CGTA') else substr(seq, p, 1) end, '' order by p) as seq
      from (select *, unnest(generate_series(1, 300)) as p from tl) group by hap),
b as materialized (select hap, false as turned, seq from h union all select hap, true, {rc('seq')} from h),
en as materialized (select hap, turned, 0 as side, left(seq, 31) as kmer from b union all select hap, turned, 1, right(seq, 31) from b),
rk as materialized (select doc_id as ref_id, p as pos, substr(seq, p, 31) as kmer from (select doc_id, seq, unnest(generate_series(1, length(seq) - 30)) as p from ds where length(seq) >= 31)),
hits as materialized (select * from rk semi join en using (kmer)), few as (select kmer from hits group by kmer having count(*) <= 3),
loc as materialized (select hap, turned, side, ref_id, pos from en join (select * from hits semi join few using (kmer)) using (kmer)),
pr as (select a.hap, a.turned, a.ref_id, a.pos as start, z.pos + 30 as stop from loc a join loc z on a.hap = z.hap and a.turned = z.turned and a.ref_id = z.ref_id and a.side = 0 and z.side = 1 where z.pos >= a.pos),
one as (select * from pr qualify count(*) over (partition by hap) = 1),
pl as (select one.*, b.seq as own, substr(ds.seq, start, stop - start + 1) as piece from one join b using (hap, turned) join ds on ds.doc_id = ref_id where stop - start + 1 = 300)
select hap, ref_id, (start + p - 1)::bigint as pos, substr(piece, p, 1) as ref, substr(own, p, 1) as alt from (select *, unnest(generate_series(1, 300)) as p from pl) where substr(piece, p, 1) <> substr(own, p, 1)""")
def haplotype_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with errors (its tiles' bases changed by rule) against the documents: the events that tell them apart."""
    d = materialize(R.doc_sequences(R.documents(spark, sf_dir)), "roots")
    tiles = R.with_errors(R.tile_reads(d, 300, 300)).select(F.col("read_idx").alias("hap"), "seq")
    return events.call_events(events.places(tiles, d.select(F.col("doc_id").alias("ref_id"), "seq")))
