"""Named queries over the data folder, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Common table expressions of the derived sequences, for the SQL side.
DS = """
ds as materialized (select doc_id, source, translate(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]', '', 'g'),
       'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents)"""
READS = DS + """,
reads as materialized (select doc_id * 1000000 + t as read_idx, doc_id, source, substr(seq, (t * 40 + 1)::bigint, 100) as seq
          from (select *, unnest(generate_series(0, (length(seq) - 100) // 40)) as t from ds where length(seq) >= 100))"""
ERR = READS + """,
eb as (select read_idx, p, case when (read_idx * 7919 + p * 104729) % 500 = 0 then translate(substr(seq, p, 1), 'ACGT', 'CGTA') else substr(seq, p, 1) end as b,
       chr((33 + (read_idx * 31 + p * 17) % 41)::int) as q from (select *, unnest(generate_series(1, length(seq))) as p from reads)),
err as materialized (select read_idx, string_agg(b, '' order by p) as seq, string_agg(q, '' order by p) as qual from eb group by read_idx)"""


def rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def canon(s: str) -> str:
    return f"least({s}, {rc(s)})"


def occ(table: str, k: int) -> str:
    """SQL of all windows of a table of reads."""
    return f"(select read_idx, p, substr(seq, p, {k}) as kmer from (select read_idx, seq, unnest(generate_series(1, length(seq) - {k} + 1)) as p from {table} where length(seq) >= {k}))"
