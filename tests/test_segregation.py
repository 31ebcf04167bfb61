"""Segregation of haplotypes of very many reads, whose likelihoods are beyond doubles."""

import math

from contigua.operators import variants


def test_many_reads(spark):
    depths = [12.0, 8.0]
    df = spark.createDataFrame([([900, 0],), ([2000, 3000],)], "counts array<bigint>")
    got = [r.asDict() for r in variants.segregation_scores(df, depths, 1.0).collect()]
    for row in got:
        assert all(math.isfinite(v) for n, v in row.items() if n != "counts")
        total, share = sum(row["counts"]), 1 - 1e-9  # both samples carry it
        want = 0.0
        for c in row["counts"]:
            p = q = total / 2
            carried = math.log(share) + c * math.log(q) - q
            if c == 0:
                top = max(carried, math.log(1 - share))
                carried = top + math.log(math.exp(carried - top) + math.exp(math.log(1 - share) - top))
            want += carried - c * math.log(p) + p
        assert math.isclose(row["lm_haploid"], want, rel_tol=1e-9, abs_tol=1e-6)


def test_counts_are_scored_once(spark):
    rows = [([3, 0],), ([0, 7],), ([0, 0],), (None,), ([1, 1],)]
    few = variants.segregation_scores(spark.createDataFrame(rows, "counts array<bigint>"), [12.0, 8.0], 1.0)
    want = {str(r.counts): tuple(r)[1:] for r in few.collect()}
    assert want["None"] == want["[0, 0]"] == (None,) * 4 and None not in want["[0, 7]"]
    many = variants.segregation_scores(spark.createDataFrame(rows * 50, "counts array<bigint>").coalesce(1), [12.0, 8.0], 1.0)
    assert "zip_with" not in many._jdf.queryExecution().optimizedPlan().toString().lower()
    got = many.collect()
    assert len(got) == 250 and all(tuple(r)[1:] == want[str(r.counts)] for r in got)
