"""Realignment windows: reads against the haplotypes of each window under a banded hidden Markov model, frequencies, calls.

A window is a set of haplotypes of one place, the reference's among them. Reads come to a window by shared k-mers; their
likelihoods under every haplotype are computed for whole batches of pairs at a time; frequencies and calls are taken
from windows of bounded depth, and deeper ones are reported as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.functions import sequence as S
from contigua.operators.kmers import occurrences
from contigua.runtime import materialize, ship

#: Chance of an indel at a base by the length of the run of equal bases around it (from 10 on it grows by
#: ``RUN_STEP`` a base, to ``MOST_INDEL``), shares of deletions by length from 1 on, chance that a gap goes on.
INDEL = (2.9e-5, 2.9e-5, 2.9e-5, 2.9e-5, 4.3e-5, 1.1e-4, 2.4e-4, 5.7e-4, 1.0e-3, 1.4e-3)
RUN_STEP, MOST_INDEL = 4.3e-4, 0.95
DELETIONS = (0.632333, 0.232622, 0.085577, 0.031482, 0.011582, 0.004261, 0.001567)
GAP_GOES_ON = 0.5
#: Haplotype places a base may lie at, k-mers that find diagonals, their hits on a haplotype and diagonals that count,
#: and the log-likelihood of a read without any.
BAND, SEED, SEED_HITS, DIAGONALS, NO_PLACE = 8, 8, 4, 3, -1000.0
#: Cells of a batch (pairs of read and place, times read length), so that memory doesn't follow the data.
_CELLS = 1 << 21


def run_lengths(seq: str) -> list[int]:
    """At each base the length of the run of equal bases that it lies in."""
    out, i = [], 0
    while i < len(seq):
        j = i
        while j < len(seq) and seq[j] == seq[i]:
            j += 1
        out += [j - i] * (j - i)
        i = j
    return out


def indel_chance(run: int) -> float:
    return INDEL[run] if run < 10 else min(INDEL[9] + RUN_STEP * (run - 10), MOST_INDEL)


def diagonals(read: str, haplotype_seeds: dict[str, list[int]]) -> list[int]:
    """The places of the read's first base that most of its seeds agree on: by votes, ties by place; places beyond the count
    that share the last count go by place too."""
    votes: dict[int, int] = {}
    for i in range(len(read) - SEED + 1):
        for p in haplotype_seeds.get(read[i : i + SEED], ())[:SEED_HITS]:
            votes[p - i] = votes.get(p - i, 0) + 1
    return sorted(votes, key=lambda d: (-votes[d], d))[:DIAGONALS]


def seeds(haplotype: str) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i in range(len(haplotype) - SEED + 1):
        out.setdefault(haplotype[i : i + SEED], []).append(i)
    return out


def forward(reads: list[str], quals: list[list[int]], haps: list[str], places: list[int]) -> np.ndarray:
    """Log-likelihoods of reads placed on haplotypes, all pairs of a batch in step.

    Two states a place of the band: the base matches there, or it is inserted. Bases outside of the haplotype match; a base
    matches one of its haplotype with the chance that its quality gives, evened out over the four bases. The band starts
    half its width before the place, and a read that begins left of it enters when its band does.
    """
    n, length = len(reads), max(map(len, reads))
    ends = np.array([len(r) for r in reads])
    letters = np.zeros((n, length), np.uint32)
    correct = np.ones((n, length))
    width = max(map(len, haps))
    hap = np.full((n, width), 1, np.uint32)
    gap = np.full((n, width), INDEL[0] / 2)
    chance = np.array([indel_chance(r) / 2 for r in range(max(width, 10) + 1)])
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for i, (r, q, h) in enumerate(zip(reads, quals, haps, strict=True)):
        if h not in known:
            known[h] = np.frombuffer(h.encode("utf-32-le"), np.uint32), chance[run_lengths(h)]
        letters[i, : len(r)] = np.frombuffer(r.encode("utf-32-le"), np.uint32)
        correct[i, : len(r)] = 1 - np.exp(-2.3026 / 10 * np.array(q, np.float64))
        hap[i, : len(h)], gap[i, : len(h)] = known[h]
    inside_to = np.array([len(h) for h in haps])[:, None]
    start = np.array(places)[:, None] - BAND // 2
    band = np.arange(BAND)
    rows = np.arange(n)[:, None]
    match, ins, out = np.ones((n, BAND)), np.ones((n, BAND)), np.zeros(n)
    for l in range(length):
        at = start + l + band
        ok = (at >= 0) & (at < inside_to)
        safe = np.where(ok, at, 0)
        good = (0.25 + 0.75 * correct[:, l])[:, None]
        bad = (0.75 + 1e-10 - 0.75 * correct[:, l])[:, None]
        obs = np.where(~ok | (hap[rows, safe] == letters[:, l][:, None]), good, bad)
        g = np.where(ok, gap[rows, safe], INDEL[0] / 2)
        last = ends == l + 1
        # reads that lie left of the haplotype with their whole band just match, but for their last base
        left = (start[:, 0] + l <= -BAND) & ~last
        m2, i2 = np.zeros((n, BAND)), np.zeros((n, BAND))
        i2[:, :-1] += GAP_GOES_ON * ins[:, 1:] * good
        m2[:, :-1] += g[:, 1:] * ins[:, 1:] * good
        here = match * obs
        i2 += (1 - GAP_GOES_ON) * here
        m2 += (1 - 2 * g) * here
        for d, share in enumerate(DELETIONS, 1):
            m2[:, d:] += share * g[:, :-d] * here[:, :-d]
        if last.any():
            m2[last] = (here * (1 - 2 * g) / BAND)[last]
            i2[last] = (ins * good * g / BAND)[last]
        total = m2.sum(1) + i2.sum(1)
        live = (ends > l) & ~left
        out[live] += np.log(total[live])
        skip = (ends > l) & left
        out[skip] += np.log(good[skip, 0])
        match[live], ins[live] = (m2 / total[:, None])[live], (i2 / total[:, None])[live]
    return out


def log_likelihoods(pairs: list[tuple[str, str | None, str]], quality: int = 20) -> list[float]:
    """The best log-likelihood of each (read, qualities or None, haplotype) over the read's diagonals."""
    jobs, seen = [], {}
    for i, (read, _, hap) in enumerate(pairs):
        if hap not in seen:
            seen[hap] = seeds(hap)
        jobs += [(i, d) for d in diagonals(read, seen[hap])]
    out = np.full(len(pairs), NO_PLACE)
    step = max(1, _CELLS // max((len(p[0]) for p in pairs), default=1) // BAND)
    for j in range(0, len(jobs), step):
        part = jobs[j : j + step]
        some = [pairs[i] for i, _ in part]
        quals = [[ord(c) - 33 for c in q] if q is not None else [quality] * len(r) for r, q, _ in some]
        got = forward([p[0] for p in some], quals, [p[2] for p in some], [d for _, d in part])
        np.maximum.at(out, [i for i, _ in part], got)
    return out.tolist()


def window_hits(haplotypes: DataFrame, reads: DataFrame, k: int = 31) -> DataFrame:
    """``window``, ``read_idx``, ``turned``: reads that share a k-mer with any haplotype of a window, on its strand or turned; a read
    that fits both ways comes twice. Only numbers go through the join, whatever the depth."""
    # (window, haplotype) pairs stand for reads: their k-mers are taken in the same way
    h = haplotypes.select(F.struct("window", "hap").alias("read_idx"), "seq")
    wanted = occurrences(h, k).select(F.col("read_idx.window").alias("window"), "c", (F.col("kmer") == F.col("c")).alias("f")).distinct()
    have = occurrences(reads.select("read_idx", "seq"), k).select("read_idx", "c", (F.col("kmer") == F.col("c")).alias("g"))
    return wanted.join(have.hint("merge"), "c").select("window", "read_idx", (F.col("f") != F.col("g")).alias("turned")).distinct()


def window_reads(haplotypes: DataFrame, reads: DataFrame, k: int = 31, max_reads: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``window``, ``read_idx``, ``turned``, ``seq``, ``qual`` (on the haplotypes' strand) of the reads of each window, and ``window``,
    ``n_reads`` of the windows with more than ``max_reads`` of them, which get none. Sequences are fetched for the others only."""
    hits = materialize(window_hits(haplotypes, reads, k), "window-hits")
    deep = hits.groupBy("window").agg(F.count("*").alias("n_reads")).filter(F.col("n_reads") > max_reads)
    some = hits.join(deep.select("window"), "window", "left_anti")
    qual = F.col("qual") if "qual" in reads.columns else F.lit(None).cast("string")
    whole = some.join(reads.select("read_idx", "seq", qual.alias("qual")), "read_idx")
    seq = F.when(F.col("turned"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return whole.select("window", "read_idx", "turned", seq.alias("seq"), F.when(F.col("turned"), F.reverse("qual")).otherwise(F.col("qual")).alias("qual")), deep


def read_likelihoods(haplotypes: DataFrame, placed: DataFrame) -> DataFrame:
    """``window``, ``hap``, ``read_idx``, ``turned``, ``ll``: every read of a window under each of its haplotypes (a window has few)."""
    ship(haplotypes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(*[b.column(c).to_pylist() for c in ("seq", "qual", "hap_seq")], strict=True))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + [pa.array(log_likelihoods(pairs), pa.float64())], names=["window", "hap", "read_idx", "turned", "ll"])

    both = placed.join(haplotypes.select("window", "hap", F.col("seq").alias("hap_seq")), "window").select("window", "hap", "read_idx", "turned", "seq", "qual", "hap_seq")
    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("window", "hap", "read_idx", "turned"))
    return both.mapInArrow(run, f"{kinds}, ll double")


def frequencies(ll: np.ndarray, tolerance: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Frequencies of haplotypes (columns) by expectation maximisation over reads (rows)."""
    like = np.exp(ll - ll.max(1, keepdims=True))
    f = np.full(ll.shape[1], 1 / ll.shape[1])
    for _ in range(rounds):
        w = f * like
        new = (w / w.sum(1, keepdims=True)).mean(0)
        if np.abs(new - f).max() < tolerance:
            return new
        f = new
    return f


def select_haplotypes(ll: np.ndarray, least_gain: float = 10.0) -> list[tuple[int, float]]:
    """Haplotypes (columns; 0: the reference's, always in) that are added one by one, each time the one that the reads gain most by
    (sum over reads of the log of the best so far), with the gain, as long as it is ``least_gain`` or more."""
    best, out, left = ll[:, 0].copy(), [(0, 0.0)], list(range(1, ll.shape[1]))
    while left:
        gains = [float(np.maximum(ll[:, h] - best, 0).sum()) for h in left]
        i = int(np.argmax(gains))
        if gains[i] < least_gain:
            break
        h = left.pop(i)
        out.append((h, gains[i]))
        best = np.maximum(best, ll[:, h])
    return out


def window_calls(likelihoods: DataFrame, least_gain: float = 10.0) -> DataFrame:
    """``window``, ``hap``, ``n_reads``, ``gain`` (null: not selected), ``frequency``, ``best_reads`` (reads that it fits better than any
    other selected one) of every haplotype; haplotype 0 is the reference's. A window has a bounded number of reads."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("read_idx", "ascending"), ("turned", "ascending"), ("hap", "ascending")])
        haps = sorted(set(t["hap"].to_pylist()))
        ll = t["ll"].to_numpy().reshape(-1, len(haps))
        chosen = dict(select_haplotypes(ll, least_gain))
        cols = sorted(chosen)
        f = dict(zip(cols, frequencies(ll[:, cols]).tolist(), strict=True))
        top = ll[:, cols] == ll[:, cols].max(1, keepdims=True)
        alone = dict(zip(cols, (top & (top.sum(1, keepdims=True) == 1)).sum(0).tolist(), strict=True))
        n = len(haps)
        return pa.table({
            "window": pa.array([t["window"][0].as_py()] * n, pa.int64()), "hap": pa.array(haps, pa.int32()), "n_reads": pa.array([len(ll)] * n, pa.int64()),
            "gain": pa.array([chosen.get(i) for i in range(n)], pa.float64()), "frequency": pa.array([f.get(i, 0.0) for i in range(n)], pa.float64()), "best_reads": pa.array([alone.get(i, 0) for i in range(n)], pa.int64()),
        })

    slim = likelihoods.select("window", F.col("hap").cast("int").alias("hap"), "read_idx", "turned", "ll")
    return slim.groupBy("window").applyInArrow(one, "window long, hap int, n_reads long, gain double, frequency double, best_reads long")


def realign(haplotypes: DataFrame, reads: DataFrame, k: int = 31, max_reads: int = 1000, least_gain: float = 10.0) -> DataFrame:
    """``window``, ``hap``, ``status``, ``n_reads``, ``gain``, ``frequency``, ``best_reads`` of all haplotypes (``window``, ``hap``, ``seq``; hap 0: reference).

    ``status``: ``called`` (selected), ``not called``, ``no reads``, or ``over depth`` for windows with more than ``max_reads`` reads.
    """
    placed, deep = window_reads(haplotypes, reads, k, max_reads)
    calls = window_calls(read_likelihoods(haplotypes, materialize(placed, "window-reads")), least_gain)
    out = haplotypes.select("window", F.col("hap").cast("int").alias("hap")).join(calls, ["window", "hap"], "left").join(deep.withColumnRenamed("n_reads", "_deep"), "window", "left")
    status = F.when(F.col("_deep").isNotNull(), "over depth").when(F.col("n_reads").isNull(), "no reads").when(F.col("gain").isNotNull(), "called").otherwise("not called")
    return out.select("window", "hap", status.alias("status"), F.coalesce("n_reads", "_deep", F.lit(0)).alias("n_reads"), "gain", "frequency", "best_reads")


def comparative_calls(haplotypes: DataFrame, base_reads: DataFrame, variant_reads: DataFrame, k: int = 31, max_reads: int = 1000, least_gain: float = 10.0) -> DataFrame:
    """``window``, ``hap``, ``in_base``, ``in_variant``, ``call``: haplotypes other than the reference's that the variant reads call and
    the base reads, put to the same windows, don't. Windows over depth on either side call nothing."""
    base, variant = (realign(haplotypes, r, k, max_reads, least_gain) for r in (base_reads, variant_reads))
    both = variant.select("window", "hap", F.col("status").alias("in_variant"), F.col("frequency").alias("frequency")).join(base.select("window", "hap", F.col("status").alias("in_base")), ["window", "hap"])
    called = (F.col("in_variant") == "called") & F.col("in_base").isin("not called", "no reads")
    return both.filter("hap > 0").select("window", "hap", "in_base", "in_variant", "frequency", called.alias("call"))
