"""Scalar functions on sequences and qualities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IUPAC codes, their complements, and the bases that each stands for.
IUPAC = "ACGTMRWSYKVHDBN"
IUPAC_COMPLEMENT = "TGCAKYWSRMBDHVN"
IUPAC_BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}
#: Fixed value: phred score of a base without a quality.
DEFAULT_PHRED = 15


def complement(s: Column) -> Column:
    return F.translate(s, "ACGT", "TGCA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def complement_iupac(s: Column) -> Column:
    """Complement of IUPAC codes that keeps the case."""
    return F.translate(s, IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower())


def reverse_complement_iupac(s: Column) -> Column:
    return F.reverse(complement_iupac(s))


def canonical(s: Column) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(s, reverse_complement(s))


def is_ambiguous(code: Column) -> Column:
    return code.isin([c for c, b in IUPAC_BASES.items() if len(b) > 1])


def possible_bases(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in IUPAC_BASES.items() for x in pair])[code]


def resolve_ambiguous(seq: Column, seed: Column) -> Column:
    """Each ambiguous code replaced by one of its bases, chosen by a hash of seed and position; ``.`` counts as N."""
    def pick(c: Column, i: Column) -> Column:
        bases = possible_bases(c)
        at = F.pmod(F.xxhash64(seed, i), F.length(bases).cast("long")).cast("int") + 1
        return F.when(is_ambiguous(c), F.substring(bases, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(F.translate(seq, ".", "N"), ""), pick), "")


def prefix(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def suffix(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def phred(c: Column) -> Column:
    """Score of a phred+33 character."""
    return F.ascii(c) - 33


def phred_char(q: Column) -> Column:
    """phred+33 character of a score, capped at 93."""
    return F.char(F.least(q, F.lit(93)) + 33)


def prob_to_phred(p: Column) -> Column:
    return F.least(F.round(-10 * F.log10(p)).cast("int"), F.lit(93))


def phred64_to_phred33(qual: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.char(F.ascii(c) - 31)), "")


def phreds(qual: Column) -> Column:
    """Scores of a quality string."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def gc_fraction(seq: Column) -> Column:
    """Share of C and G; an empty sequence has none: null."""
    return F.length(F.translate(seq, "AT", "")) / F.nullif(F.length(seq), F.lit(0))


def hamming(a: Column, b: Column, n: Column | None = None) -> Column:
    """Differing places among the first ``n`` (default: the shorter one's length)."""
    n = F.least(F.length(a), F.length(b)) if n is None else n
    chars = lambda s: F.split(F.substring(s, F.lit(1), n), "")
    return F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def diff_string(a: Column, b: Column) -> Column:
    """The second sequence with ``.`` where it equals the first."""
    n = F.least(F.length(a), F.length(b))
    chars = lambda s: F.split(F.substring(s, F.lit(1), n), "")
    return F.array_join(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, ".").otherwise(y)), "")


def fence(df: DataFrame) -> DataFrame:
    """The same rows, each column computed once: what comes after refers to results and isn't merged into expressions."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def dust(seq: Column) -> Column:
    """Low-complexity score: pairs of equal 3-mers over length less two; the last 3-mer isn't counted, below 3 bases 0."""
    n = F.length(seq)
    mers = F.array_sort(F.transform(F.sequence(F.lit(1), n - 3), lambda i: F.substring(seq, i, F.lit(3))))
    # in sorted order a 3-mer pairs with as many equal ones before it as its run is long
    run = F.aggregate(
        mers, F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("pairs")),
        lambda acc, m: F.struct(m.alias("last"), F.when(acc["last"] == m, acc["run"] + 1).otherwise(0).alias("run"), (acc["pairs"] + F.when(acc["last"] == m, acc["run"] + 1).otherwise(0)).alias("pairs")),
        lambda acc: acc["pairs"],
    )
    return F.when(n <= 3, F.lit(0.0)).otherwise(run / (n - 2))


def soft_clip_end(qual: Column, threshold: int) -> Column:
    """Bases kept by quality trimming: all if the last score reaches the threshold, else up to the start of the suffix
    with the greatest sum of shortfalls (the shortest such suffix)."""
    q = F.reverse(phreds(qual))
    step = lambda acc, x: F.struct(
        (acc["i"] + 1).alias("i"), (acc["sum"] + threshold - x).alias("sum"),
        F.greatest(acc["best"], acc["sum"] + threshold - x).alias("best"),
        F.when(acc["sum"] + threshold - x > acc["best"], acc["i"] + 1).otherwise(acc["cut"]).alias("cut"),
    )
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"), F.lit(0).alias("best"), F.lit(0).alias("cut"))
    cut = F.aggregate(q, start, step, lambda acc: acc["cut"])
    return F.when(phred(F.right(qual, F.lit(1))) >= threshold, F.length(qual)).otherwise(F.length(qual) - cut)


def pair_id(id_: Column) -> Column:
    """Name of the mate by the last character (A/B, 1/2, f/r); empty if there is no such convention."""
    last = F.right(id_, F.lit(1))
    return F.when(last.isin(*"AB12fr"), F.concat(F.substring(id_, F.lit(1), F.length(id_) - 1), F.translate(last, "AB12fr", "BA21rf"))).otherwise("")


def pair_basename(id_: Column) -> Column:
    """What comes before the last slash."""
    return F.regexp_replace(id_, "/[^/]*$", "")


def pair_index(id_: Column) -> Column:
    """0 for the first of a pair, 1 for the second, null otherwise."""
    last = F.right(id_, F.lit(1))
    return F.when(last.isin("A", "1", "f"), 0).when(last.isin("B", "2", "r"), 1)


def error_rate_acceptable(rate: Column, threshold: float) -> Column:
    return rate - 1e-6 <= threshold


def log_sum_exp(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b))."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def homopolymer_run(seq: Column) -> Column:
    """Length of the longest run of one base."""
    return F.array_max(F.transform(F.regexp_extract_all(seq, F.lit("(A+|C+|G+|T+)"), 0), F.length))


def max_base_share(seq: Column) -> Column:
    """Share of the most frequent base."""
    return F.greatest(*[F.length(seq) - F.length(F.translate(seq, b, "")) for b in "ACGT"]) / F.length(seq)


def max_dust_window(seq: Column, window: int = 64, least: int = 64) -> Column:
    """The highest low-complexity score of any ``window`` bases in a row, shorter ones at the end down to ``least``; 0 if none."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1))), lambda i: F.least(F.length(seq) - i + 1, F.lit(window)) >= least)
    return F.coalesce(F.array_max(F.transform(starts, lambda i: dust(F.substring(seq, i, F.lit(window))))), F.lit(0.0))


def random_base(seed: Column) -> Column:
    """A base chosen by a hash."""
    return F.substring(F.lit("ACGT"), F.pmod(F.xxhash64(seed), F.lit(4)).cast("int") + 1, F.lit(1))


def file_stem(path: Column) -> Column:
    """The last part of a path up to its last dot."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    """What follows the last dot of the last part of a path; empty if there is none."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"\.([^.]*)$", 1)


def unique_base(n: dict[str, Column]) -> Column:
    """The only base with a count; null if none or several have one. ``n``: counts by base."""
    some = F.filter(F.array(*[F.when(c > 0, b) for b, c in n.items()]), lambda b: b.isNotNull())
    return F.when(F.size(some) == 1, some[0])


def bases_by_count(n: dict[str, Column]) -> Column:
    """Bases by count, highest first, ties in the order given."""
    order = F.array(*[F.struct((-c).alias("n"), F.lit(i).alias("i"), F.lit(b).alias("b")) for i, (b, c) in enumerate(n.items())])
    return F.array_join(F.transform(F.array_sort(order), lambda x: x["b"]), "")
