"""Interaction of five filters by inclusion and exclusion: joint failures of all 32 intersections, inverted to all orders.

A document fails or passes each filter whatever the others do, so one aggregation answers every order: J(S), the number
of documents that fail all filters of S, is a sum of flag products. What stays after the filters of U is the alternating
sum of J over the subsets of U, what fails S and nothing else that over its supersets, and the Harsanyi dividend of S in
the game "documents removed by a coalition" is J(S) with the sign of its size; a filter's Shapley value shares every
dividend equally among the members of S.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from contigua.llm.common import text_digest
from contigua.llm.quality import WHITE

FILTERS = "ABCDE"
#: Fewest words, least percentage of distinct words, highest percentage of capitals, forbidden characters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, FORBIDDEN = 100, 80, 10, "#$%&*|"
_ALL = 1 << len(FILTERS)
_DEDUP = _ALL >> 1
#: Rows without an id are dealt over this many keys on their way past the labels.
_SPREAD = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: whether a text (null: empty) fails A, B, C, D."""
    t = F.coalesce(text, F.lit(""))
    counts = _let(F.array_remove(F.split(t, f"[{WHITE}]+"), ""), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))

    def bits(c: Column) -> Column:
        capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
        fails = (c["n"] < MIN_WORDS, 100 * c["d"] < MIN_DISTINCT * c["n"], 100 * capitals > MAX_CAPITALS * F.length(t), t.rlike(f"[{FORBIDDEN}]"))
        out = F.lit(0)
        for i, f in enumerate(fails):
            out = out + F.when(f, F.lit(1 << i)).otherwise(F.lit(0))
        return out

    return _let(counts, bits).cast("byte")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part``, ``bits`` (failures of A to D), ``good``, ``toxic``, ``n`` (rows) and ``n_copy`` (those that fail E), pre-aggregated
    by text, so that the rows that share a text are never one task's.

    Rows without an id are no copies and make none; rows that repeat an id and its text don't make each other copies.
    """
    col = lambda c: F.col(f"`{c}`")
    text = col(text_col).cast("string")
    slim = docs.select(col(id_col).alias("_id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), text_digest(text).alias("digest"), text_failures(text).alias("bits"))
    rows = slim.groupBy("_id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    rows = rows.withColumn("_salt", F.when(F.col("_id").isNull(), F.pmod(F.hash("digest", "part"), F.lit(_SPREAD))).otherwise(F.lit(-1)))
    marked = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = marked.filter("_id is not null").withColumn("_salt", F.lit(-1))
    rows = rows.join(marked.hint("merge"), ["_id", "_salt"], "left").fillna(False, ["good", "toxic"])
    least = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n")))
    kinds = rows.groupBy("digest", "part", "bits", "good", "toxic").agg(least.alias("least"), F.sum("n").alias("n"), F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    # of a text there are as many rows now as it has kinds of languages and labels
    first = F.min("least._id").over(W.partitionBy("digest"))
    stays = F.col("nameless") + F.when(F.col("least._id") == first, F.col("least.n")).otherwise(0)
    return kinds.select("part", "bits", "good", "toxic", "n", (F.col("n") - stays).alias("n_copy"))


def _alternate(values: Column) -> Column:
    """Every entry with the sign of the number of bits of its position."""
    return F.transform(values, lambda x, m: F.when(F.bit_count(m) % 2 == 0, x).otherwise(-x))


def _subset_sums(values: Column) -> Column:
    """At every mask the sum over the masks below it, one bit after the other."""

    def step(v: Column, bit: int) -> Column:
        return F.transform(v, lambda x, m: F.when(m.bitwiseAND(F.lit(bit)) != 0, x + F.get(v, m.bitwiseXOR(F.lit(bit)))).otherwise(x))

    for i in range(len(FILTERS)):
        values = _let(values, partial(step, bit=1 << i))
    return values


def _superset_differences(values: Column) -> Column:
    """At every mask the alternating sum over the masks above it (Möbius inversion), one bit after the other."""

    def step(v: Column, bit: int) -> Column:
        return F.transform(v, lambda x, m: F.when(m.bitwiseAND(F.lit(bit)) == 0, x - F.get(v, m.bitwiseXOR(F.lit(bit)))).otherwise(x))

    for i in range(len(FILTERS)):
        values = _let(values, partial(step, bit=1 << i))
    return values


def joint_failures(found: DataFrame) -> DataFrame:
    """``part`` and arrays of 32 joint-failure counts by bit mask: ``joint``, ``joint_good``, ``joint_toxic``."""
    bits = F.col("bits").cast("int")

    def product(mask: int) -> Column:
        rows = F.col("n_copy") if mask & _DEDUP else F.col("n")
        for i in range(len(FILTERS) - 1):
            if mask >> i & 1:
                rows = rows * F.shiftright(bits, i).bitwiseAND(F.lit(1))
        return rows

    weights = {"joint": F.lit(1), "joint_good": F.col("good").cast("int"), "joint_toxic": F.col("toxic").cast("int")}
    sums = [F.sum(product(m) * w).alias(f"{name}_{m}") for name, w in weights.items() for m in range(_ALL)]
    return found.groupBy("part").agg(*sums).select("part", *[F.array(*[F.col(f"{name}_{m}") for m in range(_ALL)]).alias(name) for name in weights])


def invert(joint: DataFrame) -> DataFrame:
    """Survivors by mask (``kept``, ``kept_good``, ``kept_toxic``) and, by filter, ``fails``, ``unique`` and ``shapley`` (times the number of orders)."""
    kept = lambda c: _subset_sums(_alternate(F.col(c)))
    dividends = _alternate(F.transform("joint", lambda x: -x))
    orders = factorial(len(FILTERS))

    def share(d: Column, bit: int) -> Column:
        # the orders are a multiple of every size of a coalition
        part = F.transform(d, lambda x, m: F.when(m.bitwiseAND(F.lit(bit)) != 0, x * (F.lit(orders) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x)

    single = [1 << i for i in range(len(FILTERS))]
    pick = lambda v: F.array(*[v[s] for s in single])
    return joint.select(
        "part", kept("joint").alias("kept"), kept("joint_good").alias("kept_good"), kept("joint_toxic").alias("kept_toxic"), pick(F.col("joint")).alias("fails"),
        _let(_superset_differences(F.col("joint")), pick).alias("unique"), _let(dividends, lambda d: F.array(*[share(d, s) for s in single])).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each of five filters removes at each step of each of their 120 orders, by part.

    Columns ``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost``, ``shapley``. Null texts count as empty (they fail A, and E where a smaller id has an empty or null
    text); a null part is the empty string; rows without an id are no copies and have no labels; rows that repeat an id
    and its text are counted each, and don't make each other copies. A document is good or toxic if any of its labels
    says so; null labels say nothing. An empty table gives an empty one; other columns are ignored.
    """
    parts = invert(joint_failures(failures(docs, labels, id_col, text_col, part_col)))
    orders = F.explode(F.lit(["".join(p) for p in permutations(FILTERS)])).alias("filter_order")
    steps = parts.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    order, step = F.col("filter_order"), F.col("step")

    def mask(of: Column) -> Column:
        out = F.lit(0)
        for i, f in enumerate(FILTERS):
            out = out + F.when(of.contains(f), F.lit(1 << i)).otherwise(F.lit(0))
        return out

    steps = steps.select("*", mask(F.substring(order, F.lit(1), step - 1)).alias("before"), mask(F.substring(order, F.lit(1), step)).alias("after"), (F.instr(F.lit(FILTERS), F.substring(order, step, F.lit(1))) - 1).alias("f"))
    lost = lambda c: F.col(c)[F.col("before")] - F.col(c)[F.col("after")]
    removed, f = lost("kept"), F.col("f")
    return steps.select(
        "part", "filter_order", step.cast("int").alias("step"), F.col("kept")[F.col("after")].alias("kept"), removed.alias("removed"), (F.col("fails")[f] - removed).alias("redundant"),
        F.col("unique")[f].alias("unique_fails"), lost("kept_good").alias("good_lost"), lost("kept_toxic").alias("toxic_lost"), F.col("shapley")[f].alias("shapley"),
    )
