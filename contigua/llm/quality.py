"""Quality rules: a threshold table compiled into one projection of native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, symbol characters and short function words of the four languages.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "der die das und ist nicht ein eine mit von zu den für auf "
    "le la les de des et un une est que dans pour sur du en "
    "el los las y se del por con para al una"
).split()

#: measure, lower bound, upper bound (None: open); a row is kept when every measure lies within its bounds.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.05),
    ("stop_word_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.5),
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters that aren't ASCII white space."""
    return F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda x: x != "")


def _repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more."""
    n = F.size(words)

    def cover(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False)))

        def spots(e: Column) -> Column:
            found = F.filter(F.transform(s, lambda x, j: F.when(F.get(e, j) | F.coalesce(F.get(e, j - 1), F.lit(False)), x["i"])), lambda i: i.isNotNull())
            return _let(F.sort_array(found), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long")))

        return _let(same, spots)

    windows = F.arrays_zip(F.slice(words, 1, n - 2).alias("a"), F.slice(words, 2, n - 2).alias("b"), F.slice(words, 3, n - 2).alias("c"), F.sequence(F.lit(0), n - 3).alias("i"))
    return F.when(n >= 4, _let(F.array_sort(windows), cover)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of all counts of one text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)

    def of_words(w: Column) -> Column:
        stops = F.array(*[F.lit(x) for x in dict.fromkeys(STOP_WORDS)])
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(list(dict.fromkeys(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        )

    return _let(words_of(t), of_words)


def compile_rules(m: Column, rules: list[tuple[str, float | None, float | None]] | None = None) -> Column:
    """The threshold table as one boolean expression over a struct of ``measures``."""
    per_word = lambda x: x / F.greatest(m["n_words"], F.lit(1))
    ratio = {
        "n_words": m["n_words"].cast("double"),
        "repeat_word_ratio": per_word(m["n_repeat_words"]),
        "mean_word_chars": per_word(m["word_chars"]),
        "symbol_ratio": m["n_symbols"] / F.greatest(m["word_chars"], F.lit(1)),
        "stop_word_ratio": per_word(m["n_stop_words"]),
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
    }
    ok = F.lit(True)
    for name, low, high in RULES if rules is None else rules:
        if low is not None:
            ok = ok & (ratio[name] >= F.lit(float(low)))
        if high is not None:
            ok = ok & (ratio[name] <= F.lit(float(high)))
    return ok


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, float | None, float | None]] | None = None) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document, one output row per input row.

    Null texts count as empty (no words: base fails). Repeated rows give repeated results; an empty table gives an
    empty one; other columns are ignored, whatever their names. No shuffle, no user function.
    """
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), measures(F.col(f"`{text_col}`")).alias("m"))
    m = F.col("m")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return out.select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & compile_rules(m, rules)).alias("kept"), m["n_stop_words"].alias("n_stop_words"), m["n_lines"].alias("n_lines"),
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    Null and empty texts have no words and go; repeated rows are judged alike; an empty table gives an empty one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = docs.select(whole, measures(F.col(f"`{text_col}`")).alias("m"))
    m = F.col("m")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return kept.filter(~failed & compile_rules(m)).select("row.*")
