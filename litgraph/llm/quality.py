"""Quality rules: a table of thresholds compiled into one projection.

``measures`` are columns over the words, lines and characters of a text; ``RULES`` bounds some of them; ``judge`` adds
the measures and the verdict with built-in functions only, in the scan's own stage, without a shuffle.

Five-word windows are compared by hash first: equal windows have equal hashes, so a text without equal hashes has no
repeated window. Only the others pay for the exact comparison, whose windows are the words themselves.

Cases: a null text is treated like an empty one: no words, every ratio 0, not kept. Very long texts are measured
whole. Repeated rows are judged each. Other columns pass through; one with a measure's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: the word, symbol and base-rule definitions of the contract.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

# Frequent function words of the four languages of the corpus.
STOP_WORDS = ("the and of to in a is that it for on was be with as by this are at from an or "
              "der die und den das von ein eine mit des im zu dem nicht für ist auf sich "
              "le la les et des de du un une en que qui dans est pour sur pas au par il "
              "el los las y del se por con una su lo no al es para como").split()

# measure -> (lowest, highest) that a kept text may have; None is unbounded.
RULES: dict[str, tuple[float | None, float | None]] = {
    "n_words": (MIN_WORDS, None),
    "mean_word_chars": (2.0, 14.0),
    "symbol_ratio": (None, 0.15),
    "stop_word_ratio": (0.04, None),
    "bar_word_ratio": (None, 0.15),
    "capital_word_ratio": (None, 0.4),
    "dup_line_ratio": (None, 0.4),
    "top_word_run_ratio": (None, 0.2),
}


def _hash(x: Column) -> Column:
    return F.xxhash64(x)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _shifted(words: Column, by: int, n: int) -> Column:
    """The words from place ``by`` on, for each place that has ``n`` words from it."""
    return F.slice(words, F.lit(by + 1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def covered(windows: Column, n: int) -> Column:
    """Words inside windows found twice or more: windows sorted with their places, the places of equal neighbours,
    then the union of the places' stretches of ``n`` words."""
    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rest = F.slice(placed, F.lit(2), F.greatest(F.size(placed) - 1, F.lit(0)))
    both = F.zip_with(F.slice(placed, F.lit(1), F.size(rest)), rest,
                      lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    at = F.array_sort(F.array_distinct(F.flatten(both)))
    total = F.aggregate(at, F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum")),
                        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(n), i - acc["last"])).alias("sum")))
    return total["sum"]


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measures of ``text``."""
    t, words, lines = F.coalesce(F.col(text), F.lit("")), F.col("_words"), F.col("_lines")
    step = (df.withColumn("_text", t)
            .withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
            .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
            .withColumn("_hashes", F.transform(words, _hash)))
    hashes = F.col("_hashes")
    window = F.transform(_shifted(hashes, 0, 5), lambda h, i: F.xxhash64(h, *(hashes[i + by] for by in range(1, 5))))
    spelled = F.transform(_shifted(words, 0, 5), lambda w, i: F.concat_ws(" ", w, *(words[i + by] for by in range(1, 5))))
    bare = F.translate("_text", SPACE_CHARS, "")
    n = F.size(words).cast("long")
    step = (step.withColumn("_windows", F.when(F.size(words) >= 5, window).otherwise(F.array().cast("array<bigint>")))
            .withColumn("n_words", n)
            .withColumn("word_chars", F.length(bare).cast("long"))
            .withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
            .withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0))
                        .otherwise(covered(spelled, 5)).cast("long")))
    n_stop = F.size(F.filter(words, lambda w: F.lower(w).isin(list(dict.fromkeys(STOP_WORDS)))))
    n_bar = F.when(F.contains("_text", F.lit("|")), F.size(F.filter(words, lambda w: w == "|"))).otherwise(F.lit(0))
    n_capital = F.size(F.filter(words, lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)))
    runs = F.size(F.filter(_shifted(hashes, 0, 2), lambda h, i: h == hashes[i + 1]))
    return (step.withColumn("mean_word_chars", _ratio(F.col("word_chars"), n))
            .withColumn("symbol_ratio", _ratio(F.col("n_symbols"), n))
            .withColumn("stop_word_ratio", _ratio(n_stop, n))
            .withColumn("bar_word_ratio", _ratio(n_bar, n))
            .withColumn("capital_word_ratio", _ratio(n_capital, n))
            .withColumn("dup_line_ratio", _ratio(F.col("n_dup_lines"), F.size(lines)))
            .withColumn("top_word_run_ratio", _ratio(runs, n))
            .drop("_text", "_words", "_lines", "_hashes", "_windows"))


def verdict(rules: dict[str, tuple[float | None, float | None]]) -> Column:
    """The rule table as one condition."""
    ok = F.lit(True)
    for name, (low, high) in rules.items():
        if low is not None:
            ok = ok & (F.col(name) >= low)
        if high is not None:
            ok = ok & (F.col(name) <= high)
    return ok


def judge(df: DataFrame, text: str = "text", rules: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """``df`` with the measures, base_failed, and kept: false if the base rules fail, else the table's verdict."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (measures(df, text).withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & verdict(RULES if rules is None else rules)))


def keep(df: DataFrame, text: str = "text", rules: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps. The verdict passes a generator, through which no filter is pushed: in a
    filter directly above the measures each use of a measure would be one more copy of its whole expression."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    judged = judge(df.select(row, F.col(text).alias("text")), "text", rules)
    return judged.select("row", F.explode(F.array("kept")).alias("stays")).where("stays").select("row.*")
