"""Fill-in-middle transformation by a regular expression whose counts are of its row.

``regexp_count`` gives a text's number n of units. A pattern made for the row, ``(unit{a}+)(unit{b-a}+)(rest)``, then
captures prefix, middle and suffix in one match: a replacement made for the row puts them between the marks. Counted
possessive groups are matched by a loop, without backtracking and without a stack, so a text may have millions of
units. ``restore`` cuts an output at its marks, which no transformed text contains, and joins the parts in their order.
All of it is built-in functions in the scan's own stage, without a shuffle.

Cases: a null text is treated like an empty one, which stays plain with n = 0. A text that contains a mark stays plain.
Very long texts are cut whole, prefix, middle or suffix may be empty. A null key draws as the empty string does. Repeated
rows are transformed each, rows of one key and one n alike. An empty table gives no rows. Other columns pass through; one
with the name of an output (n, form, prefix_chars, middle_chars, output; restored) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: units, marks and shares of the contract.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED_PERCENT, SPM_PERCENT = 90, 20

ATOM = "(?:[A-Za-z]++|[^A-Za-z])"
ANY_MARK = f"{PREFIX}|{SUFFIX}|{MIDDLE}"


def draws(key: Column) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``1:`` and the key as text."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with n, form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and the output."""
    step = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("own"),
                     *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col(key)), 1)))
    step = step.select("*", F.regexp_count("own", F.lit(UNIT)).cast("long").alias("n"))
    plain = (F.col("own") == "") | F.col("own").rlike(ANY_MARK) | (F.pmod("h3", F.lit(100)) >= TRANSFORMED_PERCENT)
    form = F.when(plain, "plain").when(F.pmod("h4", F.lit(100)) < SPM_PERCENT, "spm").otherwise("psm")
    x, y = F.pmod("h1", F.col("n") + 1), F.pmod("h2", F.col("n") + 1)
    step = step.select("row", "own", "n", form.alias("form"), F.least(x, y).alias("a"), F.abs(x - y).alias("between"))
    pattern = F.concat(F.lit(r"(?s)\A(" + ATOM + "{"), F.col("a").cast("string"), F.lit("}+)(" + ATOM + "{"),
                       F.col("between").cast("string"), F.lit(r"}+)(.*)\z"))
    shape = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("own")).otherwise(F.regexp_replace("own", pattern, shape))
    step = step.select("row", "n", "form", output.alias("output"))
    step = step.select("*", parts(F.col("form"), F.col("output")).alias("cut"))
    kept = [F.col(f"row.`{c}`") for c in df.columns if c.lower() not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    return step.select(*kept, "n", "form", F.length("cut.prefix").cast("long").alias("prefix_chars"),
                       F.length("cut.middle").cast("long").alias("middle_chars"), "output")


def parts(form: Column, output: Column) -> Column:
    """Prefix, middle and suffix of an output as one struct; null if it is plain."""
    cut = F.split(output, ANY_MARK, -1)
    first, second, third = (F.element_at(cut, i) for i in (2, 3, 4))
    return F.when(form == "psm", F.struct(first.alias("prefix"), third.alias("middle"), second.alias("suffix"))).when(
        form == "spm", F.struct(second.alias("prefix"), third.alias("middle"), first.alias("suffix")))


def restore(df: DataFrame, form: str = "form", output: str = "output") -> DataFrame:
    """``df`` with the exact text that ``output`` was made of, as ``restored``."""
    cut = parts(F.col(form), F.col(output))
    joined = F.concat(cut["prefix"], cut["middle"], cut["suffix"])
    return df.withColumn("restored", F.when(F.col(form) == "plain", F.col(output)).otherwise(joined))
