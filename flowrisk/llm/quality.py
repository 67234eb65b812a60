"""Operator 7: quality rules as a short-circuit cascade, in the order of rejections per cost."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import words_of
from flowrisk.session import materialize

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` is true for texts to refuse, over the columns of ``base_stats`` and __text."""

    name: str
    rejects: Column


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, for use inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def repeat_positions(hashes: Column) -> Column:
    """Sorted positions of the entries that occur at least twice in an array of 64-bit hashes."""
    def twice(rows: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce(F.get(rows, a)["h"] == F.get(rows, b)["h"], F.lit(False))
        return F.filter(rows, lambda _, i: same(i, i - 1) | same(i, i + 1))

    rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.array_sort(F.transform(let(rows, twice), lambda r: r["p"]))


def covered(positions: Column, width: int) -> Column:
    """Number of places that windows of ``width`` at the sorted ``positions`` cover."""
    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return let(positions, total)


def base_stats(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) of every text.

    Everything is computed inside the row. Windows of five words are compared by 64-bit hashes of
    their words; only texts with a repeated window sort them, in n log n of the text's own length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumns({"__words": words_of(F.col(text_col)),
                             "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    last = F.size("__words") - WINDOW
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(F.col("__words"), i + k) for k in range(WINDOW))))
    step = step.withColumn("__hashes", F.when(last >= 1, window))
    repeated = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    step = step.withColumns({
        f"{prefix}n_words": F.size("__words").cast("long"),
        f"{prefix}word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
        f"{prefix}n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        f"{prefix}n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        f"{prefix}n_repeat_words": F.when(F.col("__hashes").isNotNull() & repeated,
                                          covered(repeat_positions(F.col("__hashes")), WINDOW)).otherwise(F.lit(0)).cast("long"),
    })
    return step.drop("__hashes")


def standard_rules() -> list[Rule]:
    """Rules over the base columns and the text; each rejects some kind of junk and leaves prose alone."""
    n = F.col("n_words")
    return [
        Rule("symbol_ratio", F.col("n_symbols") * 10 > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("duplicate_lines", F.col("n_dup_lines") * 2 > F.size("__lines")),
        Rule("stutter", F.size(F.filter("__words", lambda w, i: w == F.get("__words", i - 1))) * 10 > 3 * n),
        Rule("upper_case", F.regexp_count("__text", F.lit(r"\p{Lu}")) * 10 > 4 * F.col("word_chars")),
        Rule("letters", F.regexp_count("__text", F.lit(r"\p{L}")) * 10 < 6 * F.col("word_chars")),
        Rule("end_marks", F.size(F.filter("__words", lambda w: w.rlike(r"!!$"))) * 10 > 3 * n),
        Rule("table_cells", F.size(F.filter("__words", lambda w: w.rlike(r"^[|]$"))) * 10 > n),
    ]


def cascade_order(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejections per second on ``sample``, most first.

    Each rule runs alone over the sample, which gives both its share of rejections and its cost.
    The order decides what is evaluated, never what is kept.
    """
    rated = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(rule.rejects)).first()[0]
        rated.append((rejected / max(time.perf_counter() - began, 1e-6), rule))
    return [rule for _, rule in sorted(rated, key=lambda x: (-x[0], x[1].name))]


def quality(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Base counts and verdict of every text: one row per input row.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. A null
    text is an empty one. base_failed: fewer than ten words, or over a fifth of them in repeated
    windows; such texts, and those that any rule rejects, are not kept. About ``sample_rows`` rows,
    drawn by a hash of the id and text, rate the rules; then one CASE tries them in that order and stops at the
    first rejection. Repeated rows give repeated results; other columns are ignored.
    """
    rules = standard_rules() if rules is None else rules
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    total = docs.count()
    if total and len(rules) > 1:
        share = min(1.0, sample_rows / total)
        some = rows.where(F.shiftrightunsigned(F.xxhash64("__id", "__text"), 11) < int(share * (1 << 53)))
        rules = cascade_order(materialize(base_stats(some, "__text"), "quality-sample"), rules)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    verdict = F.when(failed, False)
    for rule in rules:
        verdict = verdict.when(rule.rejects, False)
    out = base_stats(rows, "__text").withColumns({"base_failed": failed, "kept": verdict.otherwise(True)})
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")
