"""Quality rules whose cutoffs come from the data: one quantile sketch per language and source.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.text import let, window_hashes, words
from shelfmark.operators import stage

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
WINDOW = 5  # words of a window in the repetition rule
SALTS = 32  # the rows of one language and source are spread over so many join keys


SPREAD = 6  # quartile distances from a quartile to the cutoff
PRIOR = 10  # documents that a language's cutoff weighs in its sources', and that of all in a language's


@dataclass(frozen=True)
class Rule:
    """Reject what lies beyond ``upper quartile + SPREAD * (upper - lower quartile)``.

    The measure is ``1000 * part / whole``, cut to an integer; ``low`` looks
    below the lower quartile instead. ``least`` is the smallest quartile distance
    that is reckoned with, a bin or so. A text is rejected only for ``excess``
    more of the part (or fewer) than the cutoff leaves it, so that a few
    characters do not decide on a short one.
    """

    part: str
    whole: str
    least: int
    excess: int
    low: bool = False


# symbols a word, capitals a character, punctuation marks a word, characters a word
RULES: Mapping[str, Rule] = {
    "symbols": Rule("n_symbols", "n_words", least=5, excess=8),
    "capitals": Rule("n_capitals", "word_chars", least=1, excess=8),
    "marks": Rule("n_marks", "n_words", least=5, excess=8),
    "long_words": Rule("word_chars", "n_words", least=32, excess=40),
    "short_words": Rule("word_chars", "n_words", least=32, excess=40, low=True),
}


def repeated_words(tokens: Column, k: int = WINDOW) -> Column:
    """Words inside windows of k words that are found twice or more in the text.

    Windows are compared by 64-bit hash within one text. Only a text with equal
    windows pays for finding where they are.
    """

    def covered(sorted_windows: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before = F.get(sorted_windows, i - 1)["h"].eqNullSafe(x["h"])
            return before | F.get(sorted_windows, i + 1)["h"].eqNullSafe(x["h"])

        starts = F.sort_array(F.transform(F.filter(sorted_windows, twin), lambda x: x["at"]))
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(k)), F.lit(k))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    def count(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, let(by_hash, covered)).otherwise(0)

    return let(window_hashes(tokens, k), count).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (the whole row) with the base measures and the parts of the rules."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    body = F.coalesce(F.col("doc")[text], F.lit(""))
    rows = rows.withColumn("w", words(body))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count(body, F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("n_marks"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _permille(rule: Rule) -> Column:
    part, whole = F.col(rule.part), F.col(rule.whole)
    value = F.when(whole > 0, 1000 * part - F.pmod(1000 * part, whole)) / whole
    return F.coalesce(value, F.lit(0)).cast("long")


def sketches(rows: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """Quantile sketches: counts per bin of a measure, by lang and source.

    Bins are exact up to 63, then 32 to every power of two, so an edge is within
    1/32 below the values of its bin, and a sketch has at most some 2000 bins
    whatever it has seen. Sketches merge by adding counts, in any order, with
    equal results.
    """
    values = F.array(*[F.struct(F.lit(n).alias("rule"), _permille(r).alias("v")) for n, r in rules.items()])
    return (
        rows.where("NOT base_failed")
        .select("lang", "source", F.explode(values).alias("x"))
        .select("lang", "source", "x.rule", "x.v")
        .withColumn("edge", F.expr("v - v % shiftleft(1L, greatest(length(bin(v)) - 6, 0))"))
        .groupBy("lang", "source", "rule", "edge")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cutoffs(sketch: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """(lang, source, cut_<rule>...) from sketches.

    Sketches merge to languages and to all; the cutoffs of a language lean on
    those of all, and a source's on its language's, with the weight of PRIOR
    documents. So a small group has nearly its language's cutoffs, a large one
    its own, and no size switches between them.
    """
    none = F.lit(None).cast("string")
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), none.alias("s")),
        F.struct(F.lit(2).alias("level"), none.alias("l"), none.alias("s")),
    )
    merged = (
        sketch.select("rule", "edge", "n", F.explode(levels).alias("g"))
        .groupBy("g.level", F.col("g.l").alias("lang"), F.col("g.s").alias("source"), "rule", "edge")
        .agg(F.sum("n").alias("n"))
    )
    group = Window.partitionBy("level", "lang", "source", "rule")  # the bins of one sketch
    upto = group.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})

    def of_rule(field: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for n, r in rules.items() for x in (n, getattr(r, field))]), F.col("rule"))

    spread = SPREAD * F.greatest(F.col("high") - F.col("low"), of_rule("least"))
    cut = F.when(of_rule("low"), F.greatest(F.col("low") - spread, F.lit(0))).otherwise(F.col("high") + spread)
    fences = (
        ranked.groupBy("level", "lang", "source", "rule")
        .agg(
            F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("edge"))).alias("low"),
            F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("edge"))).alias("high"),
            F.first("total").alias("total"),
        )
        .select("level", F.col("lang").alias("l"), F.col("source").alias("s"), "rule", "total", cut.alias("cut"))
    )
    want = sketch.select("lang", "source").distinct().select("lang", "source", F.explode(levels).alias("g"))
    same = (
        (F.col("g.level") == F.col("level"))
        & F.col("g.l").eqNullSafe(F.col("l"))
        & F.col("g.s").eqNullSafe(F.col("s"))
    )
    found = want.join(fences, same).groupBy("lang", "source", "rule")
    found = found.agg(
        *[F.max(F.when(F.col("level") == i, F.col(c))).alias(f"{c}{i}") for i in range(3) for c in ("cut", "total")]
    )
    leaning = F.expr(f"(total1 * cut1 + {PRIOR} * cut2) div (total1 + {PRIOR})")
    found = found.withColumn("cut1", leaning).withColumn(
        "cut", F.expr(f"(total0 * cut0 + {PRIOR} * cut1) div (total0 + {PRIOR})")
    )
    return found.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == n, F.col("cut"))).alias(f"cut_{n}") for n in rules]
    )


def judged(rows: DataFrame, cuts: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """rows (with lang, source, the measures) plus the cutoffs and ``kept``.

    A left join by language and source, NULLs alike. Where the cutoffs are too
    many for Spark to broadcast, salts spread the rows of a hot group.
    """
    salted = cuts.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = salted.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = rows.join(
        salted,
        (F.col("salt") == F.col("salt_"))
        & F.col("lang").eqNullSafe(F.col("lang_"))
        & F.col("source").eqNullSafe(F.col("source_")),
        "left",
    ).drop("salt", "salt_", "lang_", "source_")
    fine = ~F.col("base_failed")
    for name, rule in rules.items():
        beyond = 1000 * F.col(rule.part) - F.col(f"cut_{name}") * F.col(rule.whole)
        beyond = -beyond if rule.low else beyond
        fine = fine & F.coalesce(beyond <= 1000 * rule.excess, F.lit(True))
    return joined.withColumn("kept", fine)


def quality_measures(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, base measures, cutoffs, kept.

    NULL and empty texts have no words and fail the base rules. Repeated rows
    are judged one by one, alike. A NULL language or source is a group of its
    own. Texts of any length are measured whole. An empty table gives an empty
    one. Other columns of ``docs``, whatever their names, are not read.
    """
    rows = measured(docs).select(
        F.col("doc.doc_id").alias("doc_id"),
        F.col("doc.lang").alias("lang"),
        F.col("doc.source").alias("source"),
        *BASE,
        "n_capitals",
        "n_marks",
    )
    rows = stage(rows, "quality")  # numbers only; the texts are read once
    return judged(rows, cutoffs(sketches(rows))).drop("lang", "source")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass all rules, with their columns; edge cases as in ``quality_measures``.

    The measures are written beside the rows that pass the base rules, so that
    texts are measured once.
    """
    named = ("doc", F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"))
    rows = measured(docs).where("NOT base_failed").select(*named, *BASE, "n_capitals", "n_marks")
    rows = stage(rows, "measured", compression="zstd")
    sketch = sketches(rows.drop("doc"))
    return judged(rows, cutoffs(sketch)).where("kept").select("doc.*")
