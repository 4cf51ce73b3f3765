"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Boolean column that is true where a document fails. Cost and
selectivity of each rule are measured on a bounded sample of rows chosen by hash
from the whole table, then the rules run in order of rejections per second inside
one CASE, so that a document stops at its first failure; its words are cut once.
A rule's cost is the time of a warm pass over the sample, repeated until it holds
``SAMPLE_WORK`` bytes, less that of a pass that only cuts words. The order changes
only the cost and the column ``failed_rule``, never the verdict.

Defined results: a null or empty text has no words and fails ``too_few_words``;
null doc_ids and repeated rows are judged row by row; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]"
#: Rows on which rule costs and selectivities are measured.
SAMPLE_ROWS = 400
#: Longer texts are left out of that sample, so that the driver holds 26 MB at most.
SAMPLE_BYTES = 1 << 16
#: Bytes of text that each timed pass turns over, by repeating the sample.
SAMPLE_WORK = 1 << 20


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and name it inside ``use``."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(words: Column, n: Column, k: int = 5) -> Column:
    """Words that lie in a k-word window found at least twice, each counted once."""

    def window(i: Column, hashes: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])

    def covered(h: Column) -> Column:
        size = F.size(h)
        bits = F.length(F.bin(size.cast("long")))  # enough for a position
        mask = F.shiftleft(F.lit(1).cast("long"), 0)

        def of_packed(packed: Column, low: Column) -> Column:
            at = lambda j: F.get(packed, j).bitwiseAND(low).cast("int")
            same = lambda i, j: F.get(h, at(i)) == F.get(h, at(j))
            twins = F.filter(
                F.sequence(F.lit(0), size - 1),
                lambda j: ((j > 0) & F.coalesce(same(j, j - 1), F.lit(False))) | ((j < size - 1) & F.coalesce(same(j, j + 1), F.lit(False))),
            )
            return let(
                F.sort_array(F.transform(twins, at)),
                lambda p: F.aggregate(
                    F.sequence(F.lit(0), F.size(p) - 1),
                    F.lit(0).cast("long"),
                    lambda total, j: total + F.when(j + 1 < F.size(p), F.least(F.lit(k), F.get(p, j + 1) - F.get(p, j))).otherwise(k),
                ),
            )

        def pack(low: Column) -> Column:
            packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
            return let(packed, lambda q: of_packed(q, low))

        return let(F.call_function("shiftleft", mask, bits) - 1, pack)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda wh: F.transform(F.sequence(F.lit(0), n - k), lambda i: window(i, wh)))
    return F.when(
        n > k,
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))),
    ).otherwise(F.lit(0).cast("long"))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))


@dataclass(frozen=True)
class Rule:
    """``fails(measures)`` is true where a document is rejected; ``measures`` maps a name to a column."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


#: Base rules come first in name only; their order is measured like that of the rest.
BASE_RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 20),
)
MORE_RULES = (
    Rule("symbols", lambda m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("duplicate_lines", lambda m: m["mostly_dup_lines"]),
    Rule("word_length", lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 15)),
    Rule("capitals", lambda m: m["n_capitals"] * 2 > m["word_chars"]),
)
RULES = BASE_RULES + MORE_RULES


def with_words(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, text.alias("_text")).withColumn("_words", words_of(F.col("_text")))


def measures(text: Column | None = None, words: Column | None = None) -> dict[str, Column]:
    """Measures of a text and its words, by default over the columns of ``with_words``."""
    text = F.col("_text") if text is None else text
    words = F.col("_words") if words is None else words
    n = F.size(words)
    lines = lines_with_words(text)
    long = lambda c: c.cast("long")
    return {
        "n_words": long(n),
        "word_chars": long(F.char_length(text) - F.regexp_count(text, F.lit(SPACE))),
        "n_symbols": long(F.regexp_count(text, F.lit("[#*$%&|<>]"))),
        "n_dup_lines": let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))),
        "mostly_dup_lines": let(lines, lambda x: (F.size(x) >= 4) & ((F.size(x) - F.size(F.array_distinct(x))) * 10 > F.size(x) * 5)),
        "n_repeat_words": repeated_words(words, n),
        "n_capitals": long(F.regexp_count(text, F.lit("[A-Z]"))),
    }


def _sample(docs: DataFrame, rows: int) -> list[str | None]:
    """About ``rows`` texts, chosen by a hash of the row's place among all rows; long ones are left out."""
    share = min(1.0, rows / max(1, docs.count()))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))
    chosen = docs.select("text", place.alias("place")).where(F.col("place") < math.ceil(share * (1 << 30)))
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES
    return [r["text"] for r in chosen.where(short).select("text").collect()]


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules by measured rejections per second on about ``sample_rows`` rows, best first."""
    texts = _sample(docs, sample_rows)
    if not texts:
        return [{"rule": rule, "cost_s": 0.0, "selectivity": 0.0} for rule in rules]
    times = max(1, min(100, SAMPLE_WORK // max(1, sum(len(t or "") for t in texts))))
    sample = docs.sparkSession.createDataFrame([(t,) for t in texts], "text string").select(F.coalesce("text", F.lit("")).alias("_text"))
    often = sample.coalesce(1).select("_text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("again"))

    def passed(fails: Callable[[dict[str, Column]], Column]) -> tuple[int, float]:
        failed = let(words_of(F.col("_text")), lambda w: fails(measures(F.col("_text"), w)))
        one = often.agg(F.coalesce(F.sum(failed.cast("long")), F.lit(0)).alias("n"))
        rejected = one.collect()[0]["n"]  # plans, compiles and warms
        began = time.perf_counter()
        one.collect()  # one task without a shuffle: it runs anew
        return rejected, time.perf_counter() - began

    found = []
    _, base = passed(lambda m: m["n_words"] < 0)
    for rule in rules:
        rejected, cost = passed(rule.fails)
        # Differences below a twentieth of the words' own cost are not told apart.
        found.append({"rule": rule, "cost_s": max(cost - base, base / 20), "selectivity": rejected / (times * len(texts))})
    return sorted(found, key=lambda x: -(x["selectivity"] + 1e-6) / x["cost_s"])


def first_failure(ordered: list[Rule], m: dict[str, Column]) -> Column:
    """Name of the first rule that a row fails, null if none; later rules are not evaluated."""
    chain = None
    for rule in ordered:
        failed = F.coalesce(rule.fails(m), F.lit(False))
        chain = F.when(failed, rule.name) if chain is None else chain.when(failed, rule.name)
    return chain if chain is not None else F.lit(None).cast("string")


def score_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All base measures and the verdict for each row of ``docs``."""
    ordered = [x["rule"] for x in rule_order(docs, rules, sample_rows)]
    every = measures()
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    lazy = {k: v for k, v in every.items() if k not in shown}
    measured = with_words(docs, "doc_id").select("doc_id", "_text", *[every[k].alias(k) for k in shown])
    m = {k: F.col(k) for k in shown} | lazy
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.fails(m)
    judged = measured.select("doc_id", *shown, base.alias("base_failed"), first_failure(ordered, m).alias("failed_rule"))
    return judged.select("doc_id", *shown, "base_failed", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), "failed_rule")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs``, all columns, that pass every rule; measures are computed only as far as the cascade needs them."""
    ordered = [x["rule"] for x in rule_order(docs, rules, sample_rows)]
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.where(let(words_of(text), lambda w: first_failure(ordered, measures(text, w)).isNull()))
