"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Counts of a text come first. The rules then run in an order found on a sample: the rule that
rejects the most per second goes first, the next is the one that rejects the most per second of
what is left, and a text that one rule rejects is not looked at by those after it. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import settle

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
PLACE_BITS = 32  # of a packed window; arrays hold fewer than 2^31


@dataclass(frozen=True)
class Rule:
    """`rejects` is a condition on the counts and on text; null counts as false."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    words, chars = F.col("n_words"), F.col("word_chars")
    letters = F.regexp_count(F.col("text"), F.lit("\\p{L}"))
    lettered = F.regexp_count(F.col("text"), F.lit("[^\\x20\\x09-\\x0D\\p{L}]*\\p{L}[^\\x20\\x09-\\x0D]*"))
    dotted = F.regexp_count(F.col("text"), F.lit("(?m)(\\.\\.\\.|\\u2026)[ \\t]*$"))
    bullets = F.regexp_count(F.col("text"), F.lit("(?m)^[ \\t]*[-*\\u2022]"))
    return [
        Rule("word length", (chars < 2 * words) | (chars > 15 * words)),
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("repeated lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("few letters", 10 * letters < 6 * chars),
        Rule("capitals", 2 * F.regexp_count(F.col("text"), F.lit("\\p{Lu}")) > letters),
        Rule("words without letters", 10 * lettered < 8 * words),
        Rule("cut-off lines", 10 * dotted > 3 * F.col("n_lines")),
        Rule("bullet lists", 10 * bullets > 9 * F.col("n_lines")),
    ]


def counted(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to (doc_id, text).

    Windows of three words are hashed and packed with their position into one number, so that
    one sort of numbers brings equal windows together. Neighbours of equal hash are compared word
    by word; where two differ, all windows whose hash occurs twice are sorted by their words.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    parts = F.filter(F.split("text", SPACE, -1), lambda w: w != "")
    docs = docs.withColumn("words", parts)
    docs = docs.withColumn("n_words", F.size("words").cast("long"))
    # Upper bits: 32 of the window's hash; lower bits: its position.
    window = F.transform("words", lambda w, i: F.shiftleft(F.xxhash64(
        w, F.get("words", i + 1), F.get("words", i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")))
    docs = docs.withColumn("sorted", F.when(F.col("n_words") > 3, F.sort_array(F.slice(window, 1, F.col("n_words").cast("int") - 2))))
    same = lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)
    docs = docs.withColumn("twins", F.filter("sorted", lambda x, i: same(x, F.get("sorted", i + 1)) | same(x, F.get("sorted", i - 1))))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    word = lambda p, k: F.get("words", p + k)
    equal = lambda a, b: (word(place(a), 0) == word(place(b), 0)) & (word(place(a), 1) == word(place(b), 1)) & (word(place(a), 2) == word(place(b), 2))
    # Where different windows share a hash, neighbours may hide a repeat: these texts sort the words themselves.
    mixed = F.exists(F.zip_with("twins", F.slice("twins", 2, F.greatest(F.size("twins"), F.lit(1))), lambda a, b: same(a, b) & ~equal(a, b)), lambda x: x)
    named = F.array_sort(F.transform("twins", lambda x: F.struct(
        word(place(x), 0).alias("a"), word(place(x), 1).alias("b"), word(place(x), 2).alias("c"), place(x).alias("place"))))
    docs = docs.withColumn("named", F.when(mixed, named))
    alike = lambda a, b: F.coalesce((a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.lit(False))
    exact = F.transform(F.filter("named", lambda x, i: alike(x, F.get("named", i + 1)) | alike(x, F.get("named", i - 1))), lambda x: x["place"])
    docs = docs.withColumn("spots", F.array_sort(F.when(F.col("named").isNull(), F.transform("twins", place)).otherwise(exact)))
    # A repeated window brings three words, less those that the window before it has brought.
    covered = F.aggregate(
        F.zip_with("spots", F.slice("spots", 2, F.greatest(F.size("spots"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    docs = docs.withColumn("lines", lines)
    # One struct, unnested: a filter on the counts can't be pushed into the steps that make them.
    return docs.select("doc_id", "text", F.inline(F.array(F.struct(
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def reject_of(rule: Rule) -> Column:
    return F.coalesce(rule.rejects, F.lit(False))


def rule_costs(sample: DataFrame, rules: list[Rule], rounds: int = 20, tries: int = 3) -> dict[str, float]:
    """Seconds each rule takes on the sample: the median of some runs over `rounds` copies of it,
    less that of the same run without a rule. A first run, which compiles the plan, doesn't count."""
    copies = sample.withColumn("__round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))

    def seconds(condition: Column) -> float:
        # The copy's number enters the condition, so that it is evaluated for each copy.
        job = copies.agg(F.count_if(condition & (F.col("__round") > 0)))
        took = []
        for _ in range(tries + 1):
            start = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - start)
        return median(took[1:])

    empty = seconds(F.length("text") >= 0)
    return {rule.name: max(seconds(reject_of(rule)) - empty, 1e-4) / rounds for rule in rules}


def ordered_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 1000) -> list[Rule]:
    """The rules by rejections per second, each among the documents that those before it keep,
    measured on about `sample_rows` documents.

    The sample serves this order alone; all rows are judged by all rules they reach.
    """
    sample = docs.sample(min(1.0, sample_rows / max(1, docs.count())), seed=7)
    sample = settle(counted(sample).where(~base_failed()))
    costs = rule_costs(sample, rules)
    # One row for each set of rules that reject a sampled document together.
    together = sample.groupBy(*[reject_of(r).alias(f"r{i}") for i, r in enumerate(rules)]).count().collect()
    groups = [({i for i in range(len(rules)) if row[f"r{i}"]}, row["count"]) for row in together]
    order, left = [], set(range(len(rules)))
    while left:
        gain = {i: (sum(n for who, n in groups if i in who and not who & set(order)) + 1e-3) / costs[rules[i].name] for i in left}
        best = max(sorted(left), key=gain.__getitem__)
        order.append(best)
        left.remove(best)
    return [rules[i] for i in order]


def judged(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """Counts, base_failed, kept and the first rejecting rule (null: none) of every document.

    Null text has no words and fails the base rule; so does empty text. Repeated rows and null
    ids are judged like others. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    cascade = F.when(base_failed(), F.lit("base"))
    for rule in ordered_rules(docs, rules or default_rules(), sample_rows):
        cascade = cascade.when(rule.rejects, F.lit(rule.name))
    return counted(docs).withColumn("base_failed", base_failed()).withColumn("rejected_by", cascade).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rejected_by").isNull().alias("kept"))
