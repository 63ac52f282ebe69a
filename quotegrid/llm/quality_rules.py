"""Learned decision lists over text statistics, with built-in functions only.

Sequential covering: rules are grown one threshold condition at a time by FOIL gain on two thirds of the
labelled rows, pruned on the other third, and the rows a rule covers leave the training rows.  Every step is one
aggregate over binned labelled statistics (features x bins rows reach the driver, whatever the input).  The list
becomes one ``CASE WHEN`` expression.

Defined results: null text counts as empty (all counts 0, base failed, not kept).  A null or unmatched label is no
training row; several labels of a document all count.  Repeated documents are kept as rows.  No labelled rows: no
rules, and what passes the base rules stays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quotegrid.session import settle

# White space between words, symbol characters, base rule limits.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What conditions may test: name -> expression over the statistics.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "shout_share": "n_shouts / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda reads it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a ``window``-word run that the array holds twice or more.

    Runs are compared by 64-bit hash.  Most texts repeat nothing and stop at the distinct count;
    the rest sort (hash, position) once, and the covered length is a sum over sorted positions."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            n = F.size(p)
            twin = F.filter(p, lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | ((i + 1 < n) & (F.get(p, i + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def length(at: Column) -> Column:
            reach = F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window))))
            return F.aggregate(reach, F.lit(0), lambda s, x: s + x)

        return let(let(pairs, positions), length)

    runs = let(F.transform(words, lambda w: F.xxhash64(w)),
               lambda each: F.transform(F.sequence(F.lit(1), F.size(each) - window + 1), lambda i: F.xxhash64(F.slice(each, i, window))))
    counted = let(runs, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) > window, counted).otherwise(F.lit(0)).cast("long")


COUNTS = [*BASE, "n_lines", "n_shouts", "n_upper"]


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts of each document; the text is read once."""
    body = F.coalesce(F.col("text"), F.lit(""))
    inner = F.btrim(body, F.lit(SPACE))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    gone = lambda pattern: (F.length("body") - F.length(F.regexp_replace("body", pattern, ""))).cast("long")
    parts = docs.select(*keep, body.alias("body"), words.alias("words"), lines.alias("lines"))
    return parts.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        gone("!").alias("n_shouts"),
        gone(r"\p{Lu}").alias("n_upper"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value < threshold
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.above else value < self.threshold


@dataclass(frozen=True)
class Rule:
    """Rows that meet every condition are rejected; counts are of the pruning rows."""
    conditions: tuple[Condition, ...]
    bad: int
    good: int


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the first rule that holds rejects."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule.conditions:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_rules(labelled: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 3,
                min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """Ordered reject rules from rows with the statistics, ``doc_id`` and ``quality`` (0 bad, 1 good).

    Thresholds are approximate quantiles of all rows and of the bad rows.  ``min_precision`` is the least
    share of bad rows among the pruning rows a rule covers, ``min_cover`` their least number."""
    names = list(FEATURES)
    values = labelled.select("doc_id", (F.col("quality") == 0).alias("bad"), *[F.expr(FEATURES[n]).cast("double").alias(n) for n in names])
    steps = [(i + 1) / (bins // 2 + 1) for i in range(bins // 2)]
    ask = [F.percentile_approx(v, steps, 2000).alias(f"{n}_{k}") for n in names
           for k, v in (("all", F.col(n)), ("bad", F.when(F.col("bad"), F.col(n))))]
    found = values.agg(*ask).first()
    cuts = {n: sorted({x for k in ("all", "bad") for x in found[f"{n}_{k}"] or []}) for n in names}
    cuts = {n: c for n, c in cuts.items() if c}
    if not cuts:
        return []

    def bin_of(n: str) -> Column:
        return sum(((F.col(n) >= c).cast("int") for c in cuts[n]), F.lit(0))

    rows = settle(values.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *[bin_of(n).cast("short").alias(n) for n in cuts]), "binned")

    def holds(c: Condition) -> Column:  # in bins: value >= cuts[k] is bin > k
        k = cuts[c.feature].index(c.threshold)
        return F.col(c.feature) > k if c.above else F.col(c.feature) <= k

    def both(conditions) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & holds(c)
        return out

    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        taken: list[Condition] = []
        before = None
        while len(taken) < max_conditions:
            counts = (left.where(F.col("grow") & both(taken))
                      .select("bad", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in cuts])).alias("x"))
                      .groupBy("x.f", "x.b").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect())
            by = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in cuts}
            for r in counts:
                by[r["f"]][r["b"]] = [r["p"], r["n"]]
            total = [sum(x[i] for x in by[next(iter(cuts))]) for i in (0, 1)]
            before = before or total
            if not total[0] or not total[1]:
                break
            best = None
            for n in cuts:
                low = [0, 0]
                for k, threshold in enumerate(cuts[n]):
                    low = [low[i] + by[n][k][i] for i in (0, 1)]
                    for above, (p, q) in ((False, low), (True, [total[i] - low[i] for i in (0, 1)])):
                        if p < min_cover or p + q == sum(total):
                            continue
                        gain = p * (math.log2(p / (p + q)) - math.log2(total[0] / sum(total)))
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, Condition(n, above, threshold))
            if best is None:
                break
            taken.append(best[1])
        if not taken:
            break
        prefix = left.where(~F.col("grow")).agg(*[F.count_if(both(taken[:i + 1]) & F.col("bad") if k == "p" else both(taken[:i + 1]) & ~F.col("bad")).alias(f"{k}{i}")
                                                  for i in range(len(taken)) for k in "pn"]).first()
        worth = [((prefix[f"p{i}"] - prefix[f"n{i}"]) / max(1, prefix[f"p{i}"] + prefix[f"n{i}"]), -i) for i in range(len(taken))]
        keep = -max(worth)[1]
        p, q = prefix[f"p{keep}"], prefix[f"n{keep}"]
        if p + q < min_cover or p < min_precision * (p + q):
            break
        rules.append(Rule(tuple(taken[:keep + 1]), p, q))
        left = left.where(~both(taken[:keep + 1]))
    return rules


def judge_quality(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` per document; rules learned from the labelled
    documents that pass the base rules."""
    counts = settle(text_statistics(docs).withColumn("base_failed", base_failed()), "statistics")
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", "quality")
    rules = learn_rules(counts.where(~F.col("base_failed")).join(known, "doc_id"), **fit)
    return counts.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def good_documents(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The rows that are kept, all columns as they were.  Texts are judged where they are read, so none is shuffled."""
    counts = settle(text_statistics(docs).withColumn("base_failed", base_failed()), "statistics")
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", "quality")
    rules = learn_rules(counts.where(~F.col("base_failed")).join(known, "doc_id"), **fit)
    boxed = docs.select(F.struct(*docs.columns).alias("row"), "text")  # so that no column clashes with a count
    return text_statistics(boxed, ("row",)).where(~base_failed() & verdict(rules)).select("row.*")


def op1_query(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return judge_quality(read("documents"), read("labels")).select("doc_id", *BASE, "base_failed", "kept")
