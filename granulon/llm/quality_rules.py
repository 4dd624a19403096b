"""Quality rules: text statistics, and a decision list of threshold conjunctions learned from labelled documents.

Everything runs as DataFrame expressions. The statistics of a document come from its own row, so the pass over the
texts has no shuffle. Learning sees a grid: each statistic is cut at labelled quantiles, labelled rows are counted by
cell, and every step of the covering asks Spark for one small table (statistic, cut, class, fold -> count), whose size
depends only on the number of cuts.

Defined results: a null or empty text has zero words, so it fails the base rules. Rows may repeat; each gets its own
verdict. Labels that are null or contradict each other for a document are not learned from; without labels the list is
empty and every document that passes the base rules is kept. Columns of the input survive untouched in ``_row``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import materialise, scratch, which, without, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "[#*$%&|<>]"
#: What conditions may test.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / n_words",
    "symbol_rate": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "exclaim_rate": "n_exclaim / n_words",
    "distinct_share": "n_distinct / n_words",
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row`` (all input columns) and the statistics of each text, as bigint; no shuffle, no Python."""
    n = F.size("_w")
    window = lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW)))
    found = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    found = found.select("_row", "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    found = found.select(
        "_row", "_w",
        n.alias("n_words"), F.length(F.array_join("_w", "")).alias("word_chars"), F.regexp_count("_t", F.lit(SYMBOLS)).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"), F.size("_l").alias("n_lines"), F.size(F.array_distinct("_w")).alias("n_distinct"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).alias("n_upper"), F.regexp_count("_t", F.lit("[!?]")).alias("n_exclaim"),
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).alias("_h"),
    )
    # windows that occur twice stand next to each other once sorted by hash
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    found = found.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs)).drop("_h", "_w")
    twice = F.filter("_s", lambda x, i: (x.h == F.get("_s", i - 1).h) | (x.h == F.get("_s", i + 1).h))
    found = found.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x.p))).drop("_s")
    gaps = F.zip_with(F.slice("_p", 2, F.size("_p") - 1), F.slice("_p", 1, F.size("_p") - 1), lambda a, b: F.least(a - b, F.lit(WINDOW)))
    covered = F.when(F.size("_p") > 1, F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_distinct", "n_upper", "n_exclaim")
    found = found.select("_row", *(F.col(c).cast("long").alias(c) for c in longs), covered.cast("long").alias("n_repeat_words"))
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _feature(name: str) -> Column:
    return F.coalesce(F.expr(FEATURES[name].replace("/ n_words", "/ nullif(n_words, 0)").replace("/ word_chars", "/ nullif(word_chars, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)")), F.lit(0.0))


@dataclass
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        f = _feature(self.feature)
        return f > self.cut if self.above else f <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; a document that one of them covers is rejected by the first that does."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        """The number of the first rule that covers a document, null if none does."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules))):
            whole = rule[0].column()
            for c in rule[1:]:
                whole = whole & c.column()
            out = F.when(whole, F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) or "reject nothing"


def learn(labelled: DataFrame, label: str = "quality", cuts: int = 16, max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.9, least_cover: int = 8) -> DecisionList:
    """Sequential covering over statistics with a 0/1 label; rules cover label 0.

    Two thirds of the rows (by hash of the statistics) grow a rule condition by condition, by information gain; the rest
    prunes it to its best prefix, and a rule stays only if its precision there reaches ``least_precision``.
    """
    names = list(FEATURES)
    values = labelled.select(F.col(label).cast("int").alias("_y"), (F.pmod(F.xxhash64(*map(_feature, names)), F.lit(3)) == 0).alias("_prune"), *(_feature(f).alias(f) for f in names)).where("_y in (0, 1)")
    at = [(k + 0.5) / cuts for k in range(cuts)]
    quantiles = values.groupBy("_y").agg(*(F.percentile_approx(f, at, 2000).alias(f) for f in names)).collect()
    edges = {f: sorted({x for row in quantiles for x in (row[f] or [])}) for f in names}
    if len(quantiles) < 2:
        return DecisionList()
    bins = {f: sum(((F.col(f) > x).cast("int") for x in edges[f]), F.lit(0)) for f in names}
    grid = materialise(values.groupBy("_y", "_prune", *(b.alias(f) for f, b in bins.items())).agg(F.count("*").alias("_n")), "grid")

    def counts(inside: Column) -> dict:
        """feature -> cut number -> [grow 0, grow 1, prune 0, prune 1] of the rows above that cut; None: of all rows."""
        long = grid.where(inside).select("_y", "_prune", "_n", F.expr(f"stack({len(names)}, " + ", ".join(f"'{f}', `{f}`" for f in names) + ") as (_f, _b)"))
        out = {f: [[0, 0, 0, 0] for _ in range(len(edges[f]) + 1)] for f in names}
        for r in long.groupBy("_f", "_b", "_y", "_prune").agg(F.sum("_n").alias("n")).collect():
            out[r["_f"]][r["_b"]][2 * r["_prune"] + r["_y"]] += r["n"]
        return out

    def gridded(c: Condition) -> Column:
        b = edges[c.feature].index(c.cut)
        return F.col(c.feature) > b if c.above else F.col(c.feature) <= b

    gain = lambda p, n, p0, n0: p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2)))
    found, left = DecisionList(), F.lit(True)
    while len(found.rules) < max_rules:
        rule: list[Condition] = []
        folds: list[list[int]] = []
        inside = left
        while len(rule) < max_conditions:
            table = counts(inside)
            whole = [sum(x) for x in zip(*table[names[0]], strict=True)]
            best = None
            for f in names:
                below = [0, 0, 0, 0]
                for b, x in enumerate(edges[f]):
                    below = [u + v for u, v in zip(below, table[f][b], strict=True)]
                    for above in (True, False):
                        part = [u - v for u, v in zip(whole, below, strict=True)] if above else below
                        if part[0] >= least_cover and (best is None or gain(part[0], part[1], whole[0], whole[1]) > best[0] + 1e-9):
                            best = (gain(part[0], part[1], whole[0], whole[1]), Condition(f, above, x), list(part))
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            folds.append(best[2])
            inside = inside & gridded(best[1])
            if best[2][1] == 0:
                break
        precision = [(p + 1) / (p + n + 2) for _, _, p, n in folds]
        if not rule or max(precision) < least_precision:
            break
        rule = rule[: precision.index(max(precision)) + 1]
        found.rules.append(rule)
        covered = gridded(rule[0])
        for c in rule[1:]:
            covered = covered & gridded(c)
        left = left & ~covered
    return found


def one_label(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per document: its label, unless it is null or rows disagree."""
    return labels.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_low"), F.max(label).alias("_high")).where("_low = _high").select("_key", F.col("_low").alias("_label"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row`` (the key), ``_t`` (which text), the statistics, ``base_failed``, ``rule`` (number of the learned rule that rejects) and ``kept``.

    The texts are read once: their statistics are written, joined with the labels to learn, and judged.
    """
    stats = statistics(docs.select(key, text), text).select(F.struct(F.col(f"_row.{key}")).alias("_row"), which(f"_row.{key}", f"_row.{text}").alias("_t"), *_columns())
    stats = materialise(stats, "statistics")
    labelled = stats.where(~F.col("base_failed")).join(one_label(labels, key), F.col(f"_row.{key}") == F.col("_key")).drop("_row", "_t")
    rules = learn(labelled, "_label")
    return stats.withColumn("rule", rules.verdict()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def _columns() -> list[str]:
    return ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_distinct", "n_upper", "n_exclaim", "n_repeat_words", "base_failed"]


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with the input's columns: few leave, so those are what the documents are joined with."""
    with scratch(docs.sparkSession):
        gone = materialise(judge(docs, labels, key, text).where("not kept").select("_t.*").distinct(), "rejected", lasting=True)
    return without(docs, gone, key, text)
