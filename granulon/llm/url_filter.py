"""URL filter: host and path rules, and for all other URLs the ratio of two character Markov models of variable order.

URLs that a rule accepts train one model and URLs that a rule rejects the other, but for a third of them (by hash), which calibrates. A model
backs off through contexts of ``ORDER`` to zero characters, p_k = (n(context_k, c) + S p_(k-1)) / (n(context_k) + S): a context counts as much as
it has been seen, and one never seen leaves the shorter one's estimate, so the order follows the data. Characters are taken as they
are, so what is gathered grows with the corpus. A URL's score is the mean log ratio of its characters in millionths; the cut between
the classes is the one with the least balanced error over the URLs held out. All of it is DataFrame expressions.

Scale: the distinct grams with their counts are one table, from which each order's estimates follow by joins on shorter grams, which are smaller tables
yet. Scoring joins each character's gram with its ratio by equality; the ratios are broadcast only if they are few (``broadcast_rows``).

Defined results: a null URL, or one without ``://``, has empty host and path and is scored like any empty text; repeated rows
each get a verdict; if either class has no URL to learn from or to calibrate on, what no rule judges is allowed. All input columns survive in ``_row``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import materialise, sized

ORDER, SMOOTHING, BUCKET = 5, 4.0, 20_000
#: Marks before a URL's first character and after its last.
START, END = "\x02", "\x03"
#: URLs whose host and path have a digest that begins with a lesser digit calibrate, the others train: five in sixteen.
HELD_OUT = "5"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; rules are (verdict, host/path)."""
    name = verdict = F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])):
        of, _, start = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def marked(host: Column, path: Column) -> Column:
    """The characters a model sees, between start and end marks."""
    return F.concat(F.lit(START * ORDER), host, path, F.lit(END))


def log_ratios(grams: DataFrame) -> DataFrame:
    """From gram, rejected, accepted (counts of the last character after the ones before it): gram, ratio in millionths."""
    shorter = None
    for k in range(ORDER + 1):  # g: a character after k others
        found = grams.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("rejected").alias("r"), F.sum("accepted").alias("a"))
        if k == 0:
            whole = found.agg(F.sum("r").alias("of_r"), F.sum("a").alias("of_a"), F.count("*").alias("v"))
            found = found.crossJoin(F.broadcast(whole)).withColumns({f"q{c}": F.lit(1.0) / F.col("v") for c in "ra"})  # one row
        else:
            context = found.groupBy(F.substring("g", 1, k).alias("c")).agg(F.sum("r").alias("of_r"), F.sum("a").alias("of_a"))
            found = found.select("*", F.substring("g", 1, k).alias("c"), F.substring("g", 2, k).alias("t")).join(context, "c").join(shorter, "t")
        estimate = lambda c: (F.col(c) + SMOOTHING * F.col(f"q{c}")) / (F.col(f"of_{c}") + SMOOTHING)
        shorter = found.select(F.col("g").alias("t"), estimate("r").alias("qr"), estimate("a").alias("qa"))
    return shorter.select(F.col("t").alias("gram"), F.round(1e6 * (F.ln("qr") - F.ln("qa"))).cast("long").alias("ratio"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", columns: list[str] | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """``_row`` (the input's columns), host, path, rule, verdict and score."""
    host, path = host_and_path(F.col("_u"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select(F.struct(*(columns or ["*"])).alias("_row"), F.col(url).alias("_u")).select("_row", host.alias("host"), path.alias("path"))
    parsed = parsed.select("_row", "host", "path", name.alias("rule"), verdict.alias("by_rule"), marked(F.col("host"), F.col("path")).alias("_s"), F.monotonically_increasing_id().alias("_id"))
    parsed = parsed.withColumn("_held", F.substring(F.md5(F.concat("host", "path")), 1, 1) < HELD_OUT)
    parsed = materialise(parsed, "urls")
    cut = F.transform(F.sequence(F.lit(1), F.length("_s") - ORDER), lambda i: F.substr("_s", i, F.lit(ORDER + 1)))
    each = parsed.select("_id", F.when(~F.col("_held"), F.col("by_rule")).alias("train"), F.explode(cut).alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.when(F.col("train") == "block", 1)).alias("rejected"), F.count(F.when(F.col("train") == "allow", 1)).alias("accepted"))
    counts = materialise(counts, "grams")
    ratios = materialise(log_ratios(counts), "ratios")
    scored = each.select("_id", "gram").join(sized(ratios, broadcast_rows), "gram")
    scores = materialise(scored.groupBy("_id").agg((F.sum("ratio") / F.count("*")).alias("score")), "scores")
    found = parsed.drop("_s").join(scores, "_id").drop("_id")
    least = calibrate(found.where("_held")) if parsed.where("not _held").agg(F.count_distinct("by_rule")).first()[0] == 2 else None
    by_model = F.when(F.floor(F.col("score") / BUCKET) >= least, "block").otherwise("allow") if least is not None else F.lit("allow")
    return found.select("_row", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")


def calibrate(scored: DataFrame) -> int | None:
    """The lowest bucket of scores to block: least sum of both classes' error rates over held-out URLs, then the lowest; None without both classes."""
    rows = scored.where("by_rule is not null").groupBy(F.floor(F.col("score") / BUCKET).alias("b")).agg(F.count(F.when(F.col("by_rule") == "block", 1)).alias("r"), F.count(F.when(F.col("by_rule") == "allow", 1)).alias("a")).orderBy("b").collect()
    r, a = sum(x["r"] for x in rows), sum(x["a"] for x in rows)
    if not r or not a:
        return None
    best, below_r, below_a = None, 0, 0
    for x in rows:  # cross-multiplied, so that ties are exact
        error = below_r * a + (a - below_a) * r
        if best is None or error < best[0]:
            best = (error, x["b"])
        below_r, below_a = below_r + x["r"], below_a + x["a"]
    return best[1]


def keep(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """The allowed pages, with the input's columns."""
    return judge(pages, rules, url).where("verdict = 'allow'").select("_row.*")
