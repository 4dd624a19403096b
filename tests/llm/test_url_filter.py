import hashlib
import math
import re
from collections import Counter

import pytest

from granulon.llm import url_filter
from granulon.llm.queries import URL_RULES

N = url_filter.ORDER


def parse(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(t), t, say) for say, t in URL_RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


def brute(urls):
    """(host, path, rule, verdict) of each URL, and the scores."""
    rows = [(*parse(u), *rule_of(*parse(u))) for u in urls]
    held = [hashlib.md5((h + p).encode()).hexdigest()[0] < "5" for h, p, _, _ in rows]
    text = ["\x02" * N + h + p + "\x03" for h, p, _, _ in rows]
    n = {(say, k): Counter() for say in ("block", "allow") for k in range(N + 1)}
    seen = set()
    for t, (_, _, _, say), out in zip(text, rows, held):
        for i in range(N, len(t)):
            seen.add(t[i])
            for k in range(N + 1):
                if say and not out:
                    n[say, k][t[i - k : i + 1]] += 1
    of = {(say, k): Counter() for say in ("block", "allow") for k in range(N + 1)}
    for (say, k), c in n.items():
        for g, x in c.items():
            of[say, k][g[:-1]] += x

    def p(say, t, i):
        q = 1 / len(seen)
        for k in range(N + 1):
            q = (n[say, k][t[i - k : i + 1]] + 4 * q) / (of[say, k][t[i - k : i]] + 4)
        return q

    scores = []
    for t in text:
        r = [math.floor(1e6 * (math.log(p("block", t, i)) - math.log(p("allow", t, i))) + 0.5) for i in range(N, len(t))]
        scores.append(sum(r) / len(r))
    bucket = [math.floor(x / url_filter.BUCKET) for x in scores]
    cal = [(b, say) for b, (_, _, _, say), out in zip(bucket, rows, held) if say and out]
    red, ok = sum(s == "block" for _, s in cal), sum(s == "allow" for _, s in cal)
    trained = {say for (_, _, _, say), out in zip(rows, held) if say and not out}
    least = None
    if red and ok and len(trained) == 2:
        least = min((sum(s == "block" and b < c for b, s in cal) * ok + sum(s == "allow" and b >= c for b, s in cal) * red, c) for c in {b for b, _ in cal})[1]
    return [(h, q, r, say or ("block" if least is not None and b >= least else "allow")) for (h, q, r, say), b in zip(rows, bucket)], scores


def urls():
    out = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/7x?q=1", "https://a.example.com/en/1#x", "ftp://net/de/1", "http://x.net/de/2?", "http://y.org/es/9", "http://x.org/fr/é日本", "http://x.org/" + "long/" * 3000, "http://m.example.net/de/8/8", "a://b://c/d"]
    for i in range(60):
        out += [f"http://spam{i % 7}.example.com/en/{i}", f"https://news{i % 5}.example.net/de/{i * 7}", f"http://spam{i % 9}.example.org/fr/{i}", f"http://news{i % 4}.example.org/fr/{i}"]
    return out


def run(spark, values):
    pages = spark.createDataFrame([(i, u, "c", 1, "r") for i, u in enumerate(values)], "page_id long, url string, host string, score int, rule string")
    return {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, URL_RULES).select("_row.page_id", "host", "path", "rule", "verdict", "score").collect()}


@pytest.mark.parametrize("rows", [500_000, 0])
def test_equals_brute_force(spark, rows):
    values = urls() + urls()[4:9]
    want, scores = brute(values)
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(values)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES, broadcast_rows=rows).select("_row.page_id", "host", "path", "rule", "verdict", "score").collect()}
    assert {v for _, _, r, v in want if r is None} == {"allow", "block"}
    for i in range(len(values)):
        assert tuple(got[i])[1:5] == want[i] and got[i]["score"] == pytest.approx(scores[i], abs=1), values[i]


def test_one_class_empty_tables_and_keep(spark):
    only = [u for u in urls() if rule_of(*parse(u))[1] != "allow"]
    got = run(spark, only)
    assert all(got[i][3] == (rule_of(*parse(u))[1] or "allow") for i, u in enumerate(only))
    assert run(spark, []) == {}
    pages = spark.createDataFrame([(1, "http://a.org/es/1", "h"), (1, "http://a.org/es/1", "h"), (2, None, None), (3, "http://net/de/1", "h")], "page_id long, url string, host string")
    kept = url_filter.keep(pages, URL_RULES)
    assert kept.columns == pages.columns and sorted(r["page_id"] for r in kept.collect()) == [2, 3]


def test_evidence_of_a_whole_context(spark):
    """Two hosts that differ in one digit only, far from the path that the model must not be misled by, have different scores."""
    got = run(spark, urls() + ["http://zz1.example.org/fr/1", "http://zz2.example.org/fr/1", "http://spam1.example.org/it/1", "http://news1.example.org/it/1"])
    last = [got[k][4] for k in sorted(got)[-4:]]
    assert last[0] != last[1] and last[2] > last[3]
