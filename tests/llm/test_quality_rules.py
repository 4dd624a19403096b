import re
from collections import Counter

import pytest

from granulon.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "  \n\t ", "one two", "a b c d e a b c d e f", "x " * 40, "a b c d e f\n\na b c d e f\nzz\nzz\r\n", "#* $% plain & <tag> |", "é ü \x1f\x85 nbsp\xa0here " * 3, "w" * 5000 + " b" * 30, "a a a a a a", " ".join(f"w{i % 7}" for i in range(50)), " ".join(f"w{i}" for i in range(3000)) + " w1 w2 w3 w4 w5 w6"]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if twice[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, _row int, _w double")


def test_statistics_equal_brute_force(spark):
    docs = frame(spark, [(i, t, "clash", 1, 2.0) for i, t in enumerate(TEXTS + TEXTS[:3])])
    got = {r["doc_id"]: r for r in quality_rules.statistics(docs).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    for i, t in enumerate(TEXTS + TEXTS[:3]):
        assert tuple(got[i])[1:] == brute(t), (i, t and t[:40])


@pytest.fixture(scope="module")
def corpus():
    rows = []
    for i in range(600):
        junk = i % 3 == 0
        rows.append((i, " ".join((f"word{(i * 7 + k) % 997}" + ("###" if junk else "")) for k in range(12 + i % 40)), int(not junk)))
    return rows


def test_learned_list_separates_and_keeps_clean(spark, corpus):
    docs = frame(spark, [(i, t, "c", 1, 0.0) for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, y if i % 11 else None, 0) for i, _, y in corpus if i % 2], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_rules.keep(docs, labels).collect()}
    assert kept == {i for i, _, y in corpus if y}
    assert quality_rules.keep(docs, labels).columns == docs.columns


def test_no_labels_and_empty_tables(spark):
    docs = frame(spark, [(1, "a b c d e f g h i j k", "c", 1, 0.0), (1, "a b c d e f g h i j k", "c", 1, 0.0), (None, None, None, None, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in quality_rules.judge(docs, labels).orderBy("n_words").collect()] == [False, True, True]
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_contradicting_labels_are_left_out(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, None)], "doc_id long, quality int")
    assert [tuple(r) for r in quality_rules.one_label(labels).collect()] == [(2, 1)]
