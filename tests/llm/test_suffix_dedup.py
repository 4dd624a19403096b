import hashlib

import numpy as np
import pytest

from granulon.llm import suffix_dedup


def brute(rows):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha256)}; equal rows are one."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                x = b[i : i + 50]
                first[x] = min(first.get(x, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d, t] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def found(spark, rows, **sizes):
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, spans int, copy string").repartition(3)
    got = suffix_dedup.remove(docs, **sizes).collect()
    assert len(got) == len(rows) and all(r["_row"]["copy"] == "k" for r in got)
    return {(r["_row"]["doc_id"], r["_row"]["text"]): (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got}


def corpus():
    rng = np.random.default_rng(8)
    voc = ["".join(rng.choice(list("abcdeé "), int(rng.integers(2, 9)))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(voc, n))
    passage, line = prose(40), "-" * 120
    rows = [(int(i), prose(int(rng.integers(1, 60)))) for i in range(60)]
    rows += [(100 + i, f"{prose(6)} {passage} {prose(6)}") for i in range(30)]  # a shared passage
    rows += [(200 + i, f"{line}{prose(3)}{line[: 60 + i]}") for i in range(12)]  # runs of one byte
    rows += [(300 + i, "common gram of thirty bytes on " + prose(8)) for i in range(90)]  # one anchor, many segments
    rows += [(20, rows[3][1]), (21, rows[3][1]), (22, rows[3][1] + "x" * 60), (400, None), (401, ""), (402, "é" * 40), (403, "é" * 60), (404, passage[1:]), (None, passage), (404, passage), (404, passage)]
    rows += [(500, "ab" * 5000), (501, "ab" * 3000 + "c"), (502, passage * 3)]
    return rows


@pytest.mark.parametrize(("most", "limit", "slice_bytes"), [(64, 64 << 20, 4 << 20), (4, 64 << 20, 700), (4, 1500, 5000)])
def test_equals_brute_force(spark, most, limit, slice_bytes):
    rows = corpus()
    assert found(spark, rows, most=most, limit=limit, slice_bytes=slice_bytes) == brute(rows)


def test_small_tables(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None), (2, ""), (None, None)]) == brute([(1, None), (2, ""), (None, None)])
    one = [(5, "x" * 49), (4, "x" * 50), (6, "x" * 51)]
    assert found(spark, one) == brute(one)


def test_anchors_belong_to_windows():
    """Equal windows have their anchor at the same place, wherever they stand."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    where = {}
    for value, _, at, shift, count in zip(*suffix_dedup.segments(data, np.array([0, 1000, 1010, 4000])), strict=True):
        for k in range(count):
            w = data[at + k : at + k + 50].tobytes()
            assert where.setdefault(w, (value, shift - k)) == (value, shift - k) and 0 <= shift - k <= 26
