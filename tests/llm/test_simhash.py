import re

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from granulon.llm import components, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(nodes, near):
    label = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[b] < label[a] and near(a, b):
                    label[a], changed = label[b], True
    return label


def near_copies(texts):
    """{doc_id: smallest doc_id reachable} by links of Jaccard similarity of five-word shingles of 0.8 or more."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(low(t))
        sets[d] = frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    linked = {d: [e for e in sets if near(d, e)] for d in sets}
    return brute(sorted(sets), lambda a, b: b in linked[a])


def signed(x):
    return int(np.uint64(x).astype(np.int64))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25))
def test_components_equal_brute_force(spark, pairs):
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    links = {frozenset(p) for p in pairs}
    assert found == brute(nodes, lambda a, b: frozenset((a, b)) in links)


@pytest.mark.parametrize("group", [2048, 12])
def test_links_lose_nothing(spark, group):
    rng = np.random.default_rng(3)
    fps = {0, 2**64 - 1}
    for _ in range(14):  # clusters by random walks of up to four flipped bits, chains included
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(rng.integers(1, 25))):
            fps.add(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                x ^= 1 << int(b)
    base = int(rng.integers(0, 2**64, dtype=np.uint64))
    fps |= {base ^ (1 << i) for i in range(40)} | {base ^ (3 << i) ^ (1 << 63) for i in range(40)}
    fps = sorted(fps)
    found = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), group)
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 64 for r in found.collect())
    got = {r["node"]: r["component"] for r in components.connected_components(found).collect()}
    label = brute([signed(x) for x in fps], lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    assert {x: got.get(x, x) for x in label} == label


def test_documents(spark):
    long = " ".join(f"Word{i * i % 1009}" for i in range(4000))
    texts = [None, "", " \t", "one", "ONE", "one two", "a b c", "A  b\nc", long, long + " tail", long.replace("Word4 ", "word5 ", 1), "Éa É b", "éa é b"] * 2
    docs = spark.createDataFrame([(len(texts) - i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b c", "x", 1), (3, texts[-3], "x", 1)], "doc_id long, text string, fp string, component_id int")
    rows = simhash.components(docs).collect()
    assert len(rows) == len(texts) + 2
    fp = {len(texts) - i: fingerprint(t) for i, t in enumerate(texts)}
    label = brute(sorted(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["fp"] & (2**64 - 1), r["component_id"]) == (fp[r["doc_id"]], label[r["doc_id"]])


def test_keep(spark):
    long = [f"Word{i * i % 1009}" for i in range(1000)]
    edited = lambda n: " ".join("edit" if i % 90 == 7 and i // 90 < n else w for i, w in enumerate(long))
    other = " ".join(f"other{i * i % 977}" for i in range(300))
    texts = [None, "", " \t", "one", "ONE", "one two", "a b c d e f", "A  b\nc d e F", "Éa É b", "éa é b", edited(0), edited(3), edited(11), other, other + " tail", "x " * 9000]
    docs = spark.createDataFrame([(len(texts) - i, t, "x", 1) for i, t in enumerate(texts)] + [(None, other, "x", 1), (2, other, "y", 1), (2, other, "y", 1)], "doc_id long, text string, fp string, component_id int")
    label = near_copies({len(texts) - i: t for i, t in enumerate(texts)})
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: x or -1)
    assert got == [None, *sorted(set(label.values()))]
    unique = {len(texts) - i: t for i, t in enumerate(texts) if len(texts) - i > 2}
    assert {r["doc_id"] for r in simhash.keep(docs.where("doc_id > 2")).collect()} == set(near_copies(unique).values())
    assert simhash.keep(docs.limit(0)).count() == 0


def clusters(rng):
    """Near copies of three texts, chains of edits included, and unrelated texts."""
    texts = {}
    for c in range(3):
        words = [f"c{c}w{i}" for i in range(150)]
        for d in range(100):
            w = list(words)
            for i in rng.integers(0, 150, int(rng.integers(0, 5))):
                w[i] = f"e{rng.integers(10**6)}"
            texts[100 * c + d] = " ".join(w)
    return texts | {1000 + d: " ".join(f"u{rng.integers(5000)}" for _ in range(120)) for d in range(60)}


def star(rng, n, words=200, edits=4, middle=True):
    """A text and n copies with four words replaced: 0.815 similar to it and about 0.69 to each other, so without the text itself none is linked."""
    base = [f"w{i}" for i in range(words)]
    texts = {0: " ".join(base)} if middle else {}
    for d in range(1, n + 1):
        w = list(base)
        for i in rng.choice(np.arange(10, words - 10, 10), edits, replace=False):
            w[i] = f"e{d}x{i}"
        texts[d] = " ".join(w)
    return texts


@pytest.mark.parametrize(("group", "family"), [(2048, 512), (40, 30)])
def test_near_copies_of_a_large_group(spark, group, family):
    """Components as by brute force, in one task, and with large groups and families in parts."""
    texts = clusters(np.random.default_rng(4))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(docs, group=group, family=family).collect()}
    want = near_copies(texts)
    assert all(want[got[d]] == want[d] for d in texts)  # no wrong link
    assert sum(got[d] != want[d] for d in texts) <= 0.01 * len(texts)


@pytest.mark.parametrize(("n", "group", "family"), [(20, 2048, 512), (200, 2048, 512), (200, 40, 30), (3000, 2048, 512)])
def test_star_of_copies_is_one_component(spark, n, group, family):
    texts = star(np.random.default_rng(n), n)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["component_id"] for r in simhash.near_components(docs, group=group, family=family).collect()} == {0}


def test_a_family_without_links_stays_apart(spark):
    rng = np.random.default_rng(7)
    texts = star(rng, 120, middle=False)
    texts |= {200 + d: t + " tail" for d, t in list(texts.items())[:10]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(docs, group=40, family=16).collect()}
    assert got == near_copies(texts) and len(set(got.values())) > 100


def test_alike_is_exact():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 40, int(rng.integers(0, 60)))) for _ in range(50)] + [np.arange(5000), np.arange(400, 5000), np.arange(2000)]
    got = simhash._alike(sets[:40], sets[20:])
    for i, x in enumerate(sets[:40]):
        for j, y in enumerate(sets[20:]):
            union = len(np.union1d(x, y))
            assert got[i, j] == (5 * len(np.intersect1d(x, y)) >= 4 * union)
    assert simhash._alike(sets[-3:], sets[-3:]).tolist() == [[True, True, False], [True, True, False], [False, False, True]]


def test_stars():
    rng = np.random.default_rng(6)
    fp, more = (np.sort(rng.permutation(4096)[:50]).astype(np.uint64), rng.permutation(4096)[:50].astype(np.uint64))
    where = {int(x): i for i, x in enumerate(fp)}
    d = lambda i, j: int(np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(more[i] ^ more[j]))
    for most in (0, 4, 6, 7, 8, 12):
        a, b = simhash._stars(fp, more, most)
        edges = {frozenset((where[int(x)], where[int(y)])) for x, y in zip(a, b, strict=True)}
        nodes = list(range(50))
        want = brute(nodes, lambda i, j: d(i, j) <= most)
        assert want == brute(nodes, lambda i, j: frozenset((i, j)) in edges)
        assert len(edges) == 50 - len(set(want.values()))


def test_test_data(spark):
    from granulon.llm.queries import op5_simhash

    d = "/root/testdata/sf0.001"
    fp = {r["doc_id"]: fingerprint(r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    label = brute(sorted(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op5_simhash(spark, d).collect()} == {k: (f"{fp[k]:016x}", label[k]) for k in fp}


def test_candidates_of_a_large_group_lose_no_link(spark, monkeypatch):
    import random

    rng = random.Random(11)
    monkeypatch.setattr(simhash, "LEADERS", 4)
    far = [sum(rng.getrandbits(16) << 16 * j for j in range(1, 8)) | 12345 for _ in range(30)]  # one segment in common
    # neighbours differ by three bits of each other 16-bit piece; some have a chain of two
    move = lambda x, at: x ^ sum(7 << 16 * j + at for j in range(1, 8))
    whole = far + [move(x, 0) for x in far] + [move(move(x, 0), 5) for x in far[:10]]
    low, signed = (1 << 64) - 1, lambda x: x - (x >> 63 << 64)
    rows = [(signed(x & low), signed(x >> 64), [12345]) for x in whole]
    nodes = spark.createDataFrame(rows, "fp long, more long, segments array<long>")
    near = {(i, j) for i in range(len(whole)) for j in range(i) if (whole[i] ^ whole[j]).bit_count() <= simhash.WIDE_DISTANCE}

    def component(pairs, n=len(whole)):
        root = list(range(n))
        for _ in range(n):
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    at = {r[0]: k for k, r in enumerate(rows)}
    got = {(at[r["a"]], at[r["b"]]) for r in simhash.candidates(nodes, 16, group=8).collect()}
    assert len(near) == 40 and component(got) == component(near)
