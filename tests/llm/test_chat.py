from granulon.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t, r is not None, r or "", x is not None, x or ""))
    convs = {c: tuple((y[2:]) for y in sorted(v, key=lambda y: (y[0], y[1] or 0, y[2:]))) for c, v in convs.items()}
    out = set()
    for c, v in convs.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in convs.values())
        copies = [d for d, w in convs.items() if w == v]
        if not longer and c == min(copies):
            out.add((c, len(v), len(copies), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, _, x in v)))
    return out


def test_equals_brute_force(spark):
    base = [("user", "hi"), ("assistant", "yo"), ("user", None), (None, ""), ("user", "")]
    rows = [(c, t, *base[t]) for c, n in ((1, 2), (2, 5), (3, 5), (4, 1), (5, 3)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "no"), (7, None, "user", "x"), (7, 0, "user", "y"), (8, 0, "user", "z"), (8, 0, "user", "z"), (None, 0, "user", "hi"), (9, 0, None, "hi"), (10, 0, "", "hi"), (11, 0, "user", "hi " * 9000)]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, n int, last int")
    assert {tuple(r) for r in chat.render(turns).collect()} == brute(rows)
    assert chat.render(turns.limit(0)).count() == 0
