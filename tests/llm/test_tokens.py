import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granulon.llm import packing, simple8b, token_files, tokens
from granulon.llm.common import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
TEXTS = [None, "", " \n\t ", "Hello, World's  best\n\nend.", "don't''s 'LL 12a3 ½²x ªº µ", "Éçà é ŉ İstanbul ΑΣ Σ ΟΔΟΣ.", "a<|endoftext|>b <|startoftext|> <|x", "日本語 テスト　x y\x1cz\x85q", "word### ***| ­​zero 👍🏽", "x" * 3000, "the and " * 4000, "'s't're", "a\x00b \x0b\x0c c"]


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def docs(spark):
    return spark.createDataFrame([(10 * len(TEXTS) - i if i != 3 else None, t, 7, "c") for i, t in enumerate(TEXTS)] + [(5, "twin", 1, ""), (5, "twin", 1, "")], "doc_id long, text string, start int, ids string")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from("ab'sT.,#é \ń"), max_size=30), max_size=4))
def test_encoder_equals_library(texts):
    got, begin = tokens.encoder(PATH).encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert got[begin[k] : begin[k + 1]].tolist() == ids(t), t


def test_encoder_asks_the_library_once_for_each_pre_token(monkeypatch):
    fresh, asked = tokens.WordEncoder(PATH), []
    count = fresh._count
    monkeypatch.setattr(fresh, "_count", lambda names: asked.append(names) or count(names))
    texts = ["word, other", "word. other;", "Other word,", "word"]
    for t in texts:
        assert fresh.encode(pa.array([t]))[0].tolist() == ids(t)
    assert sorted(x for names in asked for x in names) == sorted({"word", "other", ",", ".", ";"})
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 3)  # a cache that is cleared again and again
    got, begin = fresh.encode(pa.array(TEXTS, pa.string()))
    assert [got[begin[k] : begin[k + 1]].tolist() for k in range(len(TEXTS))] == [ids(t) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1) | st.integers(0, 50_000) | st.integers(0, 2**64 - 1), max_size=3000))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, firsts, escapes = simple8b.encode(v)
    assert (simple8b.decode(words, firsts, escapes, len(v)) == v).all()
    # the last block decodes by itself
    if len(firsts) > 1 and not len(escapes):
        k = len(firsts) - 1
        assert (simple8b.decode(words[firsts[k] :], np.zeros(1, np.uint32), escapes, len(v) - k * 1024) == v[k * 1024 :]).all()


def test_files_round_trip(spark, monkeypatch):
    for frame in (token_files.FRAME, 64):
        monkeypatch.setattr(token_files, "FRAME", frame)
        path = shared_path(spark, "test")
        token_files.write(docs(spark), path, PATH)
        rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
        want = sorted(((r["doc_id"], r["text"]) for r in docs(spark).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
        start = 0
        for r, (doc_id, text) in zip(rows, want, strict=True):
            assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (doc_id, start, [*ids(text), 2])
            start += r["n_tokens"]


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    path = shared_path(spark, "test")
    token_files.write(none, path, PATH)
    assert token_files.read(spark, path).count() == 0
    assert packing.pack(none, PATH).count() == 0


def test_packing_is_whole_and_unpadded(spark):
    for capacity in (2048, 16):
        pieces = packing.pack(docs(spark), PATH, capacity=capacity)
        rows = pieces.collect()
        by_seq, by_doc = {}, {}
        for r in rows:
            assert len(r["ids"]) == 4 * r["length"]
            by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            by_doc.setdefault(r["doc_id"], []).append(r)
        for parts in by_seq.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= capacity and at & (at - 1) == 0
        for i, t in enumerate(TEXTS):
            own = sorted(by_doc[10 * len(TEXTS) - i if i != 3 else None], key=lambda r: r["start"])
            whole = b"".join(r["ids"] for r in own)
            assert np.frombuffer(whole, "<u4").tolist() == [*ids(t), 1] and own[0]["doc_tokens"] == len(whole) // 4
        assert sorted(r["length"] for r in packing.sequences(pieces).collect()) == sorted(sum(n for _, n in x) for x in by_seq.values())


def test_packing_cuts_little_and_keeps_counts(spark):
    """One partition: no padding, about one cut for each sequence, and of each class as many whole documents in a bin as the class says."""
    rng = np.random.default_rng(5)
    texts = [" ".join("ab" for _ in range(int(n))) for n in rng.integers(1, 300, 400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = packing.pack(table, PATH, capacity=256).collect()
    sequences = {r["sequence_id"] for r in rows}
    cuts = len(rows) - len(texts)
    assert cuts <= len(sequences) + 8 + sum(r["length"] == 256 for r in rows)
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= total // 256 + 9
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append(r)
    kinds = {min(32, 256 // b[0]["length"]) for b in bins.values()}
    assert len(kinds) >= 3


def test_digests_of_test_data(spark):
    from granulon.llm.queries import op2_token_files, op7_packing

    d = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    start = 0
    for r in sorted(op2_token_files(spark, d).collect(), key=lambda r: r["doc_id"]):
        own = np.array([*ids(text[r["doc_id"]]), 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    for r in op7_packing(spark, d).collect():
        own = np.array([*ids(text[r["doc_id"]]), 1], "<u4")
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(own), zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()))


def test_simple8b_selectors_are_the_greedy_ones():
    """Each word takes the first selector whose values fit, whatever the widths; checked value by value."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        values = rng.integers(0, 1 << 62, int(rng.integers(1, 2600))).astype(np.uint64) >> rng.integers(0, 62, 1).astype(np.uint64)[0]
        values = np.where(rng.random(len(values)) < 0.1, values, values & np.uint64(3))
        want = []
        for begin in range(0, len(values), simple8b.BLOCK):
            block, at = values[begin : begin + simple8b.BLOCK].tolist(), 0
            block += [0] * (simple8b.BLOCK - len(block))
            while at < simple8b.BLOCK and begin + at < len(values):
                fit = [s for s in range(1, 15) if all(x >> int(simple8b.WIDTH[s]) == 0 for x in block[at : at + int(simple8b.COUNT[s])])]
                want.append(fit[0] if fit else 0)
                at += int(simple8b.COUNT[want[-1]])
        words, firsts, escapes = simple8b.encode(values)
        assert (words >> np.uint64(60)).astype(int).tolist() == want
        assert (simple8b.decode(words, firsts, escapes, len(values)) == values).all()
