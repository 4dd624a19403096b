import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from granulon.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
MINE = pieces.Pieces(PATH)
TEXTS = [None, "", " ", "   two  spaces ", "Hello World\n\ttabs", "é ü ß œ 日本語 👍🏽 \x00", "▁mark", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalisation" * 40, "abcabcabd" * 300, "<s> </s> <unk> <0x41>"]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8") | st.sampled_from("abcdeth  nin"), max_size=90))
def test_equals_library(text):
    assert MINE.encode(text) == LIB.encode(text)


def test_texts_round_trip(spark):
    for t in TEXTS:
        assert MINE.encode(t) == (LIB.encode(t) if t else [])
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS + TEXTS[:2])], "doc_id long, text string, ids int")
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, PATH), PATH).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS))
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_window_is_bounded():
    """However long a run without a forced boundary is, no more than some windows are held, and paths meet on the way."""
    seen, original = [], MINE._meet
    MINE._meet = lambda last: (seen.append(len(last)), original(last))[1]
    try:
        for text in ("the quick brown fox " * 400, "internationalisation" * 500, "abcabcabd" * 900, "a" * 5000):
            seen.clear()
            before, marked = MINE.commits, pieces.MARK + text.replace(" ", pieces.MARK)
            assert MINE._ids(MINE.stream(iter(marked))) == LIB.encode(text)
            assert max(seen, default=0) <= 6 * MINE.longest and MINE.commits - before > len(text) // (6 * MINE.longest)
    finally:
        del MINE._meet


def test_the_stream_commits_on_documents(spark):
    """Whole texts, without the memory of segments: the same ids, and commits at every word at least."""
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").collect():
        marked = pieces.MARK + (r["text"] or "").replace(" ", pieces.MARK)
        before = MINE.commits
        assert MINE._ids(MINE.stream(iter(marked))) == LIB.encode(r["text"] or "") or not r["text"]
        assert MINE.commits - before >= marked[1:].rstrip(pieces.MARK).count(pieces.MARK) - marked.count(pieces.MARK * 2)


def test_every_new_segment_goes_through_the_stream():
    fresh, seen = pieces.Pieces(PATH), []
    original = fresh.stream
    fresh.stream = lambda word: (seen.append(word), original(word))[1]
    assert fresh.encode("some words, some words\n\nand more") == LIB.encode("some words, some words\n\nand more")
    assert set(seen) >= {"▁some", "▁words", "▁more"} and len(seen) == len(set(seen))


def test_columns_of_texts():
    column = pa.array(TEXTS * 2 + ["", None, "  x", "x  ", "  "], pa.string())
    for part in (column, column[3:9], column[:0]):
        ids, begin = MINE.encode_column(part)
        want = [LIB.encode(t) if t else [] for t in part.to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == want
        assert MINE.decode_column(ids.astype(np.int64), begin).to_pylist() == [(t or "").replace("▁", " ") for t in part.to_pylist()]
    odd = [MINE.byte_id[0xE9], MINE.byte_id[0x41], 1, -5, 10**6]
    assert MINE.decode_column(np.array(odd), np.array([0, 0, 2, 5])).to_pylist() == ["", "\ufffdA", ""]


def test_query_keeps_every_row(spark, tmp_path):
    from granulon.llm.queries import op1_sentencepiece

    rows = [(None, "no id"), (None, None), (7, "one text"), (7, "another text"), (7, "one text"), (8, "▁mark"), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op1_sentencepiece(spark, str(tmp_path)).select("doc_id", "n_pieces", "restored").collect()]
    want = [(d, len(LIB.encode(t)) if t else 0, t != "▁mark") for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert MINE.encode(r["text"]) == LIB.encode(r["text"])


def test_chunks_of_one_segment_are_remembered_once():
    fresh = pieces.Pieces(PATH)
    fresh.encode_column(pa.array(["one two three one two"]))
    assert fresh.place and not {pieces.MARK + x for x in fresh.place} & set(fresh.known)
