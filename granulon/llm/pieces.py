"""SentencePiece encoding and decoding, streaming: bounded windows with converging backpointers.

For merge-ranked models the best segmentation of a prefix is unique: it ends in the one piece whose pairing with the piece before it survives the
merges. So each position of a text has one backpointer, found among the pieces that end there, and needs only the positions of the
last ``longest piece`` characters. The paths of all positions that later ones can still reach are followed back, and once they
meet at one boundary the ids before it are final and leave: memory is bounded by the window, not by the text.
Where no piece joins two neighbouring characters, every path has a boundary, so there the stream commits at once. Segments between such boundaries
repeat a lot: their ids are remembered, and ``stream`` encodes each that is new, whatever its length.
(A sum of piece scores, as for unigram models, does not reproduce this model's own ids; pairing does, exactly.)

Spaces become the word mark, with one in front of the text, as the model's normaliser does; characters without a piece become
their UTF-8 bytes' pieces. Decoding joins pieces and bytes, invalid bytes as replacement characters.
Defined results: a null or empty text has no ids; no ids decode to an empty text; unknown or control ids decode to nothing.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, CACHED, PAIRS, ROWS = "▁", 400_000, 150_000, 2048


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.rank = {self.names[i]: model.get_score(i) for i in plain}
        self.bytes = {model.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        #: Neighbours that some piece holds; between any others every path has a boundary.
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pair: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.commits = 0
        assert not any(p[i] == MARK != p[i - 1] for p in self.ids for i in range(1, len(p))), "a piece joins a word mark to a character before it"
        table = [bytes([self.bytes[i]]) if i in self.bytes else n.replace(MARK, " ").encode() if n in self.ids else b"" for i, n in enumerate(self.names)]
        self.raw, self.raw_count = np.frombuffer(b"".join(table), np.uint8), np.array([len(x) for x in table], np.int64)
        self.raw_start = np.cumsum(self.raw_count) - self.raw_count
        self._forget()

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string by merging the best-ranked neighbours, leftmost first."""
        parts, rank = list(text), self.rank
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and r > best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: str, piece: str) -> bool:
        key = (before, piece)
        got = self.pair.get(key)
        if got is None:
            if len(self.pair) > PAIRS:
                self.pair.clear()
            apart = before and before[-1] + piece[0] not in self.inner
            got = self.pair[key] = bool(apart) or self.merged(before + piece) == ([before, piece] if before else [piece])
        return got

    def _words(self, chunk: str):
        """A chunk cut where no piece joins its characters, so where the paths of every position after it meet."""
        inner, start = self.inner, 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in inner:
                yield chunk[start:i]
                start = i
        yield chunk[start:]

    def stream(self, characters):
        """Yield the pieces of a stream of characters; holds only the window whose paths have not met."""
        ids, inner, longest = self.ids, self.inner, self.longest
        held, last = "", [""]  # pending characters; the last piece of the best path to each position (position 0 is final)
        for c in characters:
            if held and held[-1] + c not in inner:  # no path crosses here
                out = self._back(last, len(held))
                self.commits += 1
                yield from out
                held, last = "", [out[-1]]
            held += c
            i, found = len(held), None
            for n in range(1, min(longest, i) + 1):
                piece = held[i - n :]
                if last[i - n] is not None and (n == 1 or piece in ids) and self.fits(last[i - n], piece):
                    found = piece
                    break
            last.append(found)
            if i > longest:
                at = self._meet(last)
                if at:
                    out = self._back(last, at)
                    self.commits += 1
                    yield from out
                    held, last = held[at:], [out[-1], *last[at + 1 :]]
        if held:
            yield from self._back(last, len(held))

    def _meet(self, last: list) -> int:
        """The boundary that the paths from all positions still in reach have in common."""
        open_ = {i for i in range(max(0, len(last) - self.longest), len(last)) if last[i] is not None}
        while len(open_) > 1:
            i = max(open_)
            open_.remove(i)
            open_.add(i - len(last[i]))
        return open_.pop()

    def _back(self, last: list, at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _ids(self, pieces) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte_id[b] for b in p.encode()]
        return out

    def _segment(self, chunk: str) -> list[int]:
        """The ids of a chunk; segments between forced boundaries are remembered, and ``stream`` finds those that are new."""
        out: list[int] = []
        for word in self._words(chunk):
            got = self.known.get(word)
            if got is None:
                got = self._ids(self.stream(word))
                if len(word) <= 64 and len(word) < len(chunk):  # a chunk that is one segment is remembered as a chunk
                    if len(self.known) > CACHED:
                        self.known.clear()
                    self.known[word] = got
            out += got
        return out

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _places(self, chunks: list[str]) -> np.ndarray:
        """Where the ids of each chunk (without its word mark) are in ``flat``."""
        found = [self.place.get(x, -1) for x in chunks]
        new = [x for x, k in zip(chunks, found, strict=True) if k < 0]
        if len(self.place) + len(new) > CACHED:
            self._forget()
            new = chunks
        if new:
            got = [self._segment(MARK + x.replace(" ", MARK)) for x in new]
            count = np.array([len(x) for x in got], np.int64)
            self.start = np.concatenate([self.start, np.cumsum(count) - count + len(self.flat)])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, np.array([i for x in got for i in x], np.int32)])
            for x in new:
                self.place[x] = len(self.place)
            found = [self.place[x] for x in chunks]
        return np.array(found, np.int64)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (one more entry than texts)."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        begin = lists.offsets.to_numpy().astype(np.int64)
        begin = begin - begin[0]
        blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(~blank)
        owner = np.repeat(np.arange(len(lists)), np.diff(begin))
        # spaces before a word belong to its chunk, spaces at the end of a text are a chunk of their own
        before = np.append(-1, at[:-1]) if len(at) else at
        run = at - 1 - np.maximum(before, begin[owner[at]] - 1)
        place = np.full(len(flat), -1, np.int64)
        plain = at[run == 0]
        used, where = np.unique(code[plain], return_inverse=True)
        chunks = [names[k] for k in used]
        spaced = at[run > 0]
        chunks += [" " * n + names[code[k]] for k, n in zip(spaced.tolist(), run[run > 0].tolist(), strict=True)]
        ends, filled = begin[1:] - 1, np.diff(begin) > 0
        tail_of = np.flatnonzero(filled & blank[np.maximum(ends, 0)] & (pc.binary_length(texts).to_numpy() > 0)) if len(flat) else np.zeros(0, np.int64)
        last = np.full(len(lists), -1, np.int64)
        np.maximum.at(last, owner[at], at)
        tail = ends[tail_of] - np.maximum(last[tail_of], begin[tail_of] - 1)
        chunks += [" " * (n - 1) for n in tail.tolist()]
        if len(set(chunks)) < len(chunks):
            distinct = list(dict.fromkeys(chunks))
            number = {x: k for k, x in enumerate(distinct)}
            found = self._places(distinct)[[number[x] for x in chunks]]
        else:
            found = self._places(chunks)
        n, m = len(used), len(used) + len(spaced)
        place[plain], place[spaced], place[ends[tail_of]] = found[:n][where], found[n:m], found[m:]
        full = place >= 0
        count = np.zeros(len(flat), np.int64)
        count[full] = self.count[place[full]]
        total = np.concatenate([[0], np.cumsum(count)])
        starts, own = self.start[place[full]], count[full]
        done = np.cumsum(own)
        ids = self.flat[np.arange(done[-1] if len(done) else 0) - np.repeat(done - own - starts, own)]
        return ids, total[begin]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_column(pa.array([text], pa.string()))[0].tolist()

    def decode_column(self, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
        """The texts of rows of ids: one gather over the table of the pieces' bytes."""
        ok = (ids >= 0) & (ids < len(self.names))
        k = np.where(ok, ids, 0)
        count = np.where(ok, self.raw_count[k], 0)
        ends = np.cumsum(count)
        raw = self.raw[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - self.raw_start[k], count)]
        offsets = np.append(0, ends)[begin].astype(np.int32)
        rows = pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        try:
            texts = rows.cast(pa.string())
        except pa.ArrowInvalid:  # some bytes' pieces are no valid text
            texts = pa.array([x.decode("utf-8", "replace") for x in rows.to_pylist()], pa.string())
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 23):
    """The batch in slices of at most ``ROWS`` rows and, but for single rows, about as many bytes of a column."""
    each = -(-batch.column(column).nbytes // max(1, len(batch)))
    step = int(max(1, min(ROWS, most_bytes // max(1, each))))
    return (batch.slice(k, step) for k in range(0, len(batch), step))


def _kinds(df: DataFrame, columns: tuple[str, ...]) -> str:
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (array of int) and some of the input's columns, one row for each row; a narrow pass."""

    def ids(batches):
        for b in batches:
            for part in _slices(b, 1):
                found, begin = pieces(model).encode_column(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *part.columns[2:]], names=["doc_id", "ids", *columns])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"), *columns).mapInArrow(ids, "doc_id long, ids array<int>" + _kinds(docs, columns))


def decode(coded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids", columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and some of the input's columns, one row for each row."""

    def texts(batches):
        for b in batches:
            for part in _slices(b, 1):
                lists = pc.fill_null(part.column(1), [])
                begin = lists.offsets.to_numpy().astype(np.int64)
                found = pieces(model).decode_column(pc.fill_null(lists.flatten(), -1).to_numpy().astype(np.int64), begin - begin[0])
                yield pa.RecordBatch.from_arrays([part.column(0), found, *part.columns[2:]], names=["doc_id", "text", *columns])

    return coded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("i"), *columns).mapInArrow(texts, "doc_id long, text string" + _kinds(coded, columns))
