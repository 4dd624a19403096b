"""Word-level byte-pair ids with the tokenizers library, for whole Arrow columns.

The word vocabulary never looks across white space, so a text's ids are those of its space-separated chunks. Each
column is split and dictionary-encoded by Arrow, and only chunks not seen before go to the library: plain Latin ones
as ready-made pre-tokens in one call (only those not seen before), all others through the full tokenizer. Both caches are Arrow columns,
looked up by Arrow, and bounded.

Defined results: a null or empty text, or one of white space only, has no ids (and just the end id in ``encode_with_end``); equal texts have equal ids;
an empty column gives no ids; a text of any length is encoded whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks for which lower-casing is one character to one and NFC changes nothing.
SIMPLE = r"^[\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{17f}]*$"
#: Fixed value: the split pattern of the vocabulary file.
PRETOKEN = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
CACHED_CHUNKS = 1_000_000


class Cache:
    """Strings and the ids of each: a column, and where each one's ids begin in one array, and how many there are."""

    def __init__(self):
        self.names = pa.array([], pa.string())
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, names: pa.Array) -> np.ndarray:
        """The place of each name, or -1."""
        return pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        self.start, self.count = np.concatenate([self.start, start + len(self.ids)]), np.concatenate([self.count, count.astype(np.int32)])
        self.ids, self.names = np.concatenate([self.ids, ids]), pa.concat_arrays([self.names, names])

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at some places, one after another, and how many each has."""
        count = self.count[places].astype(np.int64)
        ends = np.cumsum(count)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - self.start[places], count)], count


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # ids that end a pre-token
        self.last = np.zeros(self.full.get_vocab_size(), bool)
        self.last[[k for x, k in self.full.get_vocab(with_added_tokens=False).items() if x.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.chunks, self.pre = Cache(), Cache()

    def _pieces(self, pre: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after another, and how many each has."""
        coded = pre.dictionary_encode()
        place = self.pre.find(coded.dictionary)
        new = np.flatnonzero(place < 0)
        if len(new):
            names = coded.dictionary.take(pa.array(new))
            ids, per = self._count(names.to_pylist())
            place[new] = len(self.pre.names) + np.arange(len(new))
            self.pre.add(names, ids, np.cumsum(per) - per, per)
        return self.pre.of(place[coded.indices.to_numpy()])

    def _count(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pre-tokens, and how many each has: up to its last one."""
        ids = np.array(self.bare.encode_batch_fast([names], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        full, ends = np.array([bool(x) for x in names]), np.flatnonzero(self.last[ids])
        per = np.zeros(len(names), np.int64)
        if len(ends) == full.sum() and (not len(ids) or ends[-1] == len(ids) - 1):
            per[full] = np.diff(ends, prepend=-1)
            return ids, per
        done = self.bare.encode(names, is_pretokenized=True, add_special_tokens=False)
        return np.array(done.ids, np.uint32), np.bincount(np.array(done.word_ids, np.int64), minlength=len(names))

    def _learn(self, chunks: pa.Array) -> None:
        low = pc.utf8_lower(chunks)
        simple = pc.and_(pc.match_substring_regex(chunks, SIMPLE), pc.invert(pc.match_substring(chunks, "<|"))).to_numpy(zero_copy_only=False)
        letters = pc.match_substring_regex(low, r"^\p{L}+$").to_numpy(zero_copy_only=False) & simple
        pieces = np.zeros(len(chunks), np.int64)
        # pre-tokens in chunk order: letters stay whole, other simple chunks are cut, the rest is left to the full tokenizer
        mixed = np.flatnonzero(simple & ~letters)
        cut = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(low.take(pa.array(mixed)), PRETOKEN, "\\1 "), " "), " ")
        flat, lengths = self._pieces(pa.concat_arrays([low.take(pa.array(np.flatnonzero(letters))), cut.flatten()]))
        pieces[letters] = lengths[: letters.sum()]
        owner = np.repeat(np.arange(len(mixed)), np.diff(cut.offsets.to_numpy()))
        pieces[mixed] = np.bincount(owner, lengths[letters.sum() :], minlength=len(mixed)).astype(np.int64)
        hard = np.flatnonzero(~simple)
        rest = [x.ids for x in self.full.encode_batch(chunks.take(pa.array(hard)).to_pylist(), add_special_tokens=False)]
        pieces[hard] = [len(x) for x in rest]
        order = np.concatenate([np.flatnonzero(letters), mixed, hard])
        sizes = pieces[order]
        begin = np.zeros(len(chunks), np.int64)
        begin[order] = np.cumsum(sizes) - sizes
        self.chunks.add(chunks, np.concatenate([flat, np.array([i for x in rest for i in x], np.uint32)]), begin, pieces)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids begin (one more entry than texts); null is empty."""
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        chunks = words.dictionary
        place = self.chunks.find(chunks)
        if len(self.chunks.names) + np.count_nonzero(place < 0) > CACHED_CHUNKS:
            self.clear()
            place[:] = -1
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.chunks.names) + np.arange(len(new))
            self._learn(chunks.take(pa.array(new)))
        ids, count = self.chunks.of(place[words.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(count)])
        offsets = lists.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker and vocabulary file."""
    return WordEncoder(path)


def encode_with_end(path: str, texts: pa.Array, end_id: int, most_bytes: int = 1 << 25):
    """Yield (first text, ids, begins) for slices of a column, with ``end_id`` after each text's ids."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most_bytes)))
        ids, begin = encoder(path).encode(texts[first:last])
        n = last - first
        out = np.empty(len(ids) + n, np.uint32)
        at = begin[1:] + np.arange(n)
        mask = np.ones(len(out), bool)
        mask[at] = False
        out[at], out[mask] = end_id, ids
        yield first, out, begin + np.arange(n + 1)
        first = last
