"""Token ids of whole Arrow batches, with the tokenizers library asked once per distinct piece.

A text is cut where its tokenizer is sure to cut it too, so the ids of the pieces in a row are
the ids of the text. Words repeat, and the library then sees each distinct piece once per worker.
Ids are those of the library's ``encode(text, add_special_tokens=False)``, so the marker of an added
token in a text, such as ``<|endoftext|>``, gets that token's id; texts with one are encoded whole.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa

from crewlytics.llm.text_arrays import bytes_of, cut_words, hash_ranges

KEEP_PIECES = 2_000_000  # pieces a worker remembers before it starts anew; no effect on results
KEEP_BYTES = 48  # longer pieces are encoded each time


@dataclass
class Ids:
    """Ids of a batch: text ``i`` has ``flat[bounds[i]:bounds[i + 1]]``."""

    flat: np.ndarray
    bounds: np.ndarray


class Encoder:
    """A tokenizer file and the ids of the pieces it has encoded so far.

    ``spaces`` tells how white space matters: "dropped" for tokenizers that leave it out, where
    pieces are words; "leading" for byte-level BPE, where a word takes one space before it along
    and all other white space is cut as that pattern does: the run but its last character, then
    the last character.
    """

    def __init__(self, path: str, spaces: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.marks = [token.content.encode().lower() for token in added]
        self.spaces = spaces
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of the pieces, sorted
        self.start = np.zeros(0, np.int64)  # where each one's ids are in flat
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Begins, ends and texts of the pieces, in order."""
        words = cut_words(data, offsets)
        if self.spaces == "dropped":
            return words.starts, words.ends, words.text
        text = words.text
        head = np.zeros(len(text), bool)
        head[words.first[:-1][words.counts > 0]] = True
        before = np.where(head, offsets[text], np.r_[0, words.ends[:-1]][: len(text)])
        gap = words.starts - before
        last = words.starts - 1
        space = (gap > 0) & (data[np.maximum(last, 0)] == 32)
        # for each word: the run before the last white space, that one, the word
        begins = np.stack([before, last, words.starts - space], 1)
        ends = np.stack([np.maximum(last, before), words.starts, words.ends], 1)
        exists = np.stack([gap > 1, (gap > 0) & ~space, np.ones(len(text), bool)], 1)
        of = np.repeat(text, 3).reshape(-1, 3)
        begins, ends, of = begins[exists], ends[exists], of[exists]
        tail = np.where(words.counts > 0, np.r_[0, words.ends][words.first[1:]], offsets[:-1])
        rest = np.flatnonzero(tail < offsets[1:])
        odd = self._odd_spaces(data, offsets)
        if len(rest) or odd.any():
            plain, odd_texts = ~odd[of], np.flatnonzero(odd)
            rest = rest[~odd[rest]]
            begins = np.r_[begins[plain], tail[rest], offsets[odd_texts]]
            ends = np.r_[ends[plain], offsets[1:][rest], offsets[1:][odd_texts]]
            of = np.r_[of[plain], rest, odd_texts]
            order = np.lexsort((begins, of))
            begins, ends, of = begins[order], ends[order], of[order]
        return begins, ends, of

    @staticmethod
    def _odd_spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with white space beyond ASCII; these are encoded whole."""
        odd = np.zeros(len(offsets) - 1, bool)
        at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
        at = at[at + 1 < len(data)]
        lead, second = data[at], data[at + 1]
        third = data[np.minimum(at + 2, len(data) - 1)]
        found = (lead == 0xC2) & ((second == 0x85) | (second == 0xA0))
        found |= (lead == 0xE1) & (second == 0x9A) & (third == 0x80)
        found |= (lead == 0xE2) & ((second == 0x80) | (second == 0x81))
        found |= (lead == 0xE3) & (second == 0x80) & (third == 0x80)
        controls = np.flatnonzero((data >= 0x1C) & (data <= 0x1F))
        odd[np.searchsorted(offsets, np.r_[at[found], controls], "right") - 1] = True
        return odd

    def _marked(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that may hold an added token, in either case of letters; these are encoded whole."""
        marked = np.zeros(len(offsets) - 1, bool)
        raw = data.tobytes().lower()
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                marked[text] = True
                at = raw.find(mark, max(at + 1, int(offsets[text + 1]) - len(mark) + 1))
        return marked

    @staticmethod
    def _cut_at_marks(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, of: np.ndarray):
        """Pieces cut where an ASCII letter meets an ASCII mark, as every pattern here cuts.

        Not behind an apostrophe, which may take the letters after it along.
        """
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        mark = (data > 32) & (data < 127) & ~letter & ~((data >= 48) & (data <= 57))
        cuts = np.flatnonzero(letter[:-1] & mark[1:] | mark[:-1] & (data[:-1] != 39) & letter[1:]) + 1
        piece = np.searchsorted(begins, cuts, "right") - 1
        inside = (piece >= 0) & (cuts > begins[piece]) & (cuts < ends[piece])
        cuts, piece = cuts[inside], piece[inside]
        return np.insert(begins, piece + 1, cuts), np.insert(ends, piece, cuts), np.insert(of, piece + 1, of[piece])

    def encode(self, texts: pa.Array) -> Ids:
        """The ids of each text; nulls and empty texts have none.

        Pieces are told apart by 64-bit hashes of their bytes.
        """
        data, offsets = bytes_of(texts)
        begins, ends, of = self._pieces(data, offsets)
        if not len(begins):
            return Ids(np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        begins, ends, of = self._cut_at_marks(data, begins, ends, of)
        marked = self._marked(data, offsets)
        if marked.any():
            plain, whole = ~marked[of], np.flatnonzero(marked)
            begins, of = np.r_[begins[plain], offsets[whole]], np.r_[of[plain], whole]
            ends = np.r_[ends[plain], offsets[whole + 1]]
            order = np.lexsort((begins, of))
            begins, ends, of = begins[order], ends[order], of[order]
        keys, sample, which = np.unique(
            hash_ranges(data, begins, ends), return_index=True, return_inverse=True
        )
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        start, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        start[known], size[known] = self.start[place[known]], self.size[place[known]]
        short = (ends - begins)[sample] <= KEEP_BYTES
        raw, pools, held = data.tobytes(), [self.flat], len(self.flat)
        for remembered in (True, False):
            new = np.flatnonzero(~known & (short == remembered))
            for at in range(0, len(new), 20_000):
                some = new[at : at + 20_000]
                bounds = zip(begins[sample[some]].tolist(), ends[sample[some]].tolist(), strict=True)
                pieces = [raw[b:e].decode("utf-8") for b, e in bounds]
                ids = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
                size[some] = np.fromiter(map(len, ids), np.int64, len(ids))
                start[some] = held + np.cumsum(size[some]) - size[some]
                held += int(size[some].sum())
                pools.append(np.fromiter(chain.from_iterable(ids), np.uint32))
            if remembered:
                flat = np.concatenate(pools)
                pools = [flat]
                fresh = new
        every = np.concatenate(pools)
        counts = size[which]
        stop = np.cumsum(counts)
        step = np.arange(stop[-1]) - np.repeat(stop - counts, counts)
        out = every[np.repeat(start[which], counts) + step]
        text_stop = np.r_[0, stop][np.searchsorted(of, np.arange(len(offsets)))]
        if len(self.keys) + len(fresh) > KEEP_PIECES:
            self.forget()
        else:
            self.flat = flat
            self.keys = np.insert(self.keys, place[fresh], keys[fresh])
            self.start = np.insert(self.start, place[fresh], start[fresh])
            self.size = np.insert(self.size, place[fresh], size[fresh])
        return Ids(out, text_stop)


def encoder(path: str, spaces: str) -> Encoder:
    """This worker's encoder for a file; kept between tasks that the worker runs."""
    kept = vars(sys).setdefault("_token_encoders", {})
    if (path, spaces) not in kept:
        kept[path, spaces] = Encoder(path, spaces)
    return kept[path, spaces]


def slices(batch: pa.RecordBatch, text: int, limit: int = 2 << 20):
    """The batch in row slices of about ``limit`` bytes of text; one row is never cut."""
    data, offsets = bytes_of(batch.column(text))
    del data
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
