"""Token ids of whole texts by the tokenizers library, with a per-worker table of pieces already encoded.

Both vocabularies in use split a text at white space before any merge, so a text's ids are those of
its white-space-delimited pieces in turn. Each worker process keeps the ids of pieces it has met and
asks the library only for new ones. Texts for which that split is not certain to be the library's own
(runs and rare kinds of white space, special strings, text that normalisation would change) go to the
library whole.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# control characters and white space on whose class engines could disagree, letters whose lower case
# depends on more than the letter, the opening of a special string
_UNCERTAIN = r"[\x00\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{130}\x{3a3}]|<\|"
_RUN = r"[ \t\r\n]{2}|[\t\r]"
_MARKS = frozenset(",.!?;:")
_TABLES: dict[str, "PieceTable"] = {}


def _latin(text: str) -> bool:
    """Whether all characters are Latin letters (up to U+024F)."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250")


def _spaced(piece: str) -> str:
    """A split piece with the white space that stood before it (see ``PieceTable._split``)."""
    return piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece


class PieceTable:
    """Encodes columns of texts. ``limit`` bounds the pieces kept; a full table starts afresh."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(path)
        self.limit = limit
        normaliser = json.loads(self.library.to_str())["normalizer"] or {}
        # lower-casing vocabularies drop white space; the others keep it in front of the word
        self.by_word = "Lowercase" in {n["type"] for n in normaliser.get("normalizers", [normaliser]) if n}
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._clear()

    def _clear(self) -> None:
        self.ids, self.begins, self.places = array("I", [0]), array("i", [1]), {}

    def _keep(self, ids: Iterable[int]) -> int:
        """Store ids in a new place. (The array begins with a stray id, so that it is never empty.)"""
        self.ids.extend(ids)
        self.begins.append(len(self.ids))
        return len(self.begins) - 2

    def _library_ids(self, piece: str) -> list[int]:
        return self.library.encode(piece, add_special_tokens=False).ids

    def _place(self, piece: str) -> int:
        """The place of a piece: at most one white-space character, in front, then a word."""
        place = self.places.get(piece)
        if place is None:
            word = piece[1:] if piece[:1] == " " else piece
            if _latin(word):                                  # one run of letters is one unit for the merges
                unit = word if word is piece and word.isascii() else self.to_bytes.pre_tokenize_str(piece)[0][0]
                ids = [t.id for t in self.library.model.tokenize(unit)]
            elif word[-1:] in _MARKS and _latin(word[:-1]):   # a mark after a letter is always split off
                ids = self._of(self._place(piece[:-1])) + self._of(self._place(word[-1]))
            else:
                ids = self._library_ids(piece)
            place = self.places[piece] = self._keep(ids)
        return place

    def _of(self, place: int) -> array:
        return self.ids[self.begins[place]:self.begins[place + 1]]

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """Pieces of each text. With white space kept, a piece begins with NUL (start of the text), with
        a line feed, or else had one blank before it."""
        if self.by_word:
            return pc.ascii_split_whitespace(pc.utf8_lower(texts))
        marked = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), "")
        return pc.split_pattern(marked, " ")

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pieces one after the other, and where each text's pieces end."""
        if len(self.begins) > self.limit or len(self.ids) > 16 * self.limit:
            self._clear()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        unsafe = pc.match_substring_regex(texts, _UNCERTAIN if self.by_word else f"{_UNCERTAIN}|{_RUN}")
        unsafe = unsafe.to_numpy(zero_copy_only=False)
        if self.by_word:
            unsafe = unsafe | np.array([not unicodedata.is_normalized("NFC", t)
                                        for t in texts.to_numpy(zero_copy_only=False)], bool)
        pieces = self._split(pc.if_else(pa.array(unsafe), "", texts) if unsafe.any() else texts)
        coded = pieces.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        known = np.fromiter(map(self._place, words if self.by_word else map(_spaced, words)), np.int32, len(words))
        places = known[coded.indices.to_numpy()] if len(known) else np.empty(0, np.int32)
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
        if unsafe.any():
            rows = np.flatnonzero(unsafe)
            whole = [self._keep(self._library_ids(texts[int(r)].as_py())) for r in rows]
            places = np.insert(places, ends[rows], np.array(whole, np.int32))
            ends = ends + np.cumsum(unsafe)
        return places, ends

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids end. A null text is empty.

        ``end`` is appended to every text's ids.
        """
        places, ends = self._places(texts)
        if end is not None:
            places = np.insert(places, ends, self._keep([end]))
            ends = ends + np.arange(1, len(ends) + 1)
        if not len(places):
            return np.empty(0, np.uint32), ends
        begins, ids = np.frombuffer(self.begins, np.int32), np.frombuffer(self.ids, np.uint32)
        first = begins[places]
        n = begins[places + 1] - first
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        flat = ids[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])]
        return flat, upto[ends]

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        places, ends = self._places(texts)
        begins = np.frombuffer(self.begins, np.int32)
        upto = np.concatenate([[0], np.cumsum(begins[places + 1] - begins[places], dtype=np.int64)])
        return np.diff(upto[ends], prepend=0)


def piece_table(path: str) -> PieceTable:
    """The worker's table for this tokenizer file; it lives as long as the worker process."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def portions(batch: pa.RecordBatch, text: str = "text", most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text (a longer text is a slice of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)
