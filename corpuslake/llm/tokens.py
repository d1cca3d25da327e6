"""Token ids of whole texts by the tokenizers library, remembering the ids of pieces.

Text is cut only where the tokenizer's own splitting is certain to cut, so the ids
are those of the whole text; a text in which a special token or odd white space could stand is encoded as it is.
The pieces of many texts are cut and told apart as bytes by NumPy and Arrow, the different ones are looked up,
new ones are encoded together, and ids are gathered by NumPy.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import CHUNK_BYTES, text_chunks

#: Pieces remembered by a worker; beyond that it starts anew.
REMEMBERED = 700_000
#: White space besides blank and line end, and NUL, which marks the piece that begins a text.
_ODD = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\x00"
#: Python takes these for white space, the tokenizers don't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: White space beyond ASCII.
_WIDE = tuple(c for c in _ODD if c > "\x7f")
_FIRST = "\x00"
#: Byte classes of the cutting: marks (no apostrophe, which contractions begin with) and letters.
_MARK, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'")]] = True
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
#: Two-byte characters from U+00C0 to U+017F; these aren't letters, or not one letter in lower case.
_NO_LETTER = tuple(int.from_bytes(c.encode()) for c in "\xd7\xf7\u0130")
#: White space as a blank, and A-Z as a-z besides.
_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[0, *range(9, 14)]] = 32
_FOLDED = _BLANKS.copy()
_FOLDED[65:91] += 32
_open: dict[str, "PieceEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Numbers of pieces in order of their first look-up; `new` are those without ids so far."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


def _byte_letters() -> np.ndarray:
    """The character of each byte in byte-level vocabularies; the blank stays, as it parts words."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, dtype="<u4")
    out[shown] = shown
    hidden = [b for b in range(256) if b not in set(shown)]
    out[hidden] = 256 + np.arange(len(hidden))
    out[32] = 32
    return out


_BYTE_LETTERS = _byte_letters()
#: Splitting and normal forms under which a word of letters up to U+017F is one word for the model, in lower case
#: where white space doesn't count; with others, words are encoded by the whole tokenizer.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_KNOWN = {
    True: (None, _BYTE_LEVEL | {"use_regex": True}),
    False: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
    ),
}


def _settings(part) -> dict | None:
    return None if part is None else json.loads(part.__getstate__())


class PieceEncoder:
    """`spaces_count`: a single blank before a word belongs to the word's piece (byte-level BPE);
    otherwise white space is dropped and every word is a piece.
    `keeps`: when too many pieces are remembered, those met again stay.

    A piece is named by its bytes: one for what is before it (NUL: the text begins, blank or line end), then a word; or
    the marks that follow a letter, with what is joined to them."""

    def __init__(self, path: str, spaces_count: bool, keeps: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces_count, self.keeps = spaces_count, keeps
        #: The same model, for words of known letters that are parted by blanks and written as its vocabulary writes bytes.
        self.plain = None
        if (_settings(self.tokenizer.normalizer), _settings(self.tokenizer.pre_tokenizer)) == _KNOWN[spaces_count]:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        #: Tokens that begin a word with its blank, or end a word.
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("\u0120") if spaces_count else token.endswith("</w>")
        self.id_type = "<u2" if len(self.edge) <= 1 << 16 else "<u4"
        self.begins = _MARK.copy()
        self.begins[[0, 10, 32] if spaces_count else [32]] = True
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.start, self.size, self.uses = (np.zeros(1 << 14, dtype=np.int64) for _ in range(3))

    def _thin(self) -> None:
        """Forget the pieces met but once since the last time; all, if that leaves too many."""
        n = len(self.numbers)
        often = self.uses[:n] > 1
        stay = np.flatnonzero(often)
        if not self.keeps or len(stay) > REMEMBERED // 2:
            return self._forget()
        pieces = list(itertools.compress(self.numbers, often.tolist()))
        start, size, flat = self.start[stay], self.size[stay], self.flat
        self._forget()
        self.numbers.update(zip(pieces, range(len(pieces)), strict=True))
        ends = np.cumsum(size)
        self.used = int(ends[-1]) if len(ends) else 0
        self.flat = self._room(self.flat, self.used)
        self.flat[: self.used] = flat[np.repeat(start - ends + size, size) + np.arange(self.used)]
        self.start, self.size, self.uses = (self._room(a, len(pieces)) for a in (self.start, self.size, self.uses))
        self.start[: len(pieces)], self.size[: len(pieces)] = ends - size, size

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only and how many each has, 250 encoded as one text; each has one token with an edge."""
        if self.plain is not None:
            known = [w.isascii() or (max(w) < "\u0180" and "\u0130" not in w) for w in words]
            ids = self._run(list(itertools.compress(words, known)), self._plainly)
            if all(known):
                return ids
            return self._merged(np.array(known), ids, self._run([w for w, k in zip(words, known, strict=True) if not k], self._wholly))
        return self._run(words, self._wholly)

    def _wholly(self, runs: list[list[str]]) -> list[list[int]]:
        return self._each([(" " if self.spaces_count else "") + " ".join(r) for r in runs])

    def _plainly(self, runs: list[list[str]]) -> list[list[int]]:
        texts = [" ".join(r) if self.spaces_count else " ".join(r).lower() for r in runs]
        texts = [t if t.isascii() else _BYTE_LETTERS[np.frombuffer(t.encode(), np.uint8)].tobytes().decode("utf-32-le") for t in texts]
        if self.spaces_count:
            texts = ["\u0120" + t.replace(" ", " \u0120") for t in texts]
        return [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, words: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        lists = encode([words[i : i + 250] for i in range(0, len(words), 250)])
        ids, _ = self._flat(lists)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return self._flat(self._each([(" " if self.spaces_count else "") + w for w in words]))
        return ids, np.diff(at, append=len(ids)) if self.spaces_count else np.diff(at, prepend=-1)

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), dtype=np.uint32, count=int(size.sum())), size

    @staticmethod
    def _merged(left: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of items of which `left` says whether the next of a or of b stands there."""
        size = np.empty(len(left), dtype=np.int64)
        size[left], size[~left] = a[1], b[1]
        mine = np.repeat(left, size)
        ids = np.empty(len(mine), dtype=np.uint32)
        ids[mine], ids[~mine] = a[0], b[0]
        return ids, size

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        first = len(self.numbers) - len(new)
        #: A word after a blank; neither a first piece nor one after a line end.
        pieces = [p.decode() for p in new]
        words = [p[0] == " " and p[1:].isalpha() for p in pieces]
        odd = [p for p, w in zip(pieces, words, strict=True) if not w]
        found = self._flat(self._each([p[1:] if p[0] == _FIRST or not self.spaces_count and p[0] == " " else p for p in odd]))
        ids, many = self._merged(np.array(words), self._words([p[1:] for p in itertools.compress(pieces, words)]), found)
        total = len(ids)
        self.flat = self._room(self.flat, self.used + total)
        self.start, self.size, self.uses = (self._room(a, len(self.numbers)) for a in (self.start, self.size, self.uses))
        self.flat[self.used : self.used + total] = ids
        self.size[first : first + len(new)] = many
        self.start[first : first + len(new)] = self.used + np.cumsum(many) - many
        self.used += total

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)))

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.numbers) > REMEMBERED:
            self._thin()
        cut = [self._cut(text or "") for text in texts]
        simple = [i for i, c in enumerate(cut) if isinstance(c, str)]
        listed = [i for i, c in enumerate(cut) if isinstance(c, list)]
        number = self.numbers.__getitem__
        at, counts = self._numbered([cut[i] for i in simple])
        parts = [at] + [np.fromiter(map(number, cut[i]), dtype=np.int64, count=len(cut[i])) for i in listed]
        at = np.concatenate(parts)
        self._learn()
        if self.keeps:
            self.uses[: len(self.numbers)] += np.bincount(at, minlength=len(self.numbers))
        size = self.size[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[np.cumsum([0, *counts, *map(len, parts[1:])])].tolist()
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, a, b in zip([*simple, *listed], bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[a:b]
        return [np.asarray(self._whole(t), dtype=np.uint32) if x is None else x for t, x in zip(texts, out, strict=True)]

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Numbers of the pieces of simple texts, and how many each text has."""
        if not texts:
            return np.zeros(0, dtype=np.int64), []
        data = np.frombuffer((_FIRST + _FIRST.join(texts)).encode(), dtype=np.uint8)
        first = np.flatnonzero(data == 0)
        if not self.spaces_count:
            #: From U+0300 on characters may join with the letter before them, and not with the same in lower case.
            joins = np.flatnonzero(np.maximum.reduceat(data, first) >= 0xCC).tolist()
            raw, data, ends = data, _FOLDED[data], [*first[1:].tolist(), len(data)]
            for i in joins:
                data[first[i] : ends[i]] = _BLANKS[raw[first[i] : ends[i]]]
        begins = self.begins[data]
        mark = np.flatnonzero(_MARK[data])
        before = data[mark - 1]
        pair = data[mark - 2].astype(np.int64) << 8 | before
        wide = (pair >= 0xC380) & (pair <= 0xC5BF) & (before >= 0x80) & (before < 0xC0) & ~np.isin(pair, _NO_LETTER)
        begins[mark[~(_LETTER[before] | wide)]] = False
        starts = np.flatnonzero(begins)
        ends = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        numbers = self._looked_up(pieces.dictionary)
        counts = np.diff(np.searchsorted(starts, first), append=len(starts)).tolist()
        return numbers[pieces.indices.to_numpy()], counts

    def _looked_up(self, pieces: pa.BinaryArray) -> np.ndarray:
        """Numbers of different pieces."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1).tolist()
        data = pieces.buffers()[2].to_pybytes()
        different = [data[a:b] for a, b in itertools.pairwise(bounds)]
        numbers = np.fromiter(map(self.numbers.get, different, itertools.repeat(-1)), dtype=np.int64, count=len(different))
        missing = np.flatnonzero(numbers < 0)
        new, known = [different[i] for i in missing.tolist()], len(self.numbers)
        numbers[missing] = np.arange(known, known + len(new))
        self.numbers.update(zip(new, range(known, known + len(new)), strict=True))
        self.numbers.new += new
        return numbers

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def _cut(self, text: str) -> str | list[bytes] | None:
        """A text whose pieces can be found in its bytes; the pieces of others; None where the text has to be encoded whole."""
        if "<|" in text or not self.spaces_count and (_FIRST in text or any(c in text for c in _SEPARATORS)):
            return None
        if not self.spaces_count:
            return text if text.isascii() or not any(c in text for c in _WIDE) else " ".join(text.split())
        if text and (any(c in text for c in _ODD) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"):
            pieces = self._cut_slowly(text)
            return None if pieces is None else [p.encode() if k == 0 else b" " + p.encode() for k, p in enumerate(pieces)]
        return text

    @staticmethod
    def _cut_slowly(text: str) -> list[str] | None:
        """Pieces that begin at a single blank between two characters that aren't white space."""
        if _FIRST in text or "\n" == text[:1]:
            return None
        out, start = [], 0
        at = text.find(" ")
        while at != -1:
            if at > start and at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
                out.append(text[start:at])
                start = at + 1
            at = text.find(" ", at + 1)
        out.append(text[start:])
        out[0] = _FIRST + out[0]
        return out


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches of about `limit` bytes of column text, with the texts."""
    for chunk, texts in text_chunks(batches, limit):
        yield chunk, [t.decode() for t in texts]


def encoder(path: str, spaces_count: bool, keeps: bool = False) -> PieceEncoder:
    if path not in _open:
        _open[path] = PieceEncoder(path, spaces_count, keeps)
    return _open[path]
