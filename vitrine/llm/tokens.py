"""Token ids of whole texts by the tokenizers library, one call per new word.

A word's ids don't depend on its surroundings once the text is cut where the
tokenizer itself always cuts.  Arrow cuts some texts at once and numbers their
distinct pieces; each of these is looked up once for all of the texts, and
encoded if the worker's cache, a bounded number of pieces in two generations,
doesn't hold it; numpy puts the ids in the texts' order.  A text that holds the
string of one of the tokenizer's added tokens is encoded whole.  The result equals the library's plain call for
the whole text, ``encode(text, add_special_tokens=False)`` (tested).
"""

from __future__ import annotations

import os
import string
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

BIG_ENDIAN = sys.byteorder == "big"
SIGNS = string.punctuation  # a run of them after a word is one pre-token, looked up for itself
CACHE = 300_000  # pieces of a generation
ROWS = 500  # documents whose texts and ids a task holds at once
GROUP_CHARS = 1 << 21  # texts cut together; a longer text is a group of its own
FIRST = "\x00"   # before the first piece of a line, which has no space before it
# Fixed value: the words of the lower-case tokenizer, as its file states them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Pieces(dict):
    """piece -> ids as little-endian bytes, or None; fills itself, forgets the generation before the last."""

    def __init__(self, encode, room: int = CACHE):
        super().__init__()
        self.encode, self.room, self.old = encode, room, {}

    def __missing__(self, piece):
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids



class Letters(dict):
    """Code point -> its UTF-8 bytes in the byte alphabet, for ``str.translate``."""

    def __init__(self):
        super().__init__()
        self.alphabet = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, point):
        self[point] = letters = self.alphabet.pre_tokenize_str(chr(point))[0][0]
        return letters


class Encoder:
    """Ids of a text as little-endian unsigned numbers of ``width`` bytes; no special tokens are added."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in tokens]
        if any(t.normalized for t in tokens):
            raise ValueError(f"{path}: an added token is looked for in normalised text")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.code = next(c for c in "HIL" if array(c).itemsize == self.width)
        self.model, self.letters = self.tokenizer.model, Letters()
        self.model._resize_cache(0)  # new pieces only come here: a second cache would never be hit
        self.tokenize = self.model.tokenize
        self.pieces = Pieces(self._piece)

    def word(self, word: str) -> bytes:
        """One normalised pre-token, by the tokenizer's model alone (a fifth of the cost of a call for a text)."""
        if word.isascii() and word.isprintable():
            letters = word.replace(" ", "Ġ")  # of the byte alphabet, only the space differs
        else:
            letters = word.translate(self.letters)
        return self.packed([t.id for t in self.tokenize(letters)])

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if BIG_ENDIAN:
            out.byteswap()
        return out.tobytes()

    def direct(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text])).tobytes()

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null is empty."""
        group, size = [], 0
        for t in texts:
            if group and size + len(t or "") > GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
            group.append(t or "")
            size += len(t or "")
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        whole = {i for i, t in enumerate(texts) if not self.in_pieces(t)}
        marked = ["" if i in whole else self.marked(t) for i, t in enumerate(texts)]
        last = np.cumsum([t.count(" ") + 1 for t in marked])
        numbered = pc.split_pattern(pa.array([" ".join(marked)], pa.large_string()), " ").flatten().dictionary_encode()
        number = numbered.indices.to_numpy()
        found = list(map(self.pieces.__getitem__, numbered.dictionary.to_numpy(zero_copy_only=False)))
        if None in found:  # texts with a piece that can't be encoded by itself
            bad = np.array([x is None for x in found])
            whole.update(np.searchsorted(last, np.flatnonzero(bad[number]), "right").tolist())
            found = [x or b"" for x in found]
        held = np.frombuffer(b"".join(found), self.dtype)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        n = lens[number]
        end = np.cumsum(n)
        place = np.repeat((np.cumsum(lens) - lens)[number] - (end - n), n)
        place += np.arange(len(place))
        out = np.split(held[place], end[last[:-1] - 1])
        for i in whole:
            out[i] = np.frombuffer(self.whole(texts[i]), self.dtype)
        return out

    def in_pieces(self, text: str) -> bool:
        """Whether a text may be cut: it holds no added token's string."""
        return not any(t in text for t in self.added)

    def marked(self, text: str) -> str:
        """``text`` with a space wherever it is cut."""
        raise NotImplementedError

    def _piece(self, piece: str) -> bytes | None:
        """The ids of a piece of a marked text; None if its text must be encoded whole."""
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        """The ids of a text that is not cut at spaces."""
        return self.direct(text)


def plain(text: str) -> bool:
    """Latin, Greek or Cyrillic letters and printable signs: every library classes them alike."""
    return text.isprintable() and (text.isascii() or max(text) < "\u0590")


class WordEncoder(Encoder):
    """For tokenizers that drop white space: texts are cut at spaces and line ends.

    A plain piece is normalised and cut into the tokenizer's words (``pattern``
    finds them); any other is encoded as it is.
    """

    def __init__(self, path: str, pattern: str = WORD_PATTERN):
        super().__init__(path)
        self.pattern = regex.compile(pattern)
        self.words = Pieces(self.word)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() or max(piece) < "\u0100":  # normalised but for its case
            if piece.isalpha():
                return self.word(piece.lower())
            word = piece.rstrip(SIGNS)
            if word.isalpha():
                return self.pieces[word] + self.words[piece[len(word):]]
        if not piece:
            return b""
        if not plain(piece):
            return self.direct(piece)
        words = self.words
        piece = piece.lower() if piece.isascii() else self.tokenizer.normalizer.normalize_str(piece)
        return b"".join([words[w] for w in self.pattern.findall(piece)])

    def marked(self, text: str) -> str:
        return text.replace("\n", " ")


class ByteEncoder(Encoder):
    """For byte-level BPE whose pre-tokens are ``pattern``.

    A single space between other characters begins a pre-token and a single
    line end is one, so lines are cut at spaces; a text with other white space
    (runs, at the ends of lines, other characters) is cut by the pattern.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__(path)
        self.pattern = regex.compile(pattern)
        self.words = Pieces(self.word)

    def _piece(self, piece: str) -> bytes | None:
        if not piece:
            return None
        if piece[0] == FIRST:
            return self._cut(piece[1:])
        if plain(piece):
            if piece.isalpha():  # letters after a space are one pre-token
                return self.word(" " + piece)
            word = piece.rstrip(SIGNS)
            if word.isalpha():
                return self.pieces[word] + self.words[piece[len(word):]]
        elif piece == "\n":
            return self.word(piece)
        return self._cut(" " + piece)

    def _cut(self, piece: str) -> bytes | None:
        if not piece or piece[-1].isspace() or piece[0] != " " and piece[0].isspace() or piece[1:2].isspace():
            return None
        if not plain(piece):
            return self.direct(piece)
        if piece.isalpha():
            return self.word(piece)
        words = self.words
        return b"".join([words[w] for w in self.pattern.findall(piece)])

    def in_pieces(self, text: str) -> bool:
        return bool(text) and FIRST not in text and super().in_pieces(text)

    def marked(self, text: str) -> str:
        return FIRST + text.replace("\n", " \n " + FIRST)

    def whole(self, text: str) -> bytes:
        if FIRST in text or max(text, default="") >= "\u0590" or not super().in_pieces(text):
            return self.direct(text)
        words = self.words
        return b"".join([words[w] for w in self.pattern.findall(text)])


def slices(batch: pa.RecordBatch, rows: int):
    """A batch in parts of at most ``rows`` rows, without copying it."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def worker_encoder(kind: type, path: str, *args) -> Encoder:
    """The worker process's encoder, kept from task to task with its cache."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    store = sys.modules.setdefault("_vitrine_encoders", types.ModuleType("_vitrine_encoders"))
    held = store.__dict__.setdefault("held", {})
    key = (kind.__name__, path, *args)
    if key not in held:
        held[key] = kind(path, *args)
    return held[key]
