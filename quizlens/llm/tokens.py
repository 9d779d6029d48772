"""Encoding whole texts with a tokenizers file, remembering pieces that no token can cross.

``byte_bpe_50k.json`` splits texts before each space that follows a non-space and precedes a non-space, and around
line feeds; ``word_bpe_49k.json`` drops white space. Both split runs of letters from
marks. Such pieces have ids of their own, whatever stands beside them, so a worker encodes each distinct piece once
and gathers the rest from a table. Where pieces keep their spaces they tile the texts, so they are cut over the bytes of
many texts at once and told apart by Arrow; new runs of letters go to the library many at a time. Texts with other white space or with control characters that libraries class
differently are encoded whole, and so are texts that hold a special token's string, which the library turns into that
token; both ways give the library's ids.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import workspace

#: Pieces remembered by a worker before it forgets those that it met only once; bounds its memory, not the texts.
REMEMBERED = 600_000

_ODD = re.compile(r"[^\S \n]")  # white space other than space and line feed; Python's set includes \x1c-\x1f and \x85
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = r"[.,!?%&$#*|]+"
#: Letters before a space, mark or end; marks before a space or end; else all up to white space.
_WORDS = re.compile(rf"{_LETTERS}(?=[ \n.,!?%&$#*|]|\Z)|{_MARKS}(?=[ \n]|\Z)|[^ \n]+")
_SIMPLE = re.compile(rf" ?{_LETTERS}").fullmatch
_SPACED = re.compile(rf" {_LETTERS}").fullmatch

#: Kinds of bytes: letters of ASCII, marks, space, line feed; all else is 0.
_LETTER, _MARK, _SPACE, _FEED = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(b".,!?%&$#*|")] = _MARK
_KIND[32], _KIND[10] = _SPACE, _FEED

#: Byte-level vocabularies write each byte as a printable character: itself where it is one in Latin-1, else one from U+0100 on.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHAR = {b: b if b in _printable else 256 + b - sum(p < b for p in _printable) for b in range(256)}
_SPACE_CHAR = chr(_BYTE_CHAR[32])
#: What the bytes of a run of letters (ASCII's, and those of Latin-1 in UTF-8) are written as.
_LETTER_CHARS = {chr(_BYTE_CHAR[b]) for b in [*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]}
#: New runs of letters handed to the library as one.
JOINED = 64


def tiles(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of texts one after another, and how many each text has.

    A piece is a run of letters with a space before it, up to white space or a mark; else all up to white space, with a
    space before it; white space before that; a line feed alone where such a piece follows at once.
    """
    raw = [t.encode() for t in texts]
    data = b"".join(raw)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
    b = np.frombuffer(data, np.uint8)
    kind = _KIND[b]
    lead = np.flatnonzero(b == 0xC3)
    lead = lead[(b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]  # not the signs of multiplication and division
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.zeros(len(b) + 1, bool)
    cut[starts] = True
    white = kind >= _SPACE
    opens = white[:-1] & ~white[1:]  # the last of a run of white space, before something else
    last = opens & ~cut[1:-1]  # in the same text
    cut[1:-1] |= (white[1:] & ~white[:-1]) | (opens & (kind[:-1] == _FEED))
    cut[: len(last)] |= last
    at = np.flatnonzero(kind != _LETTER)
    before = np.concatenate(([-1], at[:-1]))
    marked = (kind[at] == _MARK) & (at - before > 1)  # marks behind letters
    at, before = at[marked], before[marked]
    whole = np.searchsorted(starts, at, side="right") != np.searchsorted(starts, before, side="right")
    whole |= white[before]  # the letters begin behind white space, or their text
    cut[at[whole]] = True
    edges = np.flatnonzero(cut)
    pieces = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data))
    return pieces, np.diff(np.searchsorted(edges, starts))


class _Slots(dict):
    """Numbers keys in the order in which they are first asked for, and lists the new ones."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Encoder:
    """``path``: a tokenizers file; ``pieces``: "spaces" where tokens keep their leading space, "words" where white space is dropped."""

    def __init__(self, path: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.lower = pieces == "words"
        self.bare = Tokenizer(self.model)  # takes a text as one unit
        vocab = {} if self.lower else self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith(_SPACE_CHAR)]] = True
        # runs of letters may stand together if no token reaches from one over the space of the next
        self.joins = not self.lower and not any(_SPACE_CHAR in t[1:] and t.strip(_SPACE_CHAR) and set(t) - {_SPACE_CHAR} <= _LETTER_CHARS for t in vocab)
        self._forget()

    def _forget(self) -> None:
        self.slot = _Slots()
        self.used = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int64)

    def _thin(self) -> None:
        """Keep the pieces that were met more than once since the last time, if they are not the most."""
        again = self.uses[: len(self.slot)] > 1
        if 2 * again.sum() > REMEMBERED:
            return self._forget()
        keys = [k for k, more in zip(self.slot, again.tolist(), strict=True) if more]
        start, length = self.start[: len(again)][again], self.length[: len(again)][again]
        where = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        ids = self.flat[where]
        self._forget()
        self._room(len(keys), len(ids))
        self.slot.update(zip(keys, range(len(keys)), strict=True))
        self.flat[: len(ids)], self.used = ids, len(ids)
        self.length[: len(keys)], self.start[: len(keys)] = length, np.cumsum(length) - length

    def _room(self, pieces: int, ids: int) -> None:
        while ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while pieces > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.uses))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit(self, piece: str) -> str:
        """A run of letters, or several with their spaces, as the model's pre-tokenizer hands them over."""
        if self.lower:
            piece = piece.lower()
        elif piece.isascii():
            return piece.replace(" ", _SPACE_CHAR)
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHAR)

    def _joined(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of letters, each with a space before it, one after another, and how many each has."""
        units = [self._unit("".join(runs[k : k + JOINED])) for k in range(0, len(runs), JOINED)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(units, add_special_tokens=False)), np.int32)
        sizes = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
        if len(sizes) != len(runs):
            raise ValueError("tokens reach over spaces")
        return ids, sizes

    def _learn(self, fresh: list[str]) -> None:
        """Ids of the pieces numbered last."""
        n = len(self.slot) - len(fresh)
        where = np.array([self.joins and _SPACED(p) is not None for p in fresh], bool)
        for part, at in ((self._joined, where), (self._apart, ~where)):
            if not at.any():
                continue
            ids, sizes = part([p for p, take in zip(fresh, at.tolist(), strict=True) if take])
            self._room(n + len(fresh), self.used + len(ids))
            self.flat[self.used : self.used + len(ids)] = ids
            slots = n + np.flatnonzero(at)
            self.length[slots], self.start[slots] = sizes, self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)

    def _apart(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has."""
        tokenize, unit = self.model.tokenize, self._unit
        # a run of letters is one unit of the pre-tokenizer, so the model can have it at once
        found = [[t.id for t in tokenize(unit(p))] if (p.isascii() and p[1:].isalpha() and (p[0] == " " or p[0].isalpha())) or _SIMPLE(p) else None for p in fresh]
        rest = [i for i, f in enumerate(found) if f is None]
        for i, ids in zip(rest, self._ids([fresh[i] for i in rest]), strict=True):
            found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece of the texts, one after another, and how many pieces each text has."""
        if self.lower:
            pieces = [_WORDS.findall(t) for t in texts]
            flat = list(chain.from_iterable(pieces))
            return np.fromiter(map(self.slot.__getitem__, flat), np.int64, len(flat)), np.array([len(p) for p in pieces], np.int64)
        pieces, many = tiles(texts)
        told = pieces.dictionary_encode()
        distinct = told.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist
        return np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))[told.indices.to_numpy()], many

    def encode_flat(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with ``end_id`` behind it, and how many each text has."""
        if len(self.slot) > REMEMBERED:
            self._thin()
        is_whole = [_ODD.search(t) is not None or any(s in t for s in self.special) for t in texts]
        plain = [t for t, w in zip(texts, is_whole, strict=True) if not w]
        slots, pieces = self._slots(plain)
        if self.slot.fresh:
            fresh, self.slot.fresh = self.slot.fresh, []
            self._learn(fresh)
        self.uses[: len(self.slot)] += np.bincount(slots, minlength=len(self.slot))
        sizes = self.length[slots]
        ends = np.cumsum(sizes)
        many = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(pieces)))])
        others = [np.array(ids, np.int32) for ids in self._ids([t for t, w in zip(texts, is_whole, strict=True) if w])]
        w = np.array(is_whole, bool)
        counts = np.empty(len(texts), np.int64)
        counts[~w], counts[w] = many, [len(x) for x in others]
        stops = np.cumsum(counts + 1)
        out = np.full(int(stops[-1]) if len(stops) else 0, end_id, np.int32)
        begins = stops - counts - 1
        out[np.repeat(begins[~w] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))] = self.flat[np.repeat(self.start[slots] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        for at, ids in zip(begins[w].tolist(), others, strict=True):
            out[at : at + len(ids)] = ids
        return out, counts + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without an end."""
        ids, counts = self.encode_flat(texts, 0)
        return [x[:-1] for x in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []


def encoder(path: str, pieces: str) -> Encoder:
    return workspace(("encoder", path, pieces), lambda: Encoder(path, pieces))
