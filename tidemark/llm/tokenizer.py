"""Exact, cached encoding with a public tokenizer file inside Spark tasks."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
from pyspark import TaskContext

#: Words of these letters alone are one pre-token in every vocabulary, and composed already: A-Z, a-z and the
#: precomposed Latin letters up to U+024F, without the one that has two code points in lower case.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+\\Z").match
_ID = attrgetter("id")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class CachedEncoder(dict):
    """Ids of whole texts, the same as the tokenizer's own, with a bounded cache of the chunks between white space.

    A single space, or a single line feed, between two other characters starts
    a new pre-token in these vocabularies, so a text can be cut there and the
    chunks encoded apart, the new ones of many texts at once.  Texts with other
    spacing go to the tokenizer whole.  A special token's string in a text is
    that token, as the tokenizer takes it: texts are cut there first.

    The cache has two generations of at most ``max_entries`` chunks; what is not
    used while one fills up is forgotten.  A key is a chunk that follows a
    space; where a space belongs to what follows it, a chunk that starts a line
    has a line feed before it, in its ids as well.

    With ``plain``, the strings of special tokens are ordinary text instead.
    """

    def __init__(self, path: str, max_entries: int = 200_000, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_entries = max_entries
        self.tokenizer.encode_special_tokens = plain
        self.special = {} if plain else {t.content: struct.pack("<I", i) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")" if self.special else r"(?!)").split
        self.model_tokens = self.tokenizer.model.tokenize
        self.normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else None
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # does a leading space become part of the following pre-token?
        self.lead = " " if len(self.split(" a")[0][0]) == 2 else ""
        self.space_sensitive = self.lead == " "
        self.lower = bool(self.normalize) and self.normalize("A") == "a"
        self.odd = re.compile(r"\s").search
        self.letters = str.maketrans(byte_letters())
        self.line_end = self._whole("a\n")[4:] if self.space_sensitive else b""
        self.marks = {c: self._pieces([c])[0] for c in ".,"}
        self.old: dict[str, bytes] = {}
        self.stage = None

    def clear(self) -> None:
        """Forget all chunks."""
        super().clear()
        self.old = {}

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, each by itself."""
        out = []
        for begin in range(0, len(pieces), 1000):  # few at once: the garbage collector need not look at their tokens
            tokens = list(map(self.model_tokens, pieces[begin : begin + 1000]))
            ids, at = np.fromiter(map(_ID, chain.from_iterable(tokens)), "<u4").tobytes(), 0
            out += [ids[at : (at := at + 4 * len(t))] for t in tokens]
        return out

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, lead: str, word: str) -> str:
        """The pre-token of a plain word after ``lead``."""
        if self.lower:
            word = word.lower()
        if word.isascii():
            return lead.translate(self.letters) + word
        return (lead + word).encode().decode("latin-1").translate(self.letters)

    def _learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Ids of chunks, which are cached from now on; those that only a whole text can tell are left out."""
        new, stems, pieces, whole, made = {}, {}, [], [], []
        lead, lower, marks, old, known, add = self.lead.translate(self.letters), self.lower, self.marks, self.old.get, self.get, pieces.append
        for chunk in sorted(chunks):  # like words together, as they need the same merges
            ids = old(chunk)
            if ids is not None:
                new[chunk] = ids
            elif chunk.isalpha() and chunk.isascii():
                add(lead + (chunk.lower() if lower else chunk))
                whole.append(chunk)
            else:
                before, space, body, after, first = b"", self.lead, chunk, b"", len(pieces)
                if self.space_sensitive and chunk[:1] == "\n":
                    before, space, body = self.line_end, "", chunk[1:]
                if _PLAIN(body):
                    add(self._word(space, body))
                elif body[-1:] in marks and _PLAIN(body[:-1]):
                    stem = chunk[:-1]
                    after, ids = marks[body[-1]], known(stem) or new.get(stem)
                    if ids is None:
                        stems[stem] = len(pieces), before
                        add(self._word(space, body[:-1]))
                    else:
                        before = ids
                elif self.space_sensitive and (not body or self.odd(body)):
                    continue
                else:
                    text = space + body
                    pieces += [p for p, _ in self.split(self.normalize(text) if self.normalize else text)]
                made.append((chunk, before, first, len(pieces), after))
                whole += [None] * (len(pieces) - first)
        ids = self._pieces(pieces)
        new.update(zip(whole, ids))
        new.pop(None, None)
        for stem, (at, before) in stems.items():  # a word is known from then on, whatever mark follows it
            new[stem] = before + ids[at]
        for chunk, before, first, end, after in made:
            new[chunk] = before + b"".join(ids[first:end]) + after
        if len(self) + len(new) <= self.max_entries:
            self.update(new)
            return new
        for chunk, ids in new.items():
            if len(self) >= self.max_entries:
                self.old = dict(self)
                super().clear()
            self[chunk] = ids
        return new

    def _cut(self, text: str, before: str = "") -> list[str]:
        """The chunks of a text that follows a space, or ``before``; none if spacing alone tells that they are not those of the text."""
        if not self.space_sensitive:
            return list(filter(None, text.replace("\n", " ").split(" ")))
        chunks = (before + text.replace("\n", " \n")).split(" ")
        return [] if "" in chunks or "\n" in chunks else chunks

    def _joined(self, cuts: list[list[str]]) -> list[bytes | None]:
        """The ids of the chunks of each text; None where a chunk does not tell its ids."""
        chunks = list(chain.from_iterable(cuts))
        found = list(map(self.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = self._learn({chunks[i] for i in missing})
            for i in missing:
                found[i] = new.get(chunks[i])
        out, at = [], 0
        for cut in cuts:
            ids = found[at : (at := at + len(cut))]
            out.append(None if missing and None in ids else b"".join(ids))
        return out

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens."""
        if not self.space_sensitive:
            return self._joined([self._cut(text) for text in texts])
        # a line feed before the text stands for its start, and is taken out again
        joined, skip = self._joined([self._cut(text, "\n") for text in texts]), len(self.line_end)
        return [ids[skip:] if ids else self._whole(text) for text, ids in zip(texts, joined)]

    def encode_after_space(self, text: str) -> bytes:
        """The ids of a space and ``text``, for vocabularies in which a space belongs to what follows it."""
        found = None if self.special or not self.space_sensitive else self._joined([self._cut(text)])[0]
        return found or self.encode(" " + text)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        parts = self.cut_special(text) if self.special else [text]
        if len(parts) == 1:
            return self._ordinary(parts)[0]
        return b"".join([self.special.get(p) or self._ordinary([p])[0] for p in parts if p])

    def encode_all(self, texts: Iterable[str], most: int = 1 << 18) -> Iterator[bytes]:
        """The ids of each text in order, about ``most`` characters at once."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= most:
                yield from self._encode_held(held)
                held, size = [], 0
        yield from self._encode_held(held)

    def _encode_held(self, texts: list[str]) -> list[bytes]:
        special = {i for i, text in enumerate(texts) if any(s in text for s in self.special)}
        ordinary = iter(self._ordinary([text for i, text in enumerate(texts) if i not in special]))
        return [self.encode(text) if i in special else next(ordinary) for i, text in enumerate(texts)]


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str, max_entries: int = 200_000) -> CachedEncoder:
    """One encoder per worker process and vocabulary, which keeps its chunks for the tasks of one stage."""
    found = _encoders.get(path)
    if found is None:
        found = _encoders[path] = CachedEncoder(path)
    found.max_entries = max_entries
    task = TaskContext.get()
    stage = task and task.stageId()
    if found.stage != stage:
        found.clear()
        found.stage = stage
    return found
