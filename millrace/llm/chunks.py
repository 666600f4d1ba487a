"""Tokenisers applied once to each different piece of text between spaces, in Python workers."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

#: Pieces that a worker remembers, and the longest of them.
MOST_PIECES, LONGEST = 200_000, 40
#: A space that isn't followed by the first character of a word: text that has one is cut by the tokeniser's own rule.
LOOSE = re.compile("[ ](?:[\\s\x1c-\x1f\x85᠎​﻿]|$)")
#: Marks that end a piece and never join letters before them.
ENDINGS = ".,;:!?"
#: More of them for a tokeniser that keeps letters and other characters in runs of their own.
SYMBOLS = ENDINGS + "#$%&*"


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


def place(name: str) -> str:
    """Where a public tokeniser lies; a path is left as it is."""
    return name if "/" in name else public_tokenizers.path(name)


@lru_cache(maxsize=1)
def byte_marks() -> dict[int, str]:
    """Characters that stand for bytes in byte-level BPE: printable ones for themselves, then U+0100 and on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    marks = {b: chr(b) for b in shown}
    marks |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in marks)}
    return marks


def marked(text: str) -> str:
    if text.isascii() and text.isalpha():
        return text
    marks = byte_marks()
    return "".join([marks[b] for b in text.encode()])


def plain(text: str) -> bool:
    """Letters below U+0100 only: one run in every tokeniser here, with simple lower case and no composition."""
    return text.isalpha() and (text.isascii() or max(text) < "Ā")


def packed(ids: list[int]) -> bytes:
    """Little-endian 16-bit numbers; a larger id is an error."""
    return struct.pack(f"<{len(ids)}H", *ids)


class Memory:
    """What a worker has worked out about pieces, for its life; it fills up once and then stays as it is."""

    def __init__(self) -> None:
        self.known: dict = {}

    def full(self) -> bool:
        return len(self.known) >= MOST_PIECES

    def add(self, fresh: dict) -> None:
        if len(self.known) < MOST_PIECES:
            self.known.update((p, x) for p, x in fresh.items() if len(p) <= LONGEST)


@lru_cache(maxsize=8)
def memory(what: str) -> Memory:
    return Memory()


class WordIds:
    """Ids by a BPE tokeniser that lower-cases, drops white space and joins nothing across it.

    The ids of a text are those of its pieces between white space, one after the other. Specials inside a text are
    found as the tokeniser finds them by default.
    """

    def __init__(self, path: str) -> None:
        self.whole, self.memory, self.cores = tokenizer(path), memory(f"ids {path}"), memory(f"cores {path}")
        self.model = self.whole.model

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        known, fresh, out = self.memory.known, {}, []
        for t in texts:
            pieces = t.encode("utf-8", "surrogatepass").split()
            ids = list(map(known.get, pieces))
            for i in [i for i, x in enumerate(ids) if x is None]:
                p = pieces[i]
                found = fresh.get(p)
                if found is None:
                    found = fresh[p] = self.piece(p.decode("utf-8", "surrogatepass"))
                ids[i] = found
            out.append(b"".join(ids))
        self.memory.add(fresh)
        return out

    def piece(self, p: str) -> bytes:
        core = p.rstrip(SYMBOLS)
        if plain(core):
            core, tail = core.lower(), p[len(core) :]
            ids = self.cores.known.get(core)
            if ids is None:
                ids = packed([t.id for t in self.model.tokenize(marked(core))])
                if not self.cores.full():
                    self.cores.add({core: ids})
            return ids + (self.tail(tail) if tail else b"")
        return packed(self.whole.encode(p, add_special_tokens=False).ids)

    @lru_cache(maxsize=1000)  # noqa: B019
    def tail(self, tail: str) -> bytes:
        return packed(self.whole.encode(tail, add_special_tokens=False).ids)
