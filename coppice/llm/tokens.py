"""Whole texts to token ids by a public tokenizer file, with the ids of repeated pieces kept in memory.

Both tokenizer kinds treat pieces between ASCII blanks independently, so the ids of a text are the
ids of its pieces one after the other. Pieces for which that might not hold (a piece that ends in
white space, an empty piece between two blanks) send the whole text through the tokenizer, and so does
a text that holds the string of an added token, which gets that token's id as the library gives it.
"""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode
from collections.abc import Iterable
from struct import pack

import numpy as np

#: Bytes, about, that each generation of a worker's memory may take; when the young one is full it
#: becomes the old one, and what is used again moves back.
REMEMBER = 80 << 20
#: About what a remembered piece costs besides its characters and ids.
ENTRY = 170
#: In UTF-8, letters of smaller lead bytes than this (below U+0240) are one code point in composed and lower case form alike.
LEAD = 0xC9
#: A word with marks after it and perhaps the first word of the next line, each of which the byte-level rule takes by itself;
#: apostrophes are left out, since it joins some of them to the letters that follow.
CLAUSE = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]{0,4})(?:\n([^\W\d_]+)([!-&(-/:-@\[-`{-~]{0,4}))?")
#: Runs of marks that are remembered.
RUNS = 10_000


def byte_letters() -> str:
    """The printable stand-ins of byte-level tokenizers, by byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return "".join(letter[b] for b in range(256))


class Memory:
    """Ids by piece, in two generations."""

    def __init__(self, most: int = REMEMBER) -> None:
        self.most = most
        self.young: dict[str | bytes, bytes | None] = {}
        self.old: dict[str | bytes, bytes | None] = {}
        self.size = 0

    def put(self, piece: str | bytes, ids: bytes | None) -> None:
        self.young[piece] = ids
        self.size += ENTRY + len(piece) + len(ids or b"")

    def missing(self, pieces: set) -> list:
        """Pieces to learn; known ones are in the young generation afterwards."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        out = []
        for p in pieces.difference(self.young):
            if p in self.old:
                self.put(p, self.old[p])
            else:
                out.append(p)
        return out


class Encoder:
    """``kind`` is "word" (white space is dropped) or "byte" (a blank belongs to the next word)."""

    def __init__(self, json_text: str, kind: str, remember: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(json_text)
        self.kind = kind
        self.markers = [t["content"] for t in json.loads(json_text)["added_tokens"]]
        self.letters = byte_letters()
        self.ends = dict(zip((",", "."), self._raw([",", "."])))
        self.runs: dict[str, bytes] = {}
        remember = REMEMBER if remember is None else remember
        self.first, self.next = Memory(remember), Memory(remember)

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, memory: Memory, core: str, mark: str) -> bytes | None:
        """The ids of letters, remembered; None where the whole tokenizer is needed."""
        if not core.isalpha() or max(raw := core.encode()) >= LEAD:
            return None
        ids = memory.young.get(core)
        if ids is None:
            found = [t.id for t in self.tok.model.tokenize(mark + charmap_decode(raw, "strict", self.letters)[0])]
            ids = pack(f"<{len(found)}I", *found)
            memory.put(core, ids)
        return ids

    def _run(self, marks: str) -> bytes:
        if marks not in self.runs:
            if len(self.runs) >= RUNS:
                self.runs.clear()
            self.runs[marks] = self._raw([marks])[0]
        return self.runs[marks]

    def _clause(self, memory: Memory, piece: str, mark: str) -> bytes | None:
        """The ids of a ``CLAUSE``, None for any other piece: words, marks and the line's end are tokenised apart."""
        found = CLAUSE.fullmatch(piece)
        if not found:
            return None
        head, marks, other, more = found.groups()
        ids = self._letters(memory, head, mark)
        if ids is None:
            return None
        ids += self._run(marks) if marks else b""
        if other is None:
            return ids
        rest = self._letters(self.first, other, "")
        return None if rest is None else ids + self._run("\n") + rest + (self._run(more) if more else b"")

    def _learn(self, memory: Memory, pieces: set, lead: str) -> None:
        """Remember the ids of ``pieces``.

        Plain letters, with a comma or full stop after them or not, are one or two of the
        tokenizer's own words, which its model takes directly, and so are the parts of a byte-level
        ``CLAUSE``; any other piece goes through the whole tokenizer.
        """
        mark, rest, tokenize, letters, ends = "\u0120" if lead else "", [], self.tok.model.tokenize, self.letters, self.ends
        missing = memory.missing(pieces)
        young, size, word = memory.young, 0, self.kind == "word"
        for p in missing:
            if p in young:  # learned with a clause that holds it
                continue
            s = p.decode("utf-8", "surrogatepass") if word else p
            core, tail = (s, b"") if s.isalpha() else (s[:-1], ends.get(s[-1:]))
            if tail is not None and core.isalpha():
                raw = core.encode()
                if word and max(raw) < LEAD:
                    raw = core.lower().encode()
                if max(raw) < LEAD:
                    ids = young.get(p[:-1]) if tail else None  # the word without its mark may be known
                    if ids is None:
                        found = [t.id for t in tokenize(mark + charmap_decode(raw, "strict", letters)[0])]
                        ids = pack(f"<{len(found)}I", *found)
                    young[p] = ids + tail
                    size += ENTRY + len(p) + len(ids) + len(tail)
                    continue
            if word:
                rest.append((p, s))
            elif not s or s[-1].isspace():
                memory.put(p, None)
            elif (ids := self._clause(memory, s, mark)) is not None:
                memory.put(p, ids)
            else:
                rest.append((p, lead + s))
        memory.size += size
        for (p, _), ids in zip(rest, self._raw([s for _, s in rest]) if rest else ()):
            memory.put(p, ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        marked = {i: self._raw([t])[0] for i, t in enumerate(texts) if any(m in t for m in self.markers)}
        if marked:
            plain = iter(self.encode([t for i, t in enumerate(texts) if i not in marked]))
            return [marked[i] if i in marked else next(plain) for i in range(len(texts))]
        if self.kind == "word":  # bytes.split() cuts at ASCII white space only; other spaces are the tokenizer's to judge
            parts = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            self._learn(self.first, set().union(*parts), "")
            get = self.first.young.__getitem__
            return [b"".join(map(get, p)) for p in parts]
        parts = [t.split(" ") for t in texts]
        self._learn(self.first, {p[0] for p in parts}, "")
        self._learn(self.next, set().union(*(p[1:] for p in parts)), " ")
        out = []
        for t, p in zip(texts, parts):
            try:
                out.append(self.first.young[p[0]] + b"".join(map(self.next.young.__getitem__, p[1:])))
            except TypeError:
                out.append(self._raw([t])[0])
        return out


_ENCODERS: dict[tuple[str, int, int], Encoder] = {}


def encoder(json_text: str, kind: str, remember: int = REMEMBER) -> Encoder:
    """One encoder for each worker process and tokenizer; what it remembers serves later tasks."""
    key = (kind, hash(json_text), remember)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(json_text, kind, remember)
    return _ENCODERS[key]
