"""Tokenizer access with a cache of chunks.

The tokenizers split texts before they merge, and never across the start of a space or newline that follows other than
white space.  A text is cut there, each distinct chunk is encoded once by the tokenizers library and its ids are kept in
a bounded cache, so the ids are those of the whole text.  A text that holds the name of a special token, in any case, is
encoded whole by the library, which gives such names their own ids.  The vocabulary files are named by a parameter.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array

from tokenizers import Tokenizer

from .. import runtime

CACHE = 700_000
_EDGE = re.compile(r"(?<=\S)(?=[ \n])")
_MARKS = "".join(m for m in string.punctuation if m != "'")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next free code point."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """ids of texts as packed unsigned 32-bit little-endian integers."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normal = self.tokenizer.model, self.tokenizer.normalizer
        self.letters = byte_letters()
        with open(path, encoding="utf-8") as f:  # only a space before a word can be part of its first token
            spec = json.load(f)
        self.space = "" if any(p.get("type") == "Split" for p in spec["pre_tokenizer"].get("pretokenizers", [])) else self.letters[32]
        self.special = [t["content"].lower() for t in spec.get("added_tokens", [])]
        self.opening = re.match(r"[^\w\s]*", os.path.commonprefix(self.special))[0]  # marks that all of them begin with
        self.limit = cache
        self.chunks: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}
        self.ends: dict[str, bool] = {}

    def _ends_word(self, letter: str) -> bool:
        """Whether marks after a letter or digit are cut off for certain: its normal form has to end in a letter or digit
        too, as one that ends in a combining mark is joined with what follows."""
        if letter not in self.ends:
            normal = letter if self.normal is None else self.normal.normalize_str(letter)
            self.ends[letter] = letter.isalnum() and normal[-1:].isalnum()
        return self.ends[letter]

    def _whole(self, text: str) -> bool:
        if self.opening not in text:
            return False
        low = text.lower()
        return any(name in low for name in self.special)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _normals(self, words: list[str]) -> list[str]:
        """Normal forms of words of letters alone; those that aren't ASCII by the library, many at a time with spaces between."""
        if self.normal is None:
            return words
        out = [w.lower() for w in words]
        at = [i for i, w in enumerate(words) if not w.isascii()]
        for lo in range(0, len(at), 1000):
            some = at[lo : lo + 1000]
            normal = self.normal.normalize_str(" ".join([words[i] for i in some])).split(" ")
            if len(normal) != len(some):
                normal = [self.normal.normalize_str(words[i]) for i in some]
            for i, w in zip(some, normal):
                out[i] = w
        return out

    def _words(self, words: list[str]) -> list[str]:
        """Learn words of letters alone after a space, which pre-tokenizers leave whole: straight from the model.  Returns
        those whose normal forms aren't such."""
        space, letters, tokenize, rest = self.space, self.letters, self.model.tokenize, []
        for w, word in zip(words, self._normals(words)):
            if not word.isalpha():
                rest.append(w)
                continue
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(letters)
            self.chunks[w] = array("I", [t.id for t in tokenize(space + word)]).tobytes()
        return rest

    def _learn(self, wanted: set[str]) -> None:
        """Encode the chunks that the cache lacks.  A chunk after a space is kept without it; ``None`` marks one that
        isn't cut off for certain, as white space runs on."""
        missing = wanted.difference(self.chunks)
        if not missing:
            return
        if len(self.chunks) + len(missing) > self.limit:
            self.chunks = {w: self.chunks[w] for w in wanted if w in self.chunks}
        chunks, words, rest = self.chunks, set(), set()
        split, bases, tails = [], [], []  # no tuple a chunk, which the garbage collector would walk
        for w in missing:
            if w.isalpha():
                words.add(w)
            elif not w or w[-1].isspace():
                chunks[w] = None
            else:
                base = w.rstrip(_MARKS)
                if base and len(base) < len(w) and self._ends_word(base[-1]):
                    split.append(w)
                    bases.append(base)
                    tails.append(w[len(base) :])
                    if base not in chunks:
                        (words if base.isalpha() else rest).add(base)
                else:
                    rest.add(w)
        rest = [*rest, *self._words(list(words))]
        for w, ids in zip(rest, self._ids([w if w[0] == "\n" else " " + w for w in rest])):
            chunks[w] = ids
        new = sorted(set(tails).difference(self.tails))
        if len(self.tails) + len(new) > self.limit:
            self.tails.clear()
            new = sorted(set(tails))
        self.tails.update(zip(new, self._ids(new)))
        for w, base, tail in zip(split, bases, tails):
            chunks[w] = chunks[base] + self.tails[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, wanted, heads = [], set(), []
        whole = [self._whole(t) for t in texts]
        for t, alone in zip(texts, whole):
            parts = [""] if alone else t.replace("\n", " \n").split(" ")
            heads.append(parts[0])
            del parts[0]
            wanted.update(parts)
            cut.append(parts)
        self._learn(wanted)
        known = self.chunks.__getitem__
        first = self._ids(heads)
        out = []
        for t, alone, h, head, parts in zip(texts, whole, heads, first, cut):
            if alone:
                out += self._ids([t])
                continue
            if h and parts and h[-1].isspace():
                out.append(self._slow(t))
                continue
            try:
                out.append(head + b"".join(map(known, parts)))
            except TypeError:
                out.append(self._slow(t))
        return out

    def _slow(self, text: str) -> bytes:
        """Runs of white space: cut only where a space or newline follows something else."""
        parts = _EDGE.split(text)
        out = []
        for at in range(0, len(parts), 10_000):
            out += self._ids(parts[at : at + 10_000])
        return b"".join(out)


_encoders: dict[str, Encoder] = runtime.cache({})


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
