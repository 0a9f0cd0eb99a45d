"""Token ids of whole texts with a given tokenizer file.

A byte-level BPE splits a text into pieces before it merges, and some places
are always between two pieces: before white space that follows something else,
and between an ASCII letter and an ASCII character that is neither a letter
nor white space. A text may be cut there, and equal chunks have equal ids, so
they are encoded once and looked up afterwards, in all tasks of a Python worker. Where that rule isn't proven
(another kind of tokenizer, rarer white space, a special token's string in the
text) the whole text goes to the tokenizer at once.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import ChainMap
from itertools import chain

import numpy as np

#: Words, and chunks of words, kept in a worker. The first ones stay: frequent words come early.
KEPT = 400_000

_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_CHUNKS = re.compile("[ \n]*(?:[A-Za-z\x80-\U0010ffff]*[A-Za-z](?![A-Za-z\x80-\U0010ffff])|[^ \n]+)|[ \n]+")
#: One piece for certain: letters, with a space before them or none.
_LETTERS = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts as little-endian id arrays of ``dtype``, each with an end id."""

    def __init__(self, spec: str, end: int = 0) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.end = np.array([end], self.dtype).tobytes()
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        kind = json.loads(spec)
        before = kind.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in kind.get("added_tokens", [])]
        self.by_chunk = (
            kind.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
        )
        self.letters = _byte_letters()
        self.ends = dict(zip(".,;:!?", self._whole(list(".,;:!?")), strict=True))

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def _of(self, stretches: list[str]) -> list[bytes]:
        """The ids of stretches of text, each cut into chunks."""
        cut = [_CHUNKS.findall(s) for s in stretches]
        known = self.chunks
        fresh = set(chain.from_iterable(cut)).difference(known)
        if fresh:
            others = [c for c in fresh if not _LETTERS.fullmatch(c)]
            found = dict(zip(others, self._whole(others), strict=True))
            tokenize, letters, code = self.tokenizer.model.tokenize, self.letters, self.code
            for c in fresh.difference(found):
                piece = c.encode().decode("latin-1").translate(letters)
                found[c] = array(code, [t.id for t in tokenize(piece)]).tobytes()
            if len(known) + len(found) <= KEPT:
                known.update(found)
            else:
                known = ChainMap(found, known)
        return [known[c[0]] if len(c) == 1 else b"".join([known[x] for x in c]) for c in cut]

    def _words(self, fresh: set[str]) -> dict[str, bytes]:
        """The ids of words with a space before them. One of letters alone is
        one piece and goes to the model as it is; others are cut into chunks."""
        found, others = {}, []
        tokenize, letters, code, space = self.tokenizer.model.tokenize, self.letters, self.code, self.letters[0x20]
        ends = self.ends
        for w in fresh:
            if not self.by_chunk or not w:
                others.append(w)
                continue
            last = ends.get(w[-1]) if len(w) > 1 else None
            if last is not None and w.isascii() and w[:-1].isalpha():
                # the mark behind the letters is a piece of its own
                own = self.words.get(w[:-1]) or array(code, [t.id for t in tokenize(space + w[:-1])]).tobytes()
                found[w] = own + last
                continue
            if w.isascii() and w.isalpha():
                piece = space + w
            elif _LETTERS.fullmatch(w) and w[0] != " ":
                piece = space + w.encode().decode("latin-1").translate(letters)
            else:
                others.append(w)
                continue
            found[w] = array(code, [t.id for t in tokenize(piece)]).tobytes()
        found.update(zip(others, self._of([" " + w for w in others]), strict=True))
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text (None: empty), then the end id."""
        text = text or ""
        if not self.by_chunk or _RARE_SPACE.search(text) or any(s in text for s in self.special):
            ids = self._whole([text])[0]
        elif "  " in text or " \n" in text or "\n " in text or text[-1:] == " ":
            ids = self._of([text])[0]
        else:
            # each space stands alone before a word: look up whole words first
            rest = text.split(" ")
            first = rest.pop(0)
            words = self.words
            fresh = self._words(set(rest).difference(words))
            ids = self._of([first])[0]
            if len(words) + len(fresh) <= KEPT:
                words.update(fresh)
                ids += b"".join(map(words.__getitem__, rest))
            else:
                known = words.get
                ids += b"".join([known(w) or fresh[w] for w in rest])
        return np.frombuffer(ids + self.end, self.dtype)


def encoder(spec: str, end: int = 0) -> Encoder:
    """The worker's encoder for a tokenizer. It is kept on the library's module,
    which outlives a task: the code of this package travels with each task."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    key = (hash(spec), len(spec), end)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(spec, end)
    return kept[key]


def read_spec(path: str) -> str:
    """The tokenizer file, read on the driver and sent along with the tasks
    (a few MB, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
