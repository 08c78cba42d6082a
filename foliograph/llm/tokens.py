"""Whole-text encoding with a byte-level BPE of the tokenizers library.

A byte-level BPE with the usual splitting pattern always begins a new piece at a space that a character other
than white space follows, so the text before such a space and the text from it on are encoded independently of
each other. Natural text repeats these stretches, and each worker therefore keeps the ids of those it has seen
and sends only new ones to the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np

#: White space for Python's re is a superset of the tokenizer's, so no cut is made that the tokenizer wouldn't make.
_cut = re.compile(r" (?=\S)").split

#: Stretches that a worker keeps, and the longest kept, in characters. Only memory depends on them.
KEPT, LONGEST = 900_000, 40

#: Stretches that go to the library as one text.
JOINED = 1024

#: Letters below this code point are letters for Python and for the tokenizer alike, whatever Unicode version they follow.
OTHER = 0x250


#: What a tokenizer file must say for cuts before spaces to change nothing; what it does not say is as here.
LAYOUT = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False},
}


def check_layout(path: str) -> None:
    """An error for a file that is no byte-level BPE with the usual pattern and without a normaliser."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    for part, want in LAYOUT.items():
        have = found.get(part)
        same = have is None if want is None else isinstance(have, dict) and all((have.get(k, v) or None) == (v or None) for k, v in want.items())
        if not same:
            raise ValueError(f"{path} is no plain byte-level BPE: its {part} is another")
    if found["model"].get("type", "") != "BPE" or found["pre_tokenizer"].get("type", "") != "ByteLevel":
        raise ValueError(f"{path} is no byte-level BPE")


class Encoder:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers."""

    kept = KEPT

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        check_layout(path)
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._known: dict[str, bytes] = {}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: How the library's model spells the bytes of the letters below OTHER.
        self._spelled = {b: x for c in range(OTHER) for b, x in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0])}
        self._space = self._spelled[32]
        self._model = self._tokenizer.model
        if hasattr(self._model, "_resize_cache"):  # what it would keep is kept here
            self._model._resize_cache(0)
        self._marks = {x: self._raw([x])[0] for x in ".,"}
        tokens = self._tokenizer.get_vocab(with_added_tokens=True)
        self._begins = np.zeros(max(tokens.values()) + 1, bool)  # by id: whether the token begins with a space
        self._begins[[i for t, i in tokens.items() if t.startswith(self._space)]] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, letters: str) -> bytes:
        """Ids of a space and letters: one piece, which goes straight to the library's model."""
        spelled = self._space + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(self._spelled))
        return array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()

    def _new(self, found: set[str]) -> dict[str, bytes]:
        """Ids of stretches, each after a space."""
        out, rest, known, marks = {}, [], self._known, self._marks
        for x in found:
            if x.isalpha() and (x.isascii() or ord(max(x)) < OTHER):
                out[x] = self._word(x)
            elif x[-1] in marks and (y := x[:-1]).isalpha() and (y.isascii() or ord(max(y)) < OTHER):
                out[x] = (known.get(y) or self._word(y)) + marks[x[-1]]
            else:
                rest.append(x)
        if rest:
            out |= zip(rest, self._together(rest))
        return out

    def _together(self, found: list[str]) -> list[bytes]:
        """Ids of stretches, each after a space: many in one text, cut where a token begins with a space."""
        single, out = [x for x in found if " " not in x], {}
        for i in range(0, len(single), JOINED):
            part = single[i : i + JOINED]
            ids = np.frombuffer(self._raw([" " + " ".join(part)])[0], np.uint32)
            starts = np.flatnonzero(self._begins[ids])
            if len(starts) == len(part) and starts[0] == 0:
                data, at = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
                out.update(zip(part, (data[a:b] for a, b in zip(at, at[1:]))))
        other = [x for x in found if x not in out]
        out |= zip(other, self._raw([" " + x for x in other]))
        return [out[x] for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self._known
        if len(known) > self.kept:
            for x in list(islice(known, self.kept // 4, None)):  # what is frequent was seen first
                del known[x]
        parts = [_cut(t) for t in texts]
        found = [list(map(known.get, p)) for p in parts]
        gaps, new = [], set()
        for p, f in zip(parts, found):
            f[0] = b""
            gap = [k for k, i in enumerate(f) if i is None]
            new.update([p[k] for k in gap])
            gaps.append(gap)
        ids = self._new(new)
        for p, f, gap, head in zip(parts, found, gaps, self._raw([p[0] for p in parts])):
            f[0] = head
            for k in gap:
                f[k] = ids[p[k]]
        known.update(ids if max(map(len, ids), default=0) <= LONGEST else {x: i for x, i in ids.items() if len(x) <= LONGEST})
        return [b"".join(f) for f in found]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
