"""Token ids of whole texts by a public tokenizer, each distinct word encoded once in a while.

Both tokenizers used here cut a text at white space and where letters end before anything else, so
that a word's ids don't depend on its neighbours. A task cuts texts into such units in numpy, finds
the distinct ones in Arrow, encodes those that it has not met (a word of Latin letters, which stays
in one piece, by the tokenizer's model, others many in one call), and puts the ids of a text
together from the units'. A text with white space beyond ASCII is encoded whole. The ids equal those
of encoding each text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_SPACE, _MAYBE_ODD = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The bytes that a character of _ODD can begin with.
_MAYBE_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_LETTER, _OTHER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_OTHER[0x21:0x7F] = ~_LETTER[0x21:0x7F]
#: What a tokenizer of bytes neither cuts nor normalises, but for white space around it and case.
_WORD = re.compile("[ \t-\r]*[A-Za-zÀ-ÖØ-öø-ÿ]+[ \t-\r]*")
_SPACED_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Units that a task remembers; it forgets all when they are more.
MOST_UNITS = 800_000
#: New units that are encoded in one call.
CHUNK = 2000


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Units(dict):
    """Numbers units as they are first asked for; new holds those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class Encoder:
    """Ids by the tokenizers library. spaced: white space is part of the ids (byte-level); else words alone count."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        #: Put between units it is one id of its own.
        self.between = "\n" if spaced else " ~ "
        self.apart = self._plain([self.between])[0]
        self.letters = byte_letters()
        self.model = self.tokenizer.model if self._of_bytes() else None
        self._forget()

    def _of_bytes(self) -> bool:
        """Is a word of letters one piece of bytes for the model, in lower case if white space does not count?"""
        told = json.loads(self.tokenizer.to_str())
        if any(not t["special"] for t in told["added_tokens"]):
            return False
        cuts, normal = told["pre_tokenizer"] or {}, told["normalizer"]
        if self.spaced:
            return normal is None and cuts.get("type") == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"]
        steps = cuts.get("pretokenizers", [])
        kinds = [n["type"] for n in (normal or {}).get("normalizers", [])]
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and r"|[\p{L}]+|" in steps[0]["pattern"].get("Regex", "")
            and steps[0]["invert"]
            and not steps[1]["add_prefix_space"]
        )

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.units = _Units()
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids of some units and how many each has, from one call; None where they can't be told apart."""
        ids = np.array(self.tokenizer.encode(self.between.join(texts), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(ids == self.apart[0]) if len(self.apart) == 1 else []
        if len(cuts) != len(texts) - 1:
            return None
        return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1

    def _word(self, text: str) -> list[int] | None:
        """The ids of a word of Latin letters; None if the unit is anything else."""
        if self.spaced:
            if not _SPACED_WORD.fullmatch(text):
                return None
        else:
            if not _WORD.fullmatch(text):
                return None
            text = text.strip(" \t\n\v\f\r").lower()
        if text.isascii():
            piece = text.replace(" ", self.letters[0x20])
        else:
            piece = text.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(piece)]

    def _learn(self) -> None:
        texts, self.units.new = self.units.new, []
        got: list[list[int] | None] = [None] * len(texts)
        if self.model is not None:
            got = list(map(self._word, texts))
        mark = self.between.strip(" ")
        others = [i for i, x in enumerate(got) if x is None]
        joined = [i for i in others if mark not in texts[i] and not texts[i].isspace()]
        alone = sorted(set(others) - set(joined))
        for at in range(0, len(joined), CHUNK):
            some = joined[at : at + CHUNK]
            together = self._together([texts[i] for i in some])
            if together is None:
                alone += some
            else:
                ids, lengths = together
                for i, ids_of in zip(some, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                    got[i] = ids_of.tolist()
        for i, ids_of in zip(alone, self._plain([texts[i] for i in alone]), strict=True):
            got[i] = ids_of
        counts = np.fromiter(map(len, got), np.int64, len(got))
        more = np.fromiter(chain.from_iterable(got), np.uint32, int(counts.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, more])

    def _cut(self, body: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where units begin in the bytes of texts that begin at `begins` (none of them empty).

        A unit is a word with the space before it; all but the last of a run of white space; or its
        last, if it is no space. Where white space does not count, a unit is a word and what follows it.
        What is no letter after an ASCII letter begins another unit.
        """
        space = _SPACE[body]
        before = np.empty_like(space)
        before[1:] = space[:-1]
        before[begins] = True
        if not self.spaced:
            unit = before & ~space
        else:
            ends = np.zeros(len(body), bool)  # white space before a word
            ends[:-1] = space[:-1] & ~space[1:]
            ends[begins[1:] - 1] = False
            unit = space & (~before | ends)
            unit[1:] |= ~space[1:] & space[:-1] & (body[:-1] != 0x20)
        unit[1:] |= _OTHER[body[1:]] & _LETTER[body[:-1]]
        unit[begins] = True
        return np.flatnonzero(unit)

    def __call__(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each begins (one more at the end); end: put after each."""
        if len(self.units) > MOST_UNITS:
            self._forget()
        bodies = [t.encode() if t else b"" for t in texts]
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        data = b"".join(bodies)
        body, begins = np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes
        counts = np.zeros(len(texts), np.int64)
        index = np.zeros(0, np.int64)
        if len(body):
            some = np.flatnonzero(sizes)
            at = self._cut(body, begins[some])
            maybe = np.unique(np.searchsorted(begins[some], np.flatnonzero(_MAYBE_ODD[body]), side="right") - 1)
            whole = [i for i in some[maybe].tolist() if _ODD.search(texts[i])]
            if whole:  # such a text is one unit
                odd = np.zeros(len(texts), bool)
                odd[whole] = True
                owner = some[np.searchsorted(begins[some], at, side="right") - 1]
                at = at[~odd[owner] | (at == begins[owner])]
            counts[some] = np.diff(np.append(np.searchsorted(at, begins[some]), len(at)))
            offsets = np.append(at, len(body)).astype(np.int32)
            coded = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            index = np.fromiter(map(self.units.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        if self.units.new:
            self._learn()
        starts, ids = self.starts, self.ids
        if end is not None:  # the end id as one more unit after each text
            index, counts = np.insert(index, np.cumsum(counts), len(starts) - 1), counts + 1
            starts, ids = np.append(starts, len(ids) + 1), np.append(ids, np.uint32(end))
        taken = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)).take(pa.array(index))
        upto = taken.offsets.to_numpy()
        return taken.flatten().to_numpy(), upto[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One for each worker process."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def vocabulary(name: str) -> str:
    """Where the file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices_of(texts: list[str | None], size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most `size` characters in all, or one text."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and held + n > size:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)
