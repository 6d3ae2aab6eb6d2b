"""Token ids of whole texts, through a bounded cache of the ids of their words.

The public tokenizers cut a text into pieces before any merge, and no piece runs
from a character that isn't white space into a following space. So a text may be
cut there, the distinct cuts of a block are given to the library once, and the
ids are put together again. The result is that of the library on the whole text.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from contextlib import contextmanager
from functools import lru_cache
from itertools import repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Cached units at most; when passed, only those that were met again stay.
CACHED_UNITS = 500_000
# Bytes of text that are cut into units at once.
BLOCK_BYTES = 4_000_000
# Code points the libraries may take for white space, and then a space: no cut there.
_SPACES = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_IRREGULAR = f"(?:^|[{_SPACES}]) "
_CUT = re.compile(r"(?<=\S)(?= )")
# Before merges, a lower-casing word tokenizer cuts a word into these.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
# Units that one call of the library takes.
_JOINED = 100
# A word of Latin letters and the punctuation behind it are one piece each, in any case.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letters beyond ASCII in ``_PLAIN`` as a byte-level model spells them: a letter for each byte."""
    shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    hidden = (b for b in range(256) if b not in shown)
    shown |= {b: chr(256 + i) for i, b in enumerate(list(hidden))}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist


@contextmanager
def _no_collector():
    """Makes many small lists and no cycles: the collector would walk over them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Encoder:
    """Ids by a tokenizer file. ``spaced``: a space belongs to the word after it, else it is dropped."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.line_feed = [t.id for t in self.model.tokenize("Ċ")]
        self.pieces = regex.compile(_PIECES)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = (self.tokenizer.id_to_token(i) or "" for i in range(size))
        self.marks = np.array([t.startswith("Ġ") if spaced else t.endswith("</w>") for t in tokens])
        self._reset()

    def _reset(self) -> None:
        # units that follow a space (or, without spaces, all) are kept without it
        self.index: dict[bool, dict[str, int]] = {True: {}, False: {}}
        self.flat, self.offsets, self.met = array("I"), array("q", [0]), bytearray()

    def _evict(self) -> None:
        """Drops what was met in one block only, and all if that leaves too much."""
        index, flat = self.index, np.frombuffer(self.flat, np.uint32)
        bounds, met = np.frombuffer(self.offsets, np.int64), np.frombuffer(self.met, np.uint8)
        often = met > 1
        fits = often.sum() <= CACHED_UNITS // 2
        self._reset()
        if not fits:
            return
        size = np.where(often, np.diff(bounds), 0)
        place = (np.cumsum(often) - 1).tolist()
        self.flat.frombytes(flat[np.repeat(often, np.diff(bounds))].tobytes())
        self.offsets.frombytes(np.cumsum(size[often]).astype(np.int64).tobytes())
        self.met = bytearray(int(often.sum()))
        for led, units in index.items():
            self.index[led] = {u: place[i] for u, i in units.items() if often[i]}

    def _add(self, led: bool, units: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """``ids`` of all ``units``, which end at ``ends``."""
        first, base = len(self.offsets) - 1, len(self.flat)
        self.index[led].update(zip(units, range(first, first + len(units))))
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.offsets.frombytes((ends + base).astype(np.int64).tobytes())
        self.met.extend(bytes(len(units)))

    def _add_joined(self, units: list[str], n_pieces: np.ndarray) -> bool:
        """Ids of all units from one call; False if they can't be told apart."""
        text = (" " if self.spaced else "") + " ".join(units)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        marked = np.flatnonzero(self.marks[ids])
        last = np.cumsum(n_pieces)
        if len(marked) != last[-1]:
            return False
        # a mark begins a unit that has its space, or ends a piece of a word
        ends = np.r_[marked[1:], len(ids)] if self.spaced else marked[last - 1] + 1
        if ends[-1] != len(ids) or (self.spaced and marked[0] != 0):
            return False
        self._add(True, units, ids, ends)
        return True

    def _learn_plain(self, led: bool, units: list[str]) -> list[str]:
        """Ids of the units that are plain words, or lines of one each; returns the others.

        A plain word, its mark and a line feed before a word are a piece each, so the
        model gets them as they are.
        """
        rest, done, flat, ends = [], [], [], []
        known: dict[str, list[int]] = {}  # of these units; words come with several marks
        tokenize, lead = self.model.tokenize, "Ġ" if self.spaced and led else ""
        for unit in units:
            if unit.isalpha() and unit.isascii():  # most of them
                flat += [t.id for t in tokenize(lead + (unit if self.spaced else unit.lower()))]
                done.append(unit)
                ends.append(len(flat))
                continue
            cut = _PLAIN(unit)
            if cut is not None:
                cuts = [(lead, *cut.groups())]
            elif self.spaced and "\n" in unit:
                lines = [_PLAIN(line) for line in unit.split("\n")]
                if None in lines:
                    rest.append(unit)
                    continue
                cuts = [("" if i else lead, *line.groups()) for i, line in enumerate(lines)]
            else:
                rest.append(unit)
                continue
            for i, (before, word, mark) in enumerate(cuts):
                if i:
                    flat += self.line_feed
                piece = before + word
                ids = known.get(piece)
                if ids is None:
                    at = None if word is unit else self.index[i == 0 and led].get(word)
                    if at is not None:  # met without its mark before
                        ids = self.flat[self.offsets[at] : self.offsets[at + 1]].tolist()
                    else:
                        spelt = word if self.spaced else word.lower()
                        if not spelt.isascii():
                            spelt = spelt.translate(self.letters)
                        ids = [t.id for t in tokenize(before + spelt)]
                    known[piece] = ids
                flat += ids
                if mark:
                    if mark not in known:
                        known[mark] = [t.id for t in tokenize(mark)]
                    flat += known[mark]
            done.append(unit)
            ends.append(len(flat))
        if done:
            self._add(led, done, np.array(flat, np.uint32), np.array(ends, np.int64))
        return rest

    def _learn(self, led: bool, units: list[str]) -> None:
        simple, pieces, single = [], [], []
        for unit in self._learn_plain(led, units):
            if not led or len(unit) > 64:
                single.append(unit)
            elif unit.isascii() and unit.isalpha():
                simple.append(unit)
                pieces.append(1)
            elif unit.split() == [unit] and "<|" not in unit:
                simple.append(unit)
                pieces.append(1 if self.spaced else len(self.pieces.findall(normalize("NFC", unit).lower())))
            else:
                single.append(unit)
        for i in range(0, len(simple), _JOINED):
            part = simple[i : i + _JOINED]
            if not self._add_joined(part, np.array(pieces[i : i + _JOINED])):
                single += part
        space = " " if led and self.spaced else ""
        for i in range(0, len(single), 64):
            part = single[i : i + 64]
            got = [g.ids for g in self.tokenizer.encode_batch_fast([space + u for u in part], add_special_tokens=False)]
            flat = np.array([x for ids in got for x in ids], np.uint32)
            self._add(led, part, flat, np.cumsum([len(ids) for ids in got]))

    def _places(self, units: list[str], led: bool) -> np.ndarray:
        index = self.index[led]
        found = np.fromiter(map(index.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            missing = [units[i] for i in new]
            with _no_collector():
                self._learn(led, list(dict.fromkeys(missing)))
            found[new] = list(map(index.__getitem__, missing))
        return found

    def _units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the units of all texts in the cache, and where each text's begin."""
        split = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        offsets = np.asarray(split.offsets).astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        code = np.asarray(coded.indices)
        if not self.spaced:
            return self._places(_strings(coded.dictionary), True)[code], offsets
        odd = np.asarray(pc.match_substring_regex(texts, _IRREGULAR).cast(pa.uint8())) > 0
        first = np.zeros(len(code), bool)
        first[offsets[:-1]] = True
        usual = ~first & ~np.repeat(odd, np.diff(offsets))
        used = np.flatnonzero(np.bincount(code[usual], minlength=len(coded.dictionary)))
        place = np.zeros(len(coded.dictionary), np.int64)
        words = _strings(coded.dictionary.take(pa.array(used)))
        place[used] = self._places(words, True)
        units = place[code]
        heads = _strings(coded.dictionary.take(pa.array(code[offsets[:-1]])))
        units[offsets[:-1]] = self._places(heads, False)
        if not odd.any():
            return units, offsets
        # texts with a space after other white space are cut one by one
        parts = [units[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        for i in np.flatnonzero(odd):
            parts[i] = self._places(_CUT.split(texts[int(i)].as_py()), False)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, and where each text's begin. Null is empty."""
        if len(self.met) > CACHED_UNITS:
            self._evict()
        units, offsets = self._units(pc.fill_null(texts, ""))
        met = np.frombuffer(self.met, np.uint8)
        seen = np.flatnonzero(np.bincount(units, minlength=1))
        met[seen] = np.minimum(met[seen], 9) + 1
        bounds, flat = np.frombuffer(self.offsets, np.int64), np.frombuffer(self.flat, np.uint32)
        start, size = bounds[units], bounds[units + 1] - bounds[units]
        done = np.r_[0, np.cumsum(size)]
        ids = flat[np.repeat(start - done[:-1], size) + np.arange(done[-1])]
        begins = done[offsets]
        out = np.empty(len(ids) + len(texts), np.uint32)
        ends = begins[1:] + np.arange(len(texts))
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner], out[ends] = ids, end_id
        return out, np.r_[0, ends + 1]


@lru_cache(maxsize=1)  # a task keeps one cache
def encoder(path: str, spaced: bool) -> Encoder:
    return Encoder(path, spaced)
