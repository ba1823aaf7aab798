"""Exact encoding with a public tokenizer file, remembered per unit.

Neither vocabulary's pre-tokens cross a single space between two other characters: the word-level one drops white space, the
byte-level one gives the space to what follows it. So a text whose only white space is single spaces and line feeds inside it
is cut before each space, round each line feed and behind the letters that a word begins with. The cuts are found with numpy in a
whole chunk, Arrow tells its distinct units, each of these is encoded by the tokenizers library once and remembered while it is
used often, and the ids are gathered with numpy. Any other text is encoded whole by the library.
"""

from __future__ import annotations

import gc
import os
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from ._base import content


def _appended(store: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """The store with `new` after its first `used` numbers; its room doubles."""
    if used + len(new) > len(store):
        store = np.concatenate((store[:used], np.empty(used + 2 * len(new), store.dtype)))
    store[used : used + len(new)] = new
    return store


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in byte-level vocabularies: itself where it prints, else the next one from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printing else next(others)) for b in range(256)}


_LETTERS = {b: x for b, x in _byte_letters().items() if b != 10}
_PROBES = ["a", "word", "Étude", "größe", "Zzyzx", "peña", "thisrehawhing"]
_ALPHA, _AFTER_C3, _BREAK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), 0xC3]] = True
_AFTER_C3[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True  # all letters but the signs of multiplication and division
_BREAK[[10, 32]] = True


def _cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where units begin, and the last end; and which texts have white space at an end or beside other.

    A unit is a line feed, or the letters a word begins with, or what is behind them up to the next white space; a space before
    it is part of it. A word with characters beyond Latin-1's letters and ASCII is one unit.
    """
    letter, gap, start = _ALPHA[data], _BREAK[data], np.zeros(len(data) + 1, bool)
    lead = np.flatnonzero(data == 0xC3)
    good = _AFTER_C3[data[lead + 1]]
    letter[lead[good] + 1], letter[lead[~good]] = True, False
    start[:-1] = gap
    start[1:] |= data == 10
    start[at] = True
    starts = np.flatnonzero(start)
    behind = np.flatnonzero(letter[:-1] & ~letter[1:] & ~start[1:-1]) + 1
    word = np.searchsorted(starts, behind, "right") - 1
    cut = letter[starts[word] + (data[starts[word]] == 32)]
    cut[1:] &= word[1:] != word[:-1]  # only behind the first letters
    one = np.zeros(len(starts), bool)
    one[np.searchsorted(starts, np.flatnonzero((data > 127) & ~letter), "right") - 1] = True
    start[behind[cut & ~one[word]]] = True
    odd = np.zeros(len(at) - 1, bool)
    odd[np.searchsorted(at, np.flatnonzero(gap[:-1] & gap[1:]), "right") - 1] = True
    full = np.flatnonzero(at[1:] > at[:-1])
    odd[full] |= gap[at[full]] | gap[at[full + 1] - 1]
    return np.flatnonzero(start), odd


class Encoder:
    def __init__(self, path: str, bound: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bound = bound
        self.drops, self.model = self._drops(), self.tokenizer.model
        try:
            probes = [x for word in _PROBES for x in (word, " " + word)]
            ids, size = self._words([x.encode() for x in probes])
            self.direct = [x.tobytes() for x in np.split(ids, np.cumsum(size)[:-1])] == self._library(probes)
        except Exception:  # noqa: BLE001  a model of another kind
            self.direct = False
        self._forget()

    def _words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of Latin letters from the library's model itself, since each is one pre-token; and how many each has."""
        text = b"\n".join(units)
        if self.drops:  # this vocabulary has lower case only
            text = text.replace(b" ", b"").decode().lower().encode()
        words, tokenize = text.decode("latin-1").translate(_LETTERS).split("\n") if units else [], self.model.tokenize
        ids, size = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for k in range(0, len(words), 4096):
            made = [[t.id for t in tokenize(x)] for x in words[k : k + 4096]]
            ids.append(np.fromiter(chain.from_iterable(made), "<u4"))
            size.append(np.fromiter(map(len, made), np.int64, len(made)))
        return np.concatenate(ids), np.concatenate(size)

    def _forget(self) -> None:
        #: ids of the unit at place p: table[begin[p] : begin[p] + size[p]]; a size of -1 marks a unit whose text can't be cut
        self.places: dict[bytes, int] = {}
        self.used, self.filled = 0, 0
        self.table, self.begin, self.size, self.uses = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _shrink(self) -> None:
        """Keeps the units used most, half the bound at most; most units occur once."""
        uses, n = self.uses[: self.used], self.used
        least = max(2, int(np.partition(uses, n - self.bound // 2)[n - self.bound // 2]) + 1)
        kept = np.flatnonzero(uses >= least)
        new = np.full(n, -1, np.int64)
        new[kept] = np.arange(len(kept))
        some = [(x, p) for x, p in zip(self.places, new[np.fromiter(self.places.values(), np.int64, n)].tolist(), strict=True) if p >= 0]
        self.places = dict(some)
        size = self.size[kept]
        n_ids = size.clip(0)
        ends = np.cumsum(n_ids)
        self.table = self.table[np.repeat(self.begin[kept] - (ends - n_ids), n_ids) + np.arange(int(n_ids.sum()))]
        self.begin, self.size, self.uses = ends - n_ids, size, uses[kept] // 2
        self.used, self.filled = len(kept), len(self.table)

    def _drops(self) -> bool:
        """Whether white space leaves no trace in the ids."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        return ids(" a") == ids("a") == ids("a\n")

    def _library(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit bytes."""
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Gives new units the next places and fills these."""
        words, asked = [], []
        for k, unit in enumerate(new):
            if self.direct and (unit.isalpha() or unit[:1] == b" " and unit[1:].isalpha()):
                words.append(k)
                continue
            x = unit.decode().removeprefix(" ")
            if self.direct and x.isalpha() and max(x) < "\u0100":
                words.append(k)
            elif x == "\n" or x.split() == [x]:
                asked.append(k)
        ids, n = self._words([new[k] for k in words])
        others = self._library([new[k].decode() for k in asked])
        ids = np.concatenate((ids, np.frombuffer(b"".join(others), "<u4")))
        n = np.concatenate((n, np.array([len(x) // 4 for x in others], np.int64)))
        at = np.array(words + asked, np.int64)
        begin, size = np.zeros(len(new), np.int64), np.full(len(new), -1, np.int64)
        begin[at], size[at] = self.filled + np.cumsum(n) - n, n
        self.begin, self.size = _appended(self.begin, self.used, begin), _appended(self.size, self.used, size)
        self.uses = _appended(self.uses, self.used, np.zeros(len(new), np.int64))
        self.table = _appended(self.table, self.filled, ids)
        self.places.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used, self.filled = self.used + len(new), self.filled + len(ids)

    def flat(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (u32) of all whole texts, and the n + 1 places where each text's ids begin; null is empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if self.used > self.bound:
            self._shrink()
        collecting = gc.isenabled()
        gc.disable()  # many small lists, no cycles
        try:
            return self._flat(texts)
        finally:
            if collecting:
                gc.enable()

    def _flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = content(texts)
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        cuts, whole = _cuts(data, at)
        first = np.searchsorted(cuts, at)
        units = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        unit, code = units.dictionary.to_numpy(zero_copy_only=False).tolist(), units.indices.to_numpy()
        place = np.fromiter(map(self.places.get, unit, repeat(-1)), np.int64, len(unit))
        if len(new := np.flatnonzero(place < 0)):
            place[new] = self.used + np.arange(len(new))
            self._learn([unit[i] for i in new.tolist()])
        self.uses[place] += np.bincount(code, minlength=len(unit))
        size = self.size[place]
        if (size < 0).any():
            whole[np.searchsorted(first, np.flatnonzero(size[code] < 0), "right") - 1] = True
        n = size.clip(0)[code]
        ends = np.cumsum(n)
        out = self.table[np.repeat(self.begin[place][code] - (ends - n), n) + np.arange(ends[-1])]
        where = np.concatenate(([0], ends))[first]
        odd = np.flatnonzero(whole).tolist()
        if not odd:
            return out, where
        made = dict(zip(odd, self._library([texts[i].as_py() for i in odd]), strict=True))
        parts = [np.frombuffer(made[i], "<u4") if i in made else out[where[i] : where[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each whole text as bytes; null is empty."""
        ids, at = self.flat(texts)
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, bound: int = 500_000) -> Encoder:
    """One encoder a worker and path; the first caller's bound holds."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, bound)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
