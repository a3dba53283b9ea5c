"""Byte-level BPE over whole texts with a cache of units, through the ``tokenizers`` library.

A pre-token never crosses the start of a run of white space, so a text may be cut there and its units encoded one by one: the
tokens of the text are those of its units in order. Arrow cuts a run of texts and finds its different units, so that Python sees each
of them once a run. Units recur, so each worker remembers what the library gave for them. A text that holds a special token's
string, or white space runs that the quick cut cannot tell apart, is encoded whole by the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import pairwise
from string import punctuation
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
CACHE_UNITS = 1 << 18  # units of each of the two generations that a worker remembers, by default; what is forgotten costs time only
#: White space, as Python has it, before a space or line feed: a run that the quick cut would part.
BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}][\x0A\x20]"
LATEST = "\u04ff"  # the last letter of whose kind Python is trusted to say what the library says


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_units(text: str) -> list[str]:
    """Pieces of a text, cut at each space and before each line feed; the space itself is left out, the line feed kept."""
    return text.replace("\n", " \n").split(" ")


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes texts; ``value`` turns the ids of a unit into what is kept for it, ``join`` adds up the values of a text. Of two values
    the sum is that of both.

    The different units of a run of texts are looked up in two generations that a worker remembers. Of a unit that ends in ASCII
    punctuation after a letter or digit only what stands before it is remembered.
    """

    def __init__(self, vocabulary: str | Tokenizer, value: Callable[[list[int]], Any], join: Callable[[Iterable], Any], known: dict[str, Any] | None = None, remembered: int | None = None):
        self.tokenizer = Tokenizer.from_file(vocabulary) if isinstance(vocabulary, str) else vocabulary
        self.tokenize = self.tokenizer.model.tokenize
        self.value, self.join, self.remembered = value, join, remembered or CACHE_UNITS
        self.known = known or {}
        self.units: dict[str, Any] = dict(self.known)
        self.before: dict[str, Any] = {}
        self.tails: dict[str, Any] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        self.feed = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[Any]:
        return [self.value(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def tail(self, tail: str) -> Any:
        """The value of ASCII punctuation after a letter or digit."""
        value = self.tails.get(tail)
        if value is None:
            if len(self.tails) > self.remembered // 8:
                self.tails.clear()
            value = self.tails[tail] = self._whole([tail])[0]
        return value

    def unit(self, unit: str) -> Any:
        """The value of a unit, remembered."""
        value = self.before.get(unit)
        if value is None:
            value = self.made(unit)
        if len(self.units) > self.remembered + len(self.known):
            self.units, self.before = dict(self.known), self.units
        self.units[unit] = value
        return value

    def made(self, unit: str) -> Any:
        """The value of a unit by the library. Letters are one pre-token, known without the splitting steps, and the model takes them as
        they are; letters of later scripts go through the library whole, whose Unicode tables may be of another version than Python's."""
        fed = unit[0] == "\n"
        body = unit[1:] if fed else unit
        if not body.isalpha() or not (body.isascii() or max(body) <= LATEST):
            return self._whole([unit if fed else " " + unit])[0]
        if not body.isascii():
            body = body.encode().decode("latin-1").translate(self.letters)
        value = self.value([t.id for t in self.tokenize(body if fed else self.space + body)])
        return self.feed + value if fed else value

    def values(self, units: list[str]) -> list[Any]:
        """The value of each unit; none is empty or ends in white space."""
        found = list(map(self.units.get, units))
        for k, value in enumerate(found):
            if value is None:
                unit = units[k]
                stem = unit.rstrip(punctuation)
                last = stem[-1:]
                if len(stem) < len(unit) and last.isalnum() and last <= LATEST:
                    value = self.units.get(stem)
                    found[k] = (self.unit(stem) if value is None else value) + self.tail(unit[len(stem) :])
                else:
                    found[k] = self.unit(unit)
        return found

    def encode(self, texts: list[str] | pa.Array) -> list[Any]:
        """The joined value of each text, null as empty."""
        column = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        if not len(column):
            return []
        parts = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        sizes = pc.list_value_length(parts).to_numpy().astype(np.int64)
        uncut = sizes < 3
        for found in (pc.match_substring_regex(column, BLANKS), *(pc.match_substring(column, s) for s in self.special)):
            uncut |= found.to_numpy(zero_copy_only=False)
        whole: list[Any] = []
        if uncut.any():
            whole = self._whole(column.filter(pa.array(uncut)).to_pylist())
            parts, sizes = parts.filter(pa.array(~uncut)), sizes[~uncut]

        flat = parts.flatten()
        stops = np.cumsum(sizes)
        firsts, lasts = stops - sizes, stops - 1
        ends = [*flat.take(pa.array(firsts)).to_pylist(), *(x if x[:1] == "\n" else " " + x for x in flat.take(pa.array(lasts)).to_pylist())]
        flat = flat.dictionary_encode()
        places = flat.indices.to_numpy().astype(np.int64)
        inner = np.ones(len(places), bool)
        inner[firsts] = inner[lasts] = False
        used = np.zeros(len(flat.dictionary), bool)
        used[places[inner]] = True
        values = self.looked_up(flat.dictionary.filter(pa.array(used)))
        if not used.all():
            places = (np.cumsum(used) - 1)[places]
        places[firsts] = len(values) + np.arange(len(sizes))
        places[lasts] = len(values) + len(sizes) + np.arange(len(sizes))
        more = self._whole(ends)

        if whole:  # each has one place, where it stood
            all_sizes = np.ones(len(column), np.int64)
            all_sizes[~uncut] = sizes
            stops, cut_places = np.cumsum(all_sizes), places
            firsts, own = stops - all_sizes, np.zeros(stops[-1], bool)
            own[firsts[uncut]] = True
            places = np.empty(len(own), np.int64)
            places[own], places[~own] = len(values) + len(more) + np.arange(len(whole)), cut_places
            more += whole
        return self.joined(self.with_more(values, more), places, firsts)

    def looked_up(self, units: pa.Array) -> Any:
        """The values of different units, as ``joined`` takes them."""
        return self.values(units.to_numpy(zero_copy_only=False).tolist())

    def with_more(self, values: Any, more: list[Any]) -> Any:
        return values + more

    def joined(self, values: list[Any], places: np.ndarray, firsts: np.ndarray) -> list[Any]:
        """The joined value of each text: ``places`` of its values in ``values``, beginning at its number in ``firsts``."""
        picked = places.tolist()
        return [self.join([values[k] for k in picked[a:b]]) for a, b in pairwise([*firsts.tolist(), len(picked)])]


_encoders: dict[tuple, Encoder] = {}


def worker_encoder(key: tuple, make: Callable[[], Encoder]) -> Encoder:
    """One encoder for each key in a worker process, kept from task to task."""
    if key not in _encoders:
        if len(_encoders) > 3:
            _encoders.clear()
        _encoders[key] = make()
    return _encoders[key]
