"""Quality rules by repetition coverage (operator 10).

A document's words are hashed once; rolling hashes of several n-gram lengths are built from them in numpy, and the characters
that lie inside n-grams found twice or more, or inside lines equal to an earlier line, are measured against all characters in words.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged alike, row by row; an empty
table gives no rows;
other columns of the table, whatever their names, are neither read nor changed. Very long texts are handled whole: memory per
text is a small multiple of its own bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from meterloom.llm.common import free_name, struct_column

#: The symbols counted by the base rules.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hash, modulo 2**64

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    repeat_percent: int = 50
    #: n-gram length -> largest share of word characters that may lie inside repeated n-grams
    ngram_share: tuple[tuple[int, float], ...] = ((5, 0.40), (7, 0.35), (10, 0.30))
    #: largest share of word characters in lines equal to an earlier line
    line_share: float = 0.30


def _covered(hashes: np.ndarray, n: int, size: int) -> np.ndarray:
    """Marks the words (of ``size``) inside n-grams whose rolling hash occurs twice or more."""
    order = np.sort(hashes)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return np.zeros(size, bool)
    at = np.searchsorted(again, hashes)
    at[at == len(again)] = 0
    starts = np.flatnonzero(again[at] == hashes)
    edges = np.zeros(size + 1, np.int32)
    edges[starts] += 1
    np.subtract.at(edges, starts + n, 1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str, rules: Rules = Rules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_chars, a count per n-gram length, kept."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    words = data.split()
    n_words = len(words)
    longest = max(n for n, _ in rules.ngram_share)
    if not n_words:
        return (0, 0, 0, 0, 0, True, 0, *(0 for _ in rules.ngram_share), False)
    space = _SPACE[raw]
    letters = ~space & ((raw & 0xC0) != 0x80)  # one per code point in a word
    word_chars = int(letters.sum())
    n_symbols = int(_SYMBOL[raw].sum())

    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in data.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            inside = line.translate(None, SPACES)
            dup_line_chars += len(inside.decode("utf-8", "surrogatepass"))
        elif line.strip(SPACES):
            seen.add(line)

    n_repeat_words = 0
    shares = dict.fromkeys((n for n, _ in rules.ngram_share), 0)
    rolling = hashes = np.fromiter(map(hash, words), np.int64, n_words).astype(np.uint64)
    at = np.cumsum(letters, dtype=np.int64)
    turn = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    lengths = at[turn[1::2] - 1] - at[turn[::2]] + 1
    for n in range(1, min(max(longest, 3), n_words - 1) + 1):
        if n > 1:
            rolling = rolling[:-1] * BASE + hashes[n - 1 :]
        if n == 3 or n in shares:
            inside = _covered(rolling, n, n_words)
            if n == 3:
                n_repeat_words = int(inside.sum())
            if n in shares:
                shares[n] = int(lengths[inside].sum())
            if n >= 3 and not inside.any():  # no longer n-gram can repeat either
                break

    base_failed = n_words < rules.min_words or 100 * n_repeat_words > rules.repeat_percent * n_words
    kept = not base_failed and dup_line_chars <= rules.line_share * word_chars and all(shares[n] <= most * word_chars for n, most in rules.ngram_share)
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_chars, *shares.values(), kept)


def schema(rules: Rules = Rules()) -> StructType:
    long = [*"n_words word_chars n_symbols n_dup_lines n_repeat_words".split()]
    more = ["dup_line_chars", *(f"dup_{n}gram_chars" for n, _ in rules.ngram_share)]
    return StructType([*(StructField(c, LongType()) for c in long), StructField("base_failed", BooleanType()), *(StructField(c, LongType()) for c in more), StructField("kept", BooleanType())])


def annotate(docs: DataFrame, name: str, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Adds a struct column ``name`` with the measures and the verdict of each row."""
    judge = struct_column(lambda x: measure(x, rules), schema(rules))
    return docs.withColumn(name, judge(F.col(f"`{text}`")))


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id with its measures, one row per row of ``docs``."""
    return annotate(docs.select("doc_id", "text"), "q", rules=rules).select("doc_id", "q.*")


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows whose text passes, with all their columns as they were."""
    name = free_name(docs, "quality")
    return annotate(docs, name, rules=rules).where(F.col(name)["kept"]).drop(name)
