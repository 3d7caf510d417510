"""Words of a text line to numbers, labels and columns."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Fixed value: how a decimal number may be spelled (sign, digits, exponent, f/d suffix).
# ``nan`` and ``infinity`` are deliberately words, not numbers.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?[fd]?$"

# Class names of the intrusion data set that are kept.
INLIER_CLASS = "normal"
OUTLIER_CLASSES = [
    "pod", "guess_passwd", "land", "spy", "phf", "warezmaster", "rootkit",
    "multihop", "loadmodule", "ftp_write", "buffer_overflow", "imap", "back",
]


def _word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``h = 31 h + unit`` over the UTF-16 units of every word, as signed 32 bits; and the first
    byte of every word, 0 if it has none."""
    units = words.fill_null("").cast(pa.large_binary())
    _, offsets, data = units.buffers()
    ends = np.frombuffer(offsets, np.int64)[units.offset:units.offset + len(units) + 1] if len(units) else np.zeros(1, np.int64)
    text = memoryview(data)[ends[0]:ends[-1]] if data is not None else b""
    flat = np.frombuffer(str(text, "utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
    # a byte that begins a character is a unit, one that begins a character of four bytes is two
    first = np.frombuffer(text, np.uint8)
    begun = np.concatenate([[0], np.cumsum((first & 0xC0 != 0x80).astype(np.int64) + (first >= 0xF0))])
    at = ends - ends[0]
    sizes, ends = np.diff(begun[at]), begun[at][1:]
    powers = np.ones(max(1, int(sizes.max(initial=0))), np.uint32)
    np.multiply.accumulate(np.full(len(powers) - 1, 31, np.uint32), out=powers[1:])
    flat *= powers[np.repeat(ends, sizes) - 1 - np.arange(len(flat))]
    hashes, heads, some = np.zeros(len(units), np.uint32), np.zeros(len(units), np.uint8), sizes > 0
    if len(flat):
        hashes[some] = np.add.reduceat(flat, (ends - sizes)[some], dtype=np.uint32)
        heads[some] = first[at[:-1][some]]
    return hashes.view(np.int32).astype(np.float64), heads


def _around(lists: pa.Array, values: pa.Array) -> pa.Array:
    """The lists as they are, null ones and slices included, around new values."""
    lengths = pa.compute.list_value_length(lists).fill_null(0).to_numpy(False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null())


PIECE = 1 << 16  # words that are hashed at once
PIECE_BYTES = 4 << 20  # and their bytes, but for a word that is longer


def _pieces(words: pa.Array):
    """Slices of ``words`` that are bounded in number and bytes."""
    size = pa.compute.binary_length(words).fill_null(0).to_numpy(False)
    end = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < len(words):
        before = end[start] - size[start]
        stop = max(start + 1, int(np.searchsorted(end, before + PIECE_BYTES, "right")))
        stop = min(stop, start + PIECE)
        yield words.slice(start, stop - start)
        start = stop


def _in_pieces(lists: pa.Array, values_of) -> pa.Array:
    """Doubles for the words of lists: what is needed on the way is bounded, whatever the lists hold."""
    words = lists.flatten()
    values = np.empty(len(words))
    done = 0
    for piece in _pieces(words):
        values[done:done + len(piece)] = values_of(piece)
        done += len(piece)
    return _around(lists, pa.array(values, mask=words.is_null().to_numpy(False)))


@F.arrow_udf(ArrayType(DoubleType()))
def _hashes(lists: pa.Array) -> pa.Array:
    return _in_pieces(lists, lambda words: _word_hashes(words)[0])


def _spelled(words: pa.Array) -> np.ndarray:
    values, heads = _word_hashes(words)
    # few words begin as numbers do: with a blank, a sign, a point or a digit
    likely = np.flatnonzero((heads >= ord(" ")) & (heads <= ord("9")))
    spelled = re.compile(NUMBER, re.ASCII)
    for at, word in zip(likely.tolist(), words.take(pa.array(likely)).to_pylist()):
        bare = word.strip(" ")
        inner = bare.rstrip("\r\n")
        if bare[len(inner):] in ("", "\n", "\r", "\r\n") and spelled.match(inner):
            values[at] = float(inner.rstrip("fd"))
    return values


@F.arrow_udf(ArrayType(DoubleType()))
def _numbers_or_hashes(lists: pa.Array) -> pa.Array:
    return _in_pieces(lists, _spelled)


def string_hashes(words: Column) -> Column:
    """Of an array of words the 32-bit signed hashes over UTF-16 units, as doubles."""
    return _hashes(words)


def string_hash(word: Column) -> Column:
    """The hash of one word."""
    return string_hashes(F.array(word))[0]


def numbers_or_hashes(words: Column) -> Column:
    """Of each lower-case word the number that it spells, else its hash."""
    return _numbers_or_hashes(words)


def blank_separated(line: Column) -> Column:
    """Words between single blanks; trailing blanks make no words."""
    kept = F.regexp_replace(line, " +$", "")
    words = F.split(kept, " ")
    only_blanks = (kept == "") & (F.length(line) > 0)
    return F.when(only_blanks, F.array().cast("array<string>")).otherwise(words)


def parse_point(line: Column, dims: int | None = None) -> Column:
    """A text record as a vector; words that are not numbers count by their hash.

    Words beyond ``dims`` are ignored.
    """
    parsed = numbers_or_hashes(blank_separated(F.lower(line)))
    return parsed if dims is None else F.slice(parsed, 1, dims)


def words(line: Column) -> Column:
    """Words between runs of white space."""
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def feature_words(parts: Column, dims: int) -> Column:
    """The ``dims`` words after the key."""
    return F.slice(parts, 2, dims)


def label_word(parts: Column, dims: int) -> Column:
    """The word after key and features, when the line is long enough to have one."""
    return F.when(F.size(parts) > dims + 1, F.try_element_at(parts, F.lit(dims + 2)))


def without_second_last(parts: Column) -> Column:
    head = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.concat(head, F.slice(parts, F.greatest(F.size(parts), F.lit(1)), F.lit(1)))


def class_label(name: Column) -> Column:
    """0 for the normal class, 1 for a kept attack, null for classes to be dropped."""
    return F.when(name == INLIER_CLASS, F.lit(0)).when(name.isin(OUTLIER_CLASSES), F.lit(1))


def to_ml_vector(x: Column) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(x)


def from_ml_vector(v: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(v)


def run_name(
    dataset: str,
    dims: int,
    algorithm: str,
    k: int,
    measure: str,
    technique: str,
    hashes: int | None = None,
    tables: int | None = None,
    planes: int | None = None,
    window: int | None = None,
    inlier_percent: int | None = None,
    max_age: int | None = None,
) -> str:
    """The parameter-coded name of a result: what ``run_parameters`` reads back."""
    parts = [dataset, f"d{dims}", algorithm, f"k{k}", measure[:3], technique]
    if hashes is not None:
        parts += [f"h{hashes}", f"t{tables}"]
    elif planes is not None:
        parts += [f"p{planes}", f"t{tables}"]
    if window is not None:
        parts += [f"w{window}", f"i{inlier_percent}", f"a{max_age}"]
    return "-".join(parts).lower()


def run_parameters(name: Column) -> dict[str, Column]:
    """Parameters coded in a result's name; null where the name has none."""
    marks = {
        "dims": "d", "k": "k", "hashes": "h", "planes": "p", "tables": "t",
        "window": "w", "inlier_percent": "i", "max_age": "a",
    }
    found = {
        column: F.regexp_extract(name, rf"-{mark}(\d+)(?=-|$|\.)", 1).try_cast("int")
        for column, mark in marks.items()
    }
    found["ms"] = F.regexp_extract(name, r"-(\d+)ms", 1).try_cast("bigint")
    return found
