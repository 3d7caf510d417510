"""Periodic runs of words, found by difference-cover longest common extensions.

A run is a longest stretch that repeats with a smallest period of q words.  Every run of three
periods or more holds two neighbouring points of the grid of multiples of q, so for each q only
grid points ask how far the text at them agrees with the text q words on: n (1 + 1/2 + 1/3 ...)
questions for n words.  Most end at the first words.  For the others the suffixes at the places
of a difference cover are sorted, and no more: any two places reach such suffixes after the same
few words, and the rest of the answer is a range minimum over the prefixes that neighbours in
sorted order share, looked up in a sparse table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farfield.llm.common import packed, text_of

#: Every difference modulo ``CYCLE`` occurs between two places of ``COVER`` (a perfect difference set).
CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)
SHORTEST, TIMES = 24, 3  # a run has this many words, and this many periods
FEW = 8  # words that a question compares before suffixes are sorted for it
CHUNK = 1 << 18  # words looked at together; a longer document is a chunk of its own
ASKED = 1 << 21  # questions held at once
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class Extensions:
    """How many words agree from two places on, in ``ids``.

    An id that occurs once must end ``ids``; then no two suffixes are equal.
    """

    def __init__(self, ids):
        import numpy as np

        self.ids, n = ids, len(ids)
        inside = np.zeros(CYCLE, bool)
        inside[list(COVER)] = True
        step = np.arange(CYCLE)
        both = inside[(step[:, None, None] + step) % CYCLE] & inside[(step[None, :, None] + step) % CYCLE]
        self.ahead = both.argmax(axis=2)  # words until both places are in the cover
        self.places = np.flatnonzero(inside[np.arange(n) % CYCLE])
        self.number = np.full(n, -1, np.int64)
        self.number[self.places] = np.arange(len(self.places))
        self._sort()
        self._table()

    def _sort(self) -> None:
        """Ranks of the suffixes at ``places``, and of their beginnings of 1, 2, 4 ... cycles."""
        import numpy as np

        def refine(tied, key):
            """Order ``tied`` by rank, then key; what is alone needs no more comparing."""
            if not len(tied):
                return tied
            order = np.lexsort((key, rank[tied]))
            tied, key = tied[order], key[order]
            was, at = rank[tied], np.arange(len(tied))
            new = np.r_[True, was[1:] != was[:-1]]
            apart = new | np.r_[True, key[1:] != key[:-1]]
            rank[tied] = was + np.maximum.accumulate(np.where(apart, at, 0)) - np.maximum.accumulate(np.where(new, at, 0))
            alone = apart & np.r_[apart[1:], True]
            return tied[~alone]

        rank = np.zeros(len(self.places), np.int64)
        tied = np.arange(len(self.places))
        bits = int(self.ids.max() + 1).bit_length()
        padded, pack = np.r_[self.ids + 1, np.zeros(CYCLE, np.int64)], 63 // bits
        for first in range(0, CYCLE, pack):
            key = np.zeros(len(tied), np.int64)
            for k in range(first, min(first + pack, CYCLE)):
                key = (key << bits) | padded[self.places[tied] + k]
            tied = refine(tied, key)
        self.levels, cycles = [rank.copy()], 1
        while len(tied):
            tied = refine(tied, self.levels[-1][self.number[self.places[tied] + cycles * CYCLE]])
            self.levels.append(rank.copy())
            cycles *= 2
        self.rank = rank

    def _table(self) -> None:
        """Minima over 1, 2, 4 ... neighbours of the prefix that each shares with the one before."""
        import numpy as np

        sorted_ = np.argsort(self.rank)
        a, b = self.places[sorted_[:-1]], self.places[sorted_[1:]]
        shared = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            level, words = self.levels[k], CYCLE << k
            same = np.flatnonzero(level[self.number[a + shared]] == level[self.number[b + shared]])
            shared[same] += words
        shared += self._agree(a + shared, b + shared, np.full(len(a), CYCLE))
        self.levels, self.minima = None, [shared]
        width = 1
        while 2 * width <= len(shared):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _agree(self, a, b, most):
        """Words that agree from ``a`` and ``b`` on, up to ``most``, by comparing them."""
        return agreeing(self.ids, a, b, most)

    def __call__(self, a, b):
        import numpy as np

        ahead = self.ahead[a % CYCLE, b % CYCLE]
        found = self._agree(a, b, ahead)
        far = np.flatnonzero(found == ahead)
        x, y = (self.rank[self.number[p[far] + ahead[far]]] for p in (a, b))
        low, high = np.minimum(x, y), np.maximum(x, y)
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(power).tolist():
            some = power == k
            at, minima = far[some], self.minima[k]
            found[at] += np.minimum(minima[low[some]], minima[high[some] - (1 << k)])
        return found


def agreeing(ids, a, b, most):
    """For each pair of places, how many of the next ``most`` words agree before two differ."""
    import numpy as np

    found, open_ = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    k = 0
    while len(open_):
        open_ = open_[ids[a[open_] + k] == ids[b[open_] + k]]
        k += 1
        found[open_] = k
        open_ = open_[most[open_] > k]
    return found


def _grid(starts, sizes):
    """All questions ``(document, period, place)``, some at a time."""
    import numpy as np

    periods = sizes // TIMES
    doc = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (sizes[doc] - 1) // period  # grid points that have a word one period on
    cut, whole = 0, np.cumsum(points)
    while cut < len(doc):
        end = max(cut + 1, int(np.searchsorted(whole, (whole[cut - 1] if cut else 0) + ASKED, "right")))
        n = points[cut:end]
        d, p = np.repeat(doc[cut:end], n), np.repeat(period[cut:end], n)
        yield d, p, starts[d] + p * (np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n))
        cut = end


def _asked(ids, starts, sizes):
    """Questions whose first words agree, as every run's first grid point's do."""
    import numpy as np

    kept = []
    for d, p, i in _grid(starts, sizes):
        same = np.flatnonzero(ids[i] == ids[i + p])
        d, p, i = d[same], p[same], i[same]
        most = np.minimum(p, FEW)
        same = agreeing(ids, i, i + p, most) == most
        kept.append((d[same], p[same], i[same]))
    return [np.concatenate(c) for c in zip(*kept)] if kept else [np.zeros(0, np.int64)] * 3


def find_runs(ids, starts, sizes):
    """``document, start, length, period`` of all runs, in order of the first two and the last.

    Document k is ``sizes[k]`` ids from ``starts[k]`` on, followed by an id that occurs once.
    """
    import numpy as np

    d, p, i = _asked(ids, starts, sizes)
    none = np.zeros((0, 4), np.int64)
    if not len(d):
        return none
    # only documents with open questions are sorted
    some = np.unique(d)
    whole = sizes[some] + 1
    begin = np.cumsum(whole) - whole
    moved = np.repeat(starts[some] - begin, whole) + np.arange(whole.sum())
    i += (begin - starts[some])[np.searchsorted(some, d)]
    reach = Extensions(ids[moved])
    length = reach(i, i + p)
    first = i - begin[np.searchsorted(some, d)] < p
    enough = length >= p
    d, p, i, length, first = (c[enough] for c in (d, p, i, length, first))
    before = np.flatnonzero(~first)  # a run that holds the grid point before is found there
    again = before[reach(i[before] - p[before], i[before]) >= p[before]]
    left = np.ones(len(d), bool)
    left[again] = False
    d, p, i, length, first = (c[left] for c in (d, p, i, length, first))
    at = begin[np.searchsorted(some, d)]
    low, high = np.where(first, at, i - p + 1), i.copy()  # the start, by halving
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        holds = reach(middle, middle + p[open_]) >= i[open_] - middle
        high[open_[holds]] = middle[holds]
        low[open_[~holds]] = middle[~holds] + 1
    found = np.stack([d, low - at, i + p + length - low, p], axis=1)
    found = found[found[:, 2] >= np.maximum(SHORTEST, TIMES * p)]
    # a multiple of the period finds the same stretch again: the smallest stands
    found = found[np.lexsort(found.T[[3, 2, 1, 0]])]
    same = np.r_[False, (found[1:, :3] == found[:-1, :3]).all(axis=1)] if len(found) else np.zeros(0, bool)
    found = found[~same]
    return found[np.lexsort(found.T[[3, 1, 0]])] if len(found) else none


def _chunk(texts: list) -> tuple[list, list]:
    """Runs and collapsed text of each text (bytes)."""
    import numpy as np
    import pyarrow as pa

    split = [t.split() for t in texts]  # bytes: ASCII white space only
    sizes = np.array([len(w) for w in split], np.int64)
    codes = pa.array([w for s in split for w in s], pa.large_binary()).dictionary_encode()
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.empty(int(sizes.sum()) + len(texts), np.int64)
    ends = starts + sizes
    inner = np.ones(len(ids), bool)
    inner[ends] = False
    ids[inner] = codes.indices.to_numpy()
    ids[ends] = len(codes.dictionary) + np.arange(len(texts))
    found = find_runs(ids, starts, sizes)
    edges = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    runs, collapsed = [], []
    for k, words in enumerate(split):
        mine = found[edges[k]:edges[k + 1], 1:]
        if len(mine):
            start, length, period = mine.T
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in mine.tolist()])
        collapsed.append(b" ".join(words))
    return runs, collapsed


def _searched(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        column = batch["text"].cast(pa.large_binary())
        counts, cut = batch["bound"].to_numpy(), 0
        while cut < batch.num_rows:
            end, held = cut + 1, counts[cut]
            while end < batch.num_rows and held + counts[end] <= CHUNK:
                held += counts[end]
                end += 1
            runs, collapsed = _chunk(column.slice(cut, end - cut).to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch["row"].slice(cut, end - cut), pa.array(runs, kind),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ], names=["row", "runs", "collapsed"])
            cut = end


def searched(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row, runs, collapsed`` for each document of ``text``.

    ``runs`` is an array of ``start, length, period`` in words from 0, by start, then period.
    ``collapsed`` holds the words that no run repeats, joined by single blanks: of each run its
    first period stays.  A null or empty text has no runs and collapses to an empty one.  Rows
    are looked at one by one, so repeated rows repeat their result; a text is read whole.
    """
    text = text_of()
    rows = packed(docs, text.alias("text"), ((F.octet_length(text) + 1) / 2).cast("long").alias("bound"), keep=keep)
    out = rows.select("row").schema.add("runs", T.ArrayType(RUN)).add("collapsed", "string")
    return rows.mapInArrow(_searched, out)
