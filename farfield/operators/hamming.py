"""The nearest words of many by Hamming distance: an index of their pieces, for use inside a task."""

from __future__ import annotations

from itertools import combinations

import numpy as np

WORD = 32  # bits held in one number while distances are counted
PIECE = 16  # bits of a piece that words are looked up by
ASKING = 1 << 11  # points that look words up together
PAIRS = 1 << 18  # pairs compared at once: they stay in a core's cache
GATHERED = 1 << 22  # words looked up at once
PROBE, VISIT = 4, 12  # cost of a look-up, and of a word found by one, in comparisons in a row


def flips(bits: int, apart: int) -> np.ndarray:
    """All masks of ``bits`` bits of which ``apart`` are set."""
    return np.array([sum(1 << b for b in of) for of in combinations(range(bits), apart)], dtype=np.int64)


class NearWords:
    """Finds for each of some words the ``k`` first of ``words`` by bits apart, then place; never itself.

    Words that are few bits apart are fewer apart in one of their pieces.  So the words that share a
    piece are looked up first, then those with a piece one bit off, and so on, until the ``k`` found
    are no farther than any word not looked up can be.  Where look-ups would visit more than
    comparing with all words costs (long words, pieces that many share), all are compared.
    """

    def __init__(self, words: np.ndarray, sides: int, k: int):
        self.words, self.sides, self.k = words, sides, k
        self.pieces, self.masks = [], {}
        for n in range(words.shape[1]):
            held = min(WORD, sides - n * WORD)
            for shift in range(0, held, PIECE):
                bits = min(PIECE, held - shift)
                value = self.piece(words, n, shift, bits)
                starts = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << bits))])
                self.pieces.append((n, shift, bits, np.argsort(value, kind="stable"), starts))

    @staticmethod
    def piece(words, n, shift, bits):
        return (words[:, n].astype(np.int64) >> shift) & ((1 << bits) - 1)

    def of(self, own: np.ndarray):
        """``row, apart, place`` of the words nearest to each row of ``own``, in that order."""
        left = np.arange(len(own))
        found, bound = tuple(np.empty(0, np.int64) for _ in range(3)), np.full(len(own), self.sides)
        done = [found]
        for covered, off, piece in self.steps():
            if not len(left):
                break
            n, shift, bits, order, starts = piece
            if (bits, off) not in self.masks:
                self.masks[bits, off] = flips(bits, off)
            value = self.piece(own[left], n, shift, bits)[:, None] ^ self.masks[bits, off]
            size = (starts[value + 1] - starts[value]).sum(axis=1)
            if PROBE * value.size + VISIT * size.sum() > len(left) * len(self.words):
                break
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // GATHERED, prepend=0))
            for some in np.split(np.arange(len(left)), cuts):
                first, each = starts[value[some]].ravel(), (starts[value[some] + 1] - starts[value[some]]).ravel()
                place = np.arange(each.sum()) + np.repeat(first - np.cumsum(each) + each, each)
                row, at = np.repeat(np.repeat(left[some], value.shape[1]), each), order[place]
                found = self.merged(found, row, self.apart(own[row], self.words[at]), at, bound)
            ready = bound[left] <= covered
            ready &= np.bincount(found[0], minlength=len(own))[left] >= self.k
            finished = np.zeros(len(own), bool)
            finished[left[ready]] = True
            out = finished[found[0]]
            done.append(tuple(c[out] for c in found))
            found, left = tuple(c[~out] for c in found), left[~ready]
        if len(left):
            done.append(self.compared(own, left))
        row, apart, at = (np.concatenate(c) for c in zip(*done))
        order = np.lexsort((at, apart, row))
        return row[order], apart[order], at[order]

    def steps(self):
        """Pieces to look up, so many bits off, and how far apart words may be that are all found by then."""
        for off in range(max(bits for _, _, bits, _, _ in self.pieces) + 1):
            for m, piece in enumerate(self.pieces):
                yield len(self.pieces) * off + m, off, piece

    @staticmethod
    def apart(a, b):
        return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)

    def merged(self, found, row, apart, at, bound):
        """The ``k`` first of each row's words, old and new, each once; tightens ``bound``."""
        near = (apart > 0) & (apart <= bound[row])
        row, apart, at = (np.concatenate([old, new[near]]) for old, new in zip(found, (row, apart, at)))
        order = np.lexsort((at, apart, row))
        row, apart, at = row[order], apart[order], at[order]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
        row, apart, at = row[once], apart[once], at[once]
        counts = np.bincount(row, minlength=len(bound))
        starts = np.cumsum(counts) - counts
        full = np.flatnonzero(counts >= self.k)
        bound[full] = apart[starts[full] + self.k - 1]
        first = np.arange(len(row)) - starts[row] < self.k
        return row[first], apart[first], at[first]

    def compared(self, own, left):
        """The same for the rows ``left`` by comparing them with all words, block by block."""
        done, width = [], min(len(self.words), PAIRS >> 7)
        for start in range(0, len(left), max(1, PAIRS // width)):
            rows = left[start : start + max(1, PAIRS // width)]
            asking, bound = own[rows], np.full(len(rows), self.sides)
            found = tuple(np.empty(0, np.int64) for _ in range(3))
            for at in range(0, len(self.words), width):
                words = self.words[at : at + width]
                apart = np.zeros((len(rows), len(words)), np.uint8 if self.sides < 256 else np.uint16)
                for n in range(words.shape[1]):
                    apart += np.bitwise_count(asking[:, None, n] ^ words[None, :, n])
                if at == 0 and len(words) > self.k:  # the own word may be one of them
                    bound = np.partition(apart, self.k, axis=1)[:, self.k].astype(np.int64)
                row, col = np.divmod(np.flatnonzero(apart <= bound.astype(apart.dtype)[:, None]), len(words))
                if len(row):
                    found = self.merged(found, row, apart[row, col].astype(np.int64), col + at, bound)
            done.append((rows[found[0]], *found[1:]))
        return tuple(np.concatenate(c) for c in zip(*done))
