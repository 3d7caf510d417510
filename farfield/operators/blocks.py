"""Arrow kernels of the kNN join: each works on bounded blocks of points inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

NEIGHBOUR = pa.struct([("dist", pa.float64()), ("j", pa.int64())])
STEPPED = pa.struct([("dist", pa.float64()), ("j", pa.int64()), ("step", pa.int32())])
VISITORS = 1 << 13  # points of a tile that are held against another leaf at once
PAIRS_AT_ONCE = 1 << 17  # a block of distances stays in a core's cache
FIRST_BLOCK = 64  # points that are the first to be held against a tile; the next block is twice as large
SMALL = 1 << 10  # pairs of a leaf that is not worth calls of its own
DENSE = 16  # where one pair of so many shares a bucket, all pairs are compared
CROWD = 4  # a row that passes more than so many times k pairs is cut by its own k-th first


def matrix(flat: np.ndarray, dims: int) -> np.ndarray:
    return flat.reshape(-1, dims)


def flat_lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (starting at zero) and flat values of an Arrow list column."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def lists(values, lengths) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def halve(x: np.ndarray, rows: np.ndarray, cap: int) -> list[np.ndarray]:
    """Cut rows at the median of their widest coordinate until each piece fits ``cap``."""
    if len(rows) <= cap:
        return [rows]
    part = x[rows]
    axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
    middle = len(rows) // 2
    order = np.argpartition(part[:, axis], middle)
    return halve(x, rows[order[:middle]], cap) + halve(x, rows[order[middle:]], cap)


def edges(x: np.ndarray, heads: np.ndarray, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of the leaves that begin at ``heads``, or of their unit vectors."""
    if unit:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return np.minimum.reduceat(x, heads), np.maximum.reduceat(x, heads)


def pack_leaves(dims: int, cap: int, unit: bool):
    """Rows sorted by group and curve position -> one row per leaf of at most ``cap`` points.

    Streams: never holds more than a few chunks, whatever the size of a group.
    """
    chunk = 32 * cap

    def pieces(grp, x, final):
        """Leaves that can be closed now, and how many rows they use up."""
        edges = np.flatnonzero(grp[1:] != grp[:-1]) + 1
        starts = np.concatenate([[0], edges])
        stops = np.concatenate([edges, [len(grp)]])
        done, used = [], 0
        for start, stop in zip(starts, stops):
            if stop == len(grp) and not final:
                while stop - start >= 2 * chunk:
                    done += halve(x, np.arange(start, start + chunk), cap)
                    start += chunk
                return done, start
            done += halve(x, np.arange(start, stop), cap)
            used = stop
        return done, used

    def emit(leaves, first_leaf, grp, ids, x, role, reach):
        perm = np.concatenate(leaves)
        sizes = np.array([len(rows) for rows in leaves])
        heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x, role, count = x[perm], role[perm], len(leaves)
        low, high = edges(x, heads, unit)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(first_leaf + np.arange(count)),
                pa.array(grp[perm][heads]),
                pa.array(np.add.reduceat(role & 1, heads).astype(np.int32)),
                pa.array(np.add.reduceat((role >> 1) & 1, heads).astype(np.int32)),
                lists(pa.array(ids[perm]), sizes),
                lists(pa.array(x.ravel()), sizes * dims),
                lists(pa.array(role.astype(np.int32)), sizes),
                lists(pa.array(reach[perm]), sizes),
                lists(pa.array(low.ravel()), np.full(count, dims)),
                lists(pa.array(high.ravel()), np.full(count, dims)),
            ],
            names=["leaf", "grp", "queries", "candidates", "ids", "xs", "roles", "reaches", "lo", "hi"],
        )

    def run(batches):
        leaf = TaskContext.get().partitionId() << 32
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, flat = flat_lists(batch.column("x"))
            fresh = [
                batch.column("grp").to_numpy(),
                batch.column("i").to_numpy(),
                matrix(flat, dims),
                batch.column("role").to_numpy(),
                batch.column("reach").to_numpy(),
            ]
            held = fresh if held is None else [np.concatenate(pair) for pair in zip(held, fresh)]
            if len(held[0]) >= 2 * chunk:
                done, used = pieces(held[0], held[2], final=False)
                if done:
                    yield emit(done, leaf, *held)
                    leaf += len(done)
                held = [column[used:] for column in held]
        if held is not None and len(held[0]):
            done, _ = pieces(held[0], held[2], final=True)
            yield emit(done, leaf, *held)

    return run


def row_bounds(values, k, cap):
    """Per row: the k-th smallest value where at least ``k`` are within ``cap``, else ``cap``.

    Most rows that visit another leaf find fewer than ``k`` there and are never sorted.
    """
    if k is None:
        return cap
    crowded = np.count_nonzero(values <= cap[:, None], axis=1) >= k
    bound = cap.copy()
    if crowded.any():
        bound[crowded] = np.partition(values[crowded], k - 1, axis=1)[:, k - 1]
    return bound


def pieces(rows: int, others: int):
    """Slices of rows that with ``others`` make up to ``PAIRS_AT_ONCE`` pairs."""
    step = max(1, PAIRS_AT_ONCE // max(1, others))
    return [slice(start, min(start + step, rows)) for start in range(0, rows, step)]


def exact(measure):
    """Compares blocks by the measure's key; takes distances only of pairs that pass."""

    def near(a, b, void, k, limit):
        found, bound = [(np.empty(0, int), np.empty(0, int), np.empty(0))], limit.copy()
        for part in pieces(len(a), len(b)):
            key = measure.key(a[part][:, None, :], b[None, :, :])
            key[np.isnan(key)] = np.inf
            if void is not None:
                key[void(part)] = np.inf
            top = row_bounds(key, k, measure.lift(limit[part]))
            bound[part] = np.minimum(limit[part], measure.unkey(top))
            # different keys may share a distance: lift the bound to keep all ties
            row, col = np.nonzero(key <= measure.lift(bound[part])[:, None])
            dist = measure.unkey(key[row, col])
            keep = dist <= bound[part][row]
            found.append((row[keep] + part.start, col[keep], dist[keep]))
        return *(np.concatenate(parts) for parts in zip(*found)), bound

    return near


def screened(measure):
    """The same result for many coordinates: a matrix product rules pairs out first.

    Only pairs that could be within their row's bound are then computed term by term, all rows
    at once, and the bound itself is taken from those exact values.  Most rows pass few pairs by
    the limit they came with and need no more than the product and one comparison.
    """

    def near(a, b, void, k, limit):
        product, top, off = measure.screen(a, b, limit)
        hits = [np.empty(0, int)]
        for part in pieces(len(a), len(b)):
            about = product(part)
            if void is not None:
                about[void(part)] = np.inf
            passed = about <= top[part][:, None]
            hit = np.flatnonzero(passed)
            if k is not None and len(hit) > CROWD * k:
                crowded = np.flatnonzero(np.bincount(hit // len(b)) > CROWD * k)
                if len(crowded):
                    some = about[crowded]
                    least = np.partition(some, k - 1, axis=1)[:, k - 1]
                    passed[crowded] &= some <= (least + 2 * off[part][crowded])[:, None]
                    hit = np.flatnonzero(passed)
            hits.append(hit + part.start * len(b))
        row, col = np.divmod(np.concatenate(hits), max(1, len(b)))
        # coordinate by coordinate, as sums are added: a coordinate of all pairs lies together
        of_a, of_b, step = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), PAIRS_AT_ONCE >> 5
        dist = np.concatenate([np.empty(0)] + [
            measure.rows(of_a[:, row[at : at + step]].T, of_b[:, col[at : at + step]].T) for at in range(0, len(row), step)
        ])
        dist[np.isnan(dist)] = np.inf
        if void is not None:
            dist[void((row, col))] = np.inf
        bound = tightened(row, dist, k, limit)
        keep = dist <= bound[row]
        return row[keep], col[keep], dist[keep], bound

    return near


def tightened(row, dist, k, limit):
    """Per row: the k-th smallest of its distances if that is below its limit, else the limit."""
    bound = limit.copy()
    if k is not None and len(row):
        counts = np.bincount(row, minlength=len(limit))
        full = np.flatnonzero(counts >= k)
        if len(full):
            ordered = dist[np.lexsort((dist, row))]
            bound[full] = np.minimum(bound[full], ordered[(np.cumsum(counts) - counts)[full] + k - 1])
    return bound


def nearest(near, a, b, a_ids, b_ids, k, limit, skip_self):
    """Neighbours of each row of ``a`` among ``b``: within ``limit`` and, if ``k`` is
    given, within the k-th smallest distance (ties kept).

    Returns row numbers, neighbour ids, distances (sorted by row, distance, id) and
    the bound each row ended up with.
    """
    void = None
    if skip_self and len(np.intersect1d(a_ids, b_ids)):
        void = lambda at: (
            a_ids[at, None] == b_ids[None, :] if isinstance(at, slice) else a_ids[at[0]] == b_ids[at[1]]
        )
    row, col, dist, bound = near(a, b, void, k, limit)
    real = dist < np.inf
    row, j, dist = row[real], b_ids[col[real]], dist[real]
    order = np.lexsort((j, dist, row))
    return row[order], j[order], dist[order], bound


def neighbour_lists(row, j, dist, rows: int) -> pa.ListArray:
    structs = pa.StructArray.from_arrays([pa.array(dist), pa.array(j)], fields=list(NEIGHBOUR))
    return lists(structs, np.bincount(row, minlength=rows))


def small_leaves(distance, offsets, ids, x, roles, reaches, k, skip_self):
    """What ``nearest`` finds in each of many leaves of few points, all their pairs at once.

    Row numbers of the query points, then for these what ``nearest`` returns; and which leaves it
    was done for.
    """
    size = np.diff(offsets)
    small = size * size <= SMALL
    size, first = size[small], offsets[:-1][small]
    mine = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    asking = mine[roles[mine] & 1 > 0]
    number = np.full(len(ids), -1)
    number[asking] = np.arange(len(asking))
    bound = reaches[asking].copy()
    found, step = [], PAIRS_AT_ONCE >> 5
    cuts = np.flatnonzero(np.diff(np.cumsum(size * size) // PAIRS_AT_ONCE, prepend=0))
    for leaves in np.split(np.arange(len(size)), cuts):
        each = size[leaves] ** 2
        wide, at = np.repeat(size[leaves], each), np.repeat(first[leaves], each)
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        a, b = at + place // np.maximum(wide, 1), at + place % np.maximum(wide, 1)
        met = (number[a] >= 0) & (roles[b] & 2 > 0)
        if skip_self:
            met &= ids[a] != ids[b]
        a, b = a[met], b[met]
        dist = np.concatenate([np.empty(0)] + [
            distance(x[a[at : at + step]].T.copy().T, x[b[at : at + step]].T.copy().T) for at in range(0, len(a), step)
        ])
        row, j = number[a], ids[b]
        near = (dist < np.inf) & (dist <= bound[row])
        found.append((row[near], j[near], dist[near]))
    row, j, dist = (np.concatenate(parts) for parts in zip(*found))
    bound = tightened(row, dist, k, bound)
    near = dist <= bound[row]
    row, j, dist = row[near], j[near], dist[near]
    order = np.lexsort((j, dist, row))
    return asking, (row[order], j[order], dist[order], bound), small


def within_leaf(near, distance, dims: int, k, skip_self: bool, keep_x: bool):
    """Leaf rows -> one row per query point, with its neighbours inside its own leaf.

    ``distance`` is that of pairs of points as ``near`` takes it.
    """

    def run(batches):
        for batch in batches:
            offsets, ids = flat_lists(batch.column("ids"))
            x = matrix(flat_lists(batch.column("xs"))[1], dims)
            roles = flat_lists(batch.column("roles"))[1]
            reaches = flat_lists(batch.column("reaches"))[1]
            leaves, groups = batch.column("leaf").to_numpy(), batch.column("grp").to_numpy()
            asking, some, small = small_leaves(distance, offsets, ids, x, roles, reaches, k, skip_self)
            asked, found, done = [asking], [some], len(asking)
            home = [np.repeat(np.arange(batch.num_rows), np.diff(offsets))[asking]]
            for r in np.flatnonzero(~small):
                rows = np.arange(offsets[r], offsets[r + 1])
                asking, offered = rows[roles[rows] & 1 > 0], rows[roles[rows] & 2 > 0]
                if not len(asking):
                    continue
                row, j, dist, bound = nearest(
                    near, x[asking], x[offered], ids[asking], ids[offered], k, reaches[asking], skip_self
                )
                asked.append(asking)
                home.append(np.full(len(asking), r))
                found.append((row + done, j, dist, bound))
                done += len(asking)
            if not done:
                continue
            asked, home = np.concatenate(asked), np.concatenate(home)
            row, j, dist, bound = (np.concatenate(parts) for parts in zip(*found))
            columns = [
                pa.array(ids[asked]),
                pa.array(leaves[home]),
                pa.array(groups[home]),
                pa.array(bound),
                neighbour_lists(row, j, dist, done),
            ]
            names = ["i", "leaf", "grp", "bound", "nbrs"]
            if keep_x:
                columns.append(lists(pa.array(x[asked].ravel()), np.full(done, dims)))
                names.append("x")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def across_leaves(near, dims: int, k, skip_self: bool):
    """Rows of (visitors of one leaf, another leaf) -> neighbours found over there."""

    def run(batches):
        for batch in batches:
            starts, guests = batch.column("visitors").offsets.to_numpy(), batch.column("visitors").flatten()
            starts = starts - starts[0]
            who, at, bound = guests.flatten()
            who, bound = who.to_numpy(), bound.to_numpy()
            at = matrix(flat_lists(at)[1], dims)
            offsets, ids = flat_lists(batch.column("ids"))
            x = matrix(flat_lists(batch.column("xs"))[1], dims)
            roles = flat_lists(batch.column("roles"))[1]
            groups = batch.column("grp").to_numpy()
            asked, home, found, done = [], [], [], 0
            for r in range(batch.num_rows):
                v = np.arange(starts[r], starts[r + 1])
                rows = np.arange(offsets[r], offsets[r + 1])
                rows = rows[roles[rows] & 2 > 0]
                row, j, dist, _ = nearest(near, at[v], x[rows], who[v], ids[rows], k, bound[v], skip_self)
                if not len(row):
                    continue
                hit, dense = np.unique(row, return_inverse=True)
                asked.append(v[hit])
                home.append(np.full(len(hit), r))
                found.append((dense + done, j, dist))
                done += len(hit)
            if not done:
                continue
            row, j, dist = (np.concatenate(parts) for parts in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(who[np.concatenate(asked)]),
                    pa.array(groups[np.concatenate(home)]),
                    neighbour_lists(row, j, dist, done),
                ],
                names=["i", "grp", "nbrs"],
            )

    return run


def boxes_apart(kind, lo, hi, other_lo, other_hi):
    """The least distance of each of some boxes to another: the SQL form's terms, in its order."""
    gaps = np.maximum(np.maximum(lo - other_hi, other_lo - hi), 0)
    total = np.zeros(len(gaps))
    for term in (gaps if kind == "l1" else gaps * gaps).T:
        total += term
    if kind == "unit":  # slack for the unit vectors' rounding
        return total / 2 - 1e-9
    return np.sqrt(total) if kind == "l2" else total


class _Tile:
    """The asking leaves of a tile, with the ``k`` nearest found so far for each of their points."""

    def __init__(self, grp, leaves, dims, box):
        self.grp, self.leaves = grp, np.array([leaf for leaf, *_ in leaves])
        self.who, x, self.bound = (np.concatenate(parts) for parts in list(zip(*leaves))[1:])
        sizes = np.array([len(ids) for _, ids, *_ in leaves])
        self.at, self.home, self.heads = matrix(x, dims), np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        self.box, (self.lo, self.hi) = box, edges(self.at, self.heads, box == "unit")
        self.row, self.j, self.dist = np.empty(0, int), np.empty(0, np.int64), np.empty(0)

    def visit(self, near, leaf, ids, x, lo, hi, k, skip_self):
        """Holds another leaf's candidates against the points whose leaf is near enough to it."""
        reached = self.leaves != leaf
        if self.box is not None:
            farthest = np.maximum.reduceat(self.bound, self.heads)
            reached &= ~(boxes_apart(self.box, self.lo, self.hi, lo, hi) > farthest)
        rows = np.flatnonzero(reached[self.home])
        for start in range(0, len(rows), VISITORS):
            some = rows[start : start + VISITORS]
            row, j, dist, _ = nearest(near, self.at[some], x, self.who[some], ids, k, self.bound[some], skip_self)
            if len(row):
                self.add(some[row], j, dist, k)

    def add(self, row, j, dist, k):
        """Lists that got longer are cut to the ``k`` nearest, ties kept; the others stay."""
        fresh = np.zeros(len(self.who), bool)
        fresh[row] = True
        longer = fresh[self.row]
        row, j, dist = (np.concatenate(p) for p in ((self.row[longer], row), (self.j[longer], j), (self.dist[longer], dist)))
        self.bound = tightened(row, dist, k, self.bound)
        keep = dist <= self.bound[row]
        self.row = np.concatenate([self.row[~longer], row[keep]])
        self.j = np.concatenate([self.j[~longer], j[keep]])
        self.dist = np.concatenate([self.dist[~longer], dist[keep]])

    def found(self):
        order = np.lexsort((self.j, self.dist, self.row))
        hit, dense = np.unique(self.row[order], return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.who[hit]),
                pa.array(np.full(len(hit), self.grp)),
                neighbour_lists(dense, self.j[order], self.dist[order], len(hit)),
            ],
            names=["i", "grp", "nbrs"],
        )


def across_tiles(near, box, dims: int, k: int, skip_self: bool):
    """Leaves sorted by tile, those that ask before those that offer -> neighbours found over there.

    A tile's asking leaves are held while the offering ones pass by, one at a time: each leaf comes
    to a task once a tile, not once for each leaf it meets.  What comes next is held against the
    tighter bound.
    """

    def run(batches):
        key, asking, tile = None, [], None
        for batch in batches:
            columns = {c: flat_lists(batch.column(c)) for c in ("ids", "xs", "roles", "bounds", "lo", "hi")}
            part = lambda c, r: columns[c][1][columns[c][0][r] : columns[c][0][r + 1]]
            plain = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "ta", "tb", "asks", "leaf"))
            for r, (grp, ta, tb, asks, leaf) in enumerate(zip(*plain)):
                if key != (grp, ta, tb):
                    if tile is not None:
                        yield tile.found()
                    key, asking, tile = (grp, ta, tb), [], None
                if asks:  # copies: the batch is not to stay
                    asking.append((leaf, *(part(c, r).copy() for c in ("ids", "xs", "bounds"))))
                    continue
                if tile is None and asking:
                    tile, asking = _Tile(grp, asking, dims, box), []
                if tile is not None:
                    offered = part("roles", r) & 2 > 0
                    tile.visit(
                        near, leaf, part("ids", r)[offered], matrix(part("xs", r), dims)[offered],
                        part("lo", r), part("hi", r), k, skip_self,
                    )
        if tile is not None:
            yield tile.found()

    return run


def unscreened(measure):
    """A screen for measures that have none: the distance itself."""

    def screen(a, b, limit):
        def about(part):
            dist = measure.rows(a[part][:, None, :], b[None, :, :])
            dist[np.isnan(dist)] = np.inf
            return dist

        return about, limit, np.zeros(len(a))

    return screen


class _Crowd:
    """The asking points of a tile with their buckets, table by table and in each run by run.

    For each run and step of tables it keeps the ``k`` first by distance, then id, of the points
    met in a bucket of the tables up to that step, and counts the pairs that share one.
    """

    def __init__(self, measure, screen, k, steps, who, x, signs):
        self.measure, self.screen, self.k, self.steps = measure, screen, k, steps
        self.who, self.at, self.flat = who, x, np.ascontiguousarray(x.T)
        self.tables, self.runs = steps[-1], signs.shape[1] // steps[-1]
        self.step_of = np.searchsorted(steps, np.arange(self.tables), side="right")
        self.known, self.codes, self.sizes, self.starts, self.order = [], [], [], [], []
        for column in signs.T:
            known, code, sizes = np.unique(column, return_inverse=True, return_counts=True)
            self.known.append(known)
            # in as few bytes as hold them; one more number stands for buckets of others only
            self.codes.append(code.astype(np.min_scalar_type(len(known))))
            self.sizes.append(np.append(sizes, 0))
            self.starts.append(np.append(np.cumsum(sizes) - sizes, 0))
            self.order.append(np.argsort(code, kind="stable"))
        self.pairs = np.zeros((self.runs, len(steps)), np.int64)
        self.bound = np.full((len(steps), self.runs * len(who)), np.inf)
        self.key, self.j, self.step, self.dist = (np.empty(0, t) for t in (int, np.int64, int, float))

    def columns(self, run):
        return range(run, self.runs * self.tables, self.runs)

    def visit(self, ids, x, signs):
        """Holds other points against those of these that they share a bucket with."""
        codes = []
        for column, known in zip(signs.T, self.known):
            at = np.minimum(np.searchsorted(known, column), len(known) - 1)
            codes.append(np.where(known[at] == column, at, len(known)))
        shared = [sum(self.sizes[c][codes[c]].sum() for c in self.columns(run)) for run in range(self.runs)]
        dense = [run for run, pairs in enumerate(shared) if pairs * DENSE > len(self.who) * len(ids)]
        flat = np.ascontiguousarray(x.T)
        met = [self.listed(run, codes, flat) for run in range(self.runs) if shared[run] and run not in dense]
        if dense:
            met += self.compared(dense, codes, x, flat)
        if met:
            key, col, step, dist = (np.concatenate(parts) for parts in zip(*met))
            self.add(key, ids[col], step, dist)

    def apart(self, row, col, flat):
        """Distances of some pairs, coordinate by coordinate."""
        step = PAIRS_AT_ONCE >> 5
        dist = np.concatenate([np.empty(0)] + [
            self.measure.rows(self.flat[:, row[at : at + step]].T, flat[:, col[at : at + step]].T)
            for at in range(0, len(row), step)
        ])
        dist[np.isnan(dist)] = np.inf
        return dist

    def listed(self, run, codes, flat):
        """Few pairs share a bucket: they are read off the buckets, each pair once."""
        keys, steps, width = [], [], flat.shape[1]
        for t, c in enumerate(self.columns(run)):
            size = self.sizes[c][codes[c]]
            col, first = np.repeat(np.arange(width), size), np.repeat(self.starts[c][codes[c]], size)
            place = np.arange(len(col)) - np.repeat(np.cumsum(size) - size, size)
            keys.append(self.order[c][first + place] * width + col)
            steps.append(np.full(len(col), self.step_of[t]))
        pair, at = np.unique(np.concatenate(keys), return_index=True)  # of equals the first table's
        step = np.concatenate(steps)[at]
        self.pairs[run] += np.cumsum(np.bincount(step, minlength=len(self.steps)))
        row, col = np.divmod(pair, width)
        return row + run * len(self.who), col, step, self.apart(row, col, flat)

    def compared(self, runs, codes, x, flat):
        """Many pairs share a bucket: all are compared, and few are near enough to be looked at."""
        last, n = len(self.steps), len(self.who)
        limits = self.bound.reshape(last, self.runs, n)[:, runs].reshape(-1, n)  # step by step, run by run
        about_of, tops, off = self.screen(self.at, x, limits)
        codes = {c: codes[c].astype(self.codes[c].dtype) for run in runs for c in self.columns(run)}
        met = []
        for part in pieces(n, len(x)):
            about, top = about_of(part), tops[:, part].reshape(last, len(runs), -1).copy()
            levels = [self.levels(run, part, codes) for run in runs]
            hit = np.flatnonzero(about <= top.max(axis=(0, 1))[:, None])

            def passing(hit):
                row, value = hit // len(x), about.ravel()[hit]
                passed = []
                for r, level in enumerate(levels):
                    step = last - level.ravel()[hit].astype(int)  # the first step a pair is of; none is ``last``
                    passed.append((step < last) & (value <= top[np.minimum(step, last - 1), r, row]))
                return passed

            passed = passing(hit)
            some = np.any(passed, axis=0)
            crowded = np.flatnonzero(np.bincount(hit[some] // len(x), minlength=len(about)) > CROWD * self.k * len(runs))
            if len(crowded) and len(x) >= self.k:
                slack = 2 * off[part][crowded]
                for r, level in enumerate(levels):
                    for step in range(last):
                        own = np.where(level[crowded] >= last - step, about[crowded], np.inf)
                        least = np.partition(own, self.k - 1, axis=1)[:, self.k - 1]
                        top[step, r, crowded] = np.minimum(top[step, r, crowded], least + slack)
                hit = hit[some]
                passed = passing(hit)
                some = np.any(passed, axis=0)
            row, col = np.divmod(hit[some], len(x))
            dist = self.apart(row + part.start, col, flat)
            for r, (run, level) in enumerate(zip(runs, levels)):
                at = passed[r][some]
                step = last - level.ravel()[hit[some][at]].astype(int)
                met.append((row[at] + part.start + run * n, col[at], step, dist[at]))
        return met

    def levels(self, run, part, codes):
        """Of how many of the steps of a run each pair is; counts the pairs of each step."""
        shape = (part.stop - part.start, len(codes[run]))
        met, same, level = np.zeros(shape, bool), np.empty(shape, bool), np.zeros(shape, np.uint8)
        for t, c in enumerate(self.columns(run)):
            np.equal(self.codes[c][part, None], codes[c], out=same)
            np.logical_or(met, same, out=met)
            if t + 1 in self.steps:
                level += met.view(np.uint8)
                self.pairs[run, self.steps.index(t + 1)] += np.count_nonzero(met)
        return level

    def add(self, key, j, step, dist):
        """Lists that got longer are cut to the ``k`` first of each step; the others stay."""
        near = (dist < np.inf) & (dist <= self.bound[step, key])
        fresh = np.zeros(self.bound.shape[1], bool)
        fresh[key[near]] = True
        longer = fresh[self.key]
        held = (self.key, self.j, self.step, self.dist)
        key, j, step, dist = (np.concatenate([old[longer], new[near]]) for old, new in zip(held, (key, j, step, dist)))
        order = np.lexsort((j, dist, key))
        key, j, step, dist = key[order], j[order], step[order], dist[order]
        counts = np.bincount(key, minlength=len(fresh))
        heads, keep = (np.cumsum(counts) - counts)[key], np.zeros(len(key), bool)
        for s in range(len(self.steps)):
            before = np.concatenate([[0], np.cumsum(step <= s)])
            place = before[:-1] - before[heads]
            keep |= (step <= s) & (place < self.k)
            full = (step <= s) & (place == self.k - 1)
            self.bound[s, key[full]] = dist[full]
        self.key, self.j, self.step, self.dist = (
            np.concatenate([old[~longer], new[keep]]) for old, new in zip(held, (key, j, step, dist))
        )

    def found(self):
        """A row for each point and run with its neighbours, then one for each run and step with its pairs."""
        order = np.lexsort((self.j, self.dist, self.key))
        hit, dense = np.unique(self.key[order], return_inverse=True)
        near = pa.StructArray.from_arrays(
            [pa.array(self.dist[order]), pa.array(self.j[order]), pa.array(self.step[order].astype(np.int32))],
            fields=list(STEPPED),
        )
        run, row = np.divmod(hit, len(self.who))
        of_run, of_step = (at.ravel() for at in np.indices(self.pairs.shape))
        none = np.zeros(self.pairs.size, np.int64)
        together = lambda a, b: np.concatenate([a, b])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(together(self.who[row], none)),
                pa.array(together(run, of_run).astype(np.int32)),
                pa.array(together(np.full(len(hit), -1), of_step).astype(np.int32)),
                pa.array(together(np.zeros(len(hit), np.int64), self.pairs.ravel())),
                lists(near, together(np.bincount(dense, minlength=len(hit)), none)),
            ],
            names=["i", "run", "step", "pairs", "nbrs"],
        )


def across_tables(measure, many: int, k: int, steps: tuple[int, ...], leaf_rows: int):
    """Points sorted by tile, those that ask before those that offer -> for each that asks the ``k``
    first it meets in buckets of the first tables of each run, up to each of ``steps``, and how many
    pairs meet there.  A pair's distance is taken once at most, however many buckets it shares; with
    more than ``many`` coordinates pairs are screened.
    """

    def run(batches):
        key, asking, crowd = None, [], None
        for batch in batches:
            ids, asks = batch.column("i").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            tiles = np.stack([batch.column(c).to_numpy() for c in ("ta", "tb")], axis=1)
            x, signs = (flat_lists(batch.column(c))[1].reshape(len(ids), -1) for c in ("x", "signs"))
            edge = np.any(tiles[1:] != tiles[:-1], axis=1) | (asks[1:] != asks[:-1])
            cuts = np.concatenate([[0], np.flatnonzero(edge) + 1, [len(ids)]])
            for start, stop in zip(cuts[:-1], cuts[1:]):
                if stop == start:
                    continue
                if key != tuple(tiles[start]):
                    if crowd is not None:
                        yield crowd.found()
                    key, asking, crowd, block = tuple(tiles[start]), [], None, FIRST_BLOCK
                if asks[start]:  # copies: the batch is not to stay
                    asking.append([part[start:stop].copy() for part in (ids, x, signs)])
                    continue
                if crowd is None and asking:
                    screen = measure.screen if x.shape[1] > many and measure.screen is not None else unscreened(measure)
                    crowd, asking = _Crowd(measure, screen, k, steps, *(np.concatenate(p) for p in zip(*asking))), []
                at = start if crowd is not None else stop
                while at < stop:
                    some = slice(at, min(at + block, stop))
                    crowd.visit(ids[some], x[some], signs[some])
                    at, block = some.stop, min(2 * block, leaf_rows)
        if crowd is not None:
            yield crowd.found()

    return run
