"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within two bits of each other agree on at least one of three pieces.  For each
piece the fingerprints are turned so that it leads, sorted by Gray rank and cut into leaves.
A node knows the bits all its fingerprints share; parents take theirs from their children.
Pairs of nodes are followed from the root down, and dropped as soon as their shared bits
differ in the leading piece or in more than two places.  Only pairs of leaves that are left
compare fingerprints, and each reports a forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.llm.common import packed, stage, text_of

SEED = 42
SHINGLE = 3
BITS = 2  # most differing bits of a link
PIECES = ((0, 22), (22, 21), (43, 21))  # how far to turn left, bits that then lead
LEAF = 256
FAN = 4  # bits: a node has up to 16 children
WHOLE = -1  # all bits


def _fingerprints(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    def fingerprint(text: str) -> int:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
        if not words:
            return 0
        line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        first = [0, *ends[:-1].tolist()]
        last = (ends[min(SHINGLE, len(words)) - 1:] - 1).tolist()
        counts, total = np.zeros(64, dtype=np.int64), len(last)
        for at in range(0, total, 1 << 15):
            part = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(first[at:at + (1 << 15)], last[at:at + (1 << 15)])]
            bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * counts > total].sum(dtype=np.uint64))

    for batch in batches:
        values = np.array([fingerprint(t) for t in batch["text"].to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch["row"], batch["at"], pa.array(values.view(np.int64))], names=["row", "at", "fp"]
        )


def fingerprinted(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row, at, fp``: the 64-bit fingerprint as a signed long, ``at`` a number of the row.

    Null and empty texts, and texts of white space, get 0.
    """
    rows = packed(docs, F.monotonically_increasing_id().alias("at"), text_of().alias("text"), keep=keep)
    return rows.mapInArrow(_fingerprints, rows.drop("text").schema.add("fp", "long"))


def turned(column: str, by: int) -> str:
    """SQL for the 64 bits of ``column`` turned left."""
    return column if by % 64 == 0 else f"(shiftleft({column}, {by % 64}) | shiftrightunsigned({column}, {64 - by % 64}))"


def gray_rank(column: str) -> Column:
    """The place of a code word in Gray order; as signed longs sort, from the smallest."""
    rank = F.col(column)
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _cut(batches: Iterator) -> Iterator:
    """Sorted ``r, v`` into leaves of up to ``LEAF`` rows of one ``r``."""
    import numpy as np
    import pyarrow as pa

    out = pa.schema([("r", pa.int32()), ("place", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("members", pa.list_(pa.int64()))])
    place, held_r, held = 0, None, []

    def leaf(r: int, values: np.ndarray) -> dict:
        nonlocal place
        place += 1
        return {"r": r, "place": place - 1, "low": int(np.bitwise_and.reduce(values)), "high": int(np.bitwise_or.reduce(values)), "members": values}

    for batch in batches:
        found, rs, vs = [], batch["r"].to_numpy(), batch["v"].to_numpy()
        edges = np.flatnonzero(np.diff(rs)) + 1
        for r, values in zip(rs[np.r_[0, edges]].tolist() if len(rs) else [], np.split(vs, edges)):
            if held_r != r and len(held):
                found.append(leaf(held_r, held))
                held = []
            values, held_r = np.concatenate([held, values]).astype(np.int64) if len(held) else values, r
            whole = len(values) - len(values) % LEAF
            found += [leaf(r, values[k:k + LEAF]) for k in range(0, whole, LEAF)]
            held = values[whole:]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=out)
    if len(held):
        yield pa.RecordBatch.from_pylist([leaf(held_r, held)], schema=out)


def index(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves ``r, id, low, high, members`` over distinct ``fp``, and the levels above them.

    ``low`` and ``high`` are the conjunction and the disjunction of the members: a bit is
    shared where they agree.  Each level has ``r, id, parent, low, high``; the first is the
    leaves', the last has one node per piece.
    """
    turns = F.array(*(
        F.struct(F.lit(r).alias("r"), F.expr(turned("fp", by)).alias("v")) for r, (by, _) in enumerate(PIECES)
    ))
    each = nodes.select(F.explode(turns).alias("t")).select("t.r", "t.v").withColumn("rank", gray_rank("v"))
    cut = (
        each.repartitionByRange("r", "rank").sortWithinPartitions("r", "rank").select("r", "v")
        .mapInArrow(_cut, "r int, place long, low long, high long, members array<bigint>")
        .withColumn("task", F.spark_partition_id().cast("long"))
    )
    cut = stage(cut, "gray-leaves")
    most = cut.agg(F.max("place").alias("place"), F.max("task").alias("task")).first()
    width = max(1, int(most["place"] or 0).bit_length())
    depth = -(-(width + max(1, int(most["task"] or 0).bit_length())) // FAN)
    leaves = cut.withColumn("id", F.shiftleft("task", width).bitwiseOR(F.col("place")))
    level = leaves.select("r", "id", "low", "high")
    levels = []
    for _ in range(depth + 1):
        level = level.withColumn("parent", F.shiftright("id", FAN))
        levels.append(level)
        level = level.groupBy("r", F.col("parent").alias("id")).agg(
            F.bit_and("low").alias("low"), F.bit_or("high").alias("high")
        )
    return leaves, levels


def close_nodes(levels: list[DataFrame]) -> DataFrame:
    """Pairs ``r, x, y`` (x <= y) of leaves whose shared bits allow a link in piece r."""
    lead = F.element_at(F.array(*(F.lit(-(1 << (64 - n))) for _, n in PIECES)), F.col("r") + 1)
    side = lambda level, k: level.select(
        "r", F.col("id").alias(k), F.col("parent").alias(f"{k}_up"), F.col("low").alias(f"{k}_low"),
        F.col("high").alias(f"{k}_high"),
    )
    pairs = levels[-1].select("r", F.col("id").alias("x_up"), F.col("id").alias("y_up"))
    for level in reversed(levels[:-1]):
        wide = pairs.join(side(level, "x"), ["r", "x_up"]).join(side(level, "y"), ["r", "y_up"])
        varied = (F.col("x_low").bitwiseXOR(F.col("x_high"))).bitwiseOR(F.col("y_low").bitwiseXOR(F.col("y_high")))
        differ = F.col("x_low").bitwiseXOR(F.col("y_low")).bitwiseAND(F.bitwise_not(varied))
        pairs = wide.filter(
            (F.col("x") <= F.col("y")) & (differ.bitwiseAND(lead) == 0) & (F.bit_count(differ) <= BITS)
        ).select("r", F.col("x").alias("x_up"), F.col("y").alias("y_up"))
    return pairs.select("r", F.col("x_up").alias("x"), F.col("y_up").alias("y"))


def _links(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    turns = [by for by, _ in PIECES]
    for batch in batches:
        found_u, found_v = [], []
        for r, x, y, a, b in zip(*(batch[c].to_pylist() for c in ("r", "x", "y", "a", "b"))):
            nodes = np.array(a if x == y else a + b, dtype=np.int64).view(np.uint64)
            near = np.bitwise_count(nodes[:, None] ^ nodes[None, :]) <= BITS
            label, n = np.arange(len(nodes)), len(nodes)
            while True:
                lower = np.where(near, label[None, :], n).min(axis=1)
                if (lower == label).all():
                    break
                label = lower
            tied = np.flatnonzero(label != np.arange(n))
            if len(tied):
                by = np.uint64(turns[r])
                back = (nodes >> by) | (nodes << (np.uint64(64) - by)) if turns[r] else nodes
                found_u.append(back[tied])
                found_v.append(back[label[tied]])
        ends = [np.concatenate(f).view(np.int64) if f else np.zeros(0, np.int64) for f in (found_u, found_v)]
        yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["u", "v"])


def links(nodes: DataFrame) -> DataFrame:
    """``u, v``: links between distinct ``fp`` that join what is joined at ``BITS`` or fewer."""
    leaves, levels = index(nodes)
    pairs = close_nodes(levels)
    members = lambda k, m: leaves.select("r", F.col("id").alias(k), F.col("members").alias(m))
    met = pairs.join(members("x", "a"), ["r", "x"]).join(members("y", "b"), ["r", "y"])
    return met.select("r", "x", "y", "a", "b").mapInArrow(_links, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``u, root`` for every end of ``edges`` (u, v): the smallest id that can be reached.

    Alternating stars: each step hangs all neighbours of a node on the smallest of them, so
    the number of edges never grows and depth shrinks quickly.  Steps end when none changes
    an edge; each is written, so a lost executor costs one step.
    """
    edges = stage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "star"
    )
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.*").filter("u <> v")
        edges = stage(small.distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select("u", F.col("v").alias("root"))
        seen = now


def _known(rows: DataFrame) -> DataFrame:
    """``fp, component`` of all fingerprints of staged ``rows``, staged."""
    nodes = stage(rows.select("fp").distinct(), "fingerprint-nodes")
    roots = components(links(nodes)).withColumnRenamed("u", "fp")
    return stage(
        nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component")), "fingerprint-roots"
    )


def clustered(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row, at, fp, component``: rows that links join have the same ``component`` (a fingerprint).

    Rows of equal fingerprints are one node, so a group of copies of any size costs what one
    text costs.  An empty table gives an empty one.
    """
    rows = stage(fingerprinted(docs, keep), "fingerprints")
    return rows.join(_known(rows), "fp").select("row", "at", "fp", "component")


def with_component_ids(docs: DataFrame) -> DataFrame:
    """``row, fp, component_id``: the smallest ``doc_id`` of a row's component (null if it has none)."""
    rows = stage(clustered(docs, keep=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "fp", "component"
    ), "clustered")
    ids = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "component").select("doc_id", "fp", "component_id")


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: one row of every component.

    It is that of the smallest ``doc_id`` (nulls last), of rows that share it the one whose text
    hashes lowest, then the first.  Whole rows are written once; what is matched and grouped are
    short rows.  Rows are then told by the places of those that go, which are fewer than those that
    stay, so whole rows travel only where even that list is too long to send to every task.
    """
    rows = stage(fingerprinted(docs), "fingerprints")
    place = F.struct(
        F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"),
        F.xxhash64(F.col("row.text")).alias("text"), F.col("at"),
    )
    # the first of each fingerprint, then of each component: a group of copies shrinks before it travels
    first = rows.groupBy("fp").agg(F.min(place).alias("p"))
    chosen = first.join(_known(rows), "fp").groupBy("component").agg(F.min("p").alias("p"))
    gone = rows.select("at").join(chosen.select(F.col("p.at").alias("at")), "at", "left_anti")
    return rows.join(stage(gone, "gone"), "at", "left_anti").select("row.*")
