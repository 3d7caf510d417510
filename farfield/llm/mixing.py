"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source's documents stand in a seeded order and form one stream of words, cut into
blocks of equal size.  The seats of all shards, one block each, go to the sources by highest
quotients ``target / (2 k - 1)``.  A source with more seats than blocks gives its whole
stream as often as it goes in; the rest is a run of blocks that starts at a seeded block and
goes round.  As the documents stand in a random order, that run is a random choice of
documents, and cuts two of them at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farfield.llm.common import packed, stage, text_of, words

BLOCK = 16  # words
SHARDS = 16
SEED = 7
WEIGHTS = (1, 2, 3)  # by source in code point order, repeating
MOST = 3  # times that a source may be repeated


def _seeded(seed: int, what: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), what))


def sized(docs: DataFrame, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``row, s, size, key, part``: source as a non-null key, words, and the seeded place in the source.

    ``s`` sorts as sources do, a null source last.  Rows of equal ``doc_id`` stand
    together; a null ``doc_id`` counts as an id of its own.
    """
    source = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    key = _seeded(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return packed(
        docs, source.alias("s"), F.size(words(text_of())).cast("long").alias("size"), key.alias("key"), keep=keep
    ).withColumn("part", F.substr("key", F.lit(1), F.lit(4)))


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``rank, weight, target`` to ``s, source_size`` (one row per source).

    Shares follow the weights and add up to all words; a share of more than ``MOST`` times
    its source stops there, and what is over goes to the others by weight.  Sources that
    reach their limit come first when ordered by limit per weight, so one pass over running
    sums finds the level.  Sources without words get 0.
    """
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy("s")) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS)) + 1).cast("double")
    limit = (F.col("source_size") * MOST).cast("double")
    order = W.orderBy("ratio", "rank")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        ranked.withColumns({"weight": weight, "cap": limit}).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        .withColumn("full", F.col("ratio") <= F.col("level"))
        .withColumn("share", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("share"))
    return level.select("s", "rank", "weight", "source_size", target.alias("target"))


def quotas(aimed: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """``s, shard, seats``: blocks of each source in each shard, shards equal but for one block.

    Seats go to the highest quotients; equal quotients go to the earlier source.  A method of
    divisors gives each further seat without moving earlier ones, so the seats of shard j are
    those after j + 1 shards less those after j.  For h seats and n sources every
    source's number lies between its rounded share of h - n and of h + n seats; only the
    seats between, 2 n or so, are ranked.
    """
    seen = aimed.filter("target > 0")
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    wide = seen.withColumns({"sum": F.sum("target").over(everything), "n": F.count("*").over(everything)})
    seats = F.round(F.col("sum") / block)
    houses = wide.select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("upto")).withColumn(
        "h", F.round(seats * F.col("upto") / shards)
    )
    at = lambda h: F.floor(F.col("target") * h / F.col("sum") + 0.5)
    bounds = houses.withColumns({
        "low": F.greatest(F.lit(0), at(F.greatest(F.lit(0.0), F.col("h") - F.col("n")))),
        "high": at(F.col("h") + F.col("n")),
    })
    house = W.partitionBy("upto")
    free = bounds.withColumn("free", F.col("h") - F.sum("low").over(house))
    contested = free.select(
        "s", "upto", "rank", "low", "free", "target",
        F.explode_outer(
            F.when(F.col("high") > F.col("low"), F.sequence(F.col("low") + 1, F.col("high")))
        ).alias("k"),
    ).withColumn("quotient", F.col("target") / (2 * F.col("k") - 1))
    placed = contested.withColumn(
        "place", F.row_number().over(house.orderBy(F.desc_nulls_last("quotient"), "rank", "k"))
    )
    won = F.sum(F.when(F.col("k").isNotNull() & (F.col("place") <= F.col("free")), 1).otherwise(0))
    total = placed.groupBy("s", "upto").agg((F.max("low") + won).alias("seats"))
    earlier = F.lag("seats", 1, 0).over(W.partitionBy("s").orderBy("upto"))
    return total.select("s", (F.col("upto") - 1).alias("shard"), (F.col("seats") - earlier).cast("long").alias("seats"))


def mixed(
    docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, keep: list[str] | None = None
) -> DataFrame:
    """Every row of ``docs`` with what the mix takes of it.

    ``row, s, size, source_size, target, rounds`` (times the whole document is taken)
    and ``from_1, to_1, from_2, to_2``: up to two more ranges of its words (from 0, end
    exclusive; empty ranges are null).  ``taken`` is the sum.  An empty table gives an empty
    one; documents without words are taken 0 times.  Running sums go over (source, part of
    the seeded order), so a source with a third of all rows spreads over many tasks.
    """
    rows = sized(docs, seed, keep)
    parts = stage(rows.groupBy("s", "part").agg(F.sum("size").alias("n")), "mix-parts")
    begun = parts.select(
        "s", "part",
        (F.sum("n").over(W.partitionBy("s").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
        .alias("begin"),
    )
    aimed = stage(targets(parts.groupBy("s").agg(F.sum("n").alias("source_size"))), "mix-targets")
    won = quotas(aimed, block, shards).groupBy("s").agg(F.sum("seats").alias("seats"))
    blocks = F.ceil(F.col("source_size") / block)
    taken = F.least(F.coalesce("seats", F.lit(0)), blocks * MOST)
    draw = F.conv(F.substr(_seeded(seed, F.col("s")), F.lit(1), F.lit(12)), 16, 10).cast("long")
    plan = (
        aimed.join(won, "s", "left").withColumns({"blocks": blocks, "seats": taken}).select(
            "s", "source_size", "target",
            F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks"))).otherwise(0).alias("rounds"),
            F.when(F.col("blocks") > 0, F.pmod(F.col("seats"), "blocks")).otherwise(0).alias("run"),
            F.when(F.col("blocks") > 0, F.pmod(draw, "blocks")).otherwise(0).alias("first"), "blocks",
        )
    )
    plan = stage(plan.select(
        "s", "source_size", "target", "rounds",
        (F.col("first") * block).alias("a1"),
        F.least((F.least(F.col("first") + F.col("run"), "blocks")) * block, "source_size").alias("e1"),
        F.greatest(F.lit(0), (F.col("first") + F.col("run") - F.col("blocks")) * block).alias("e2"),
    ), "mix-plan")
    inside = W.partitionBy("s", "part").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        rows.withColumn("end", F.sum("size").over(inside))
        .join(begun.join(plan, "s"), ["s", "part"])
        .withColumn("at", F.col("begin") + F.col("end") - F.col("size"))
    )
    low = lambda a: F.greatest(F.lit(0), a - F.col("at"))
    high = lambda e: F.least("size", e - F.col("at"))
    some = lambda x, a, e: F.when(high(e) > low(a), x)
    a1, a2, e1, e2 = F.col("a1"), F.lit(0), F.col("e1"), F.col("e2")
    ranged = placed.select(
        "row", "s", "size", "source_size", "target", F.col("rounds").cast("long").alias("rounds"),
        some(low(a1), a1, e1).alias("from_1"), some(high(e1), a1, e1).alias("to_1"),
        some(low(a2), a2, e2).alias("from_2"), some(high(e2), a2, e2).alias("to_2"),
    )
    extra = lambda k: F.coalesce(F.col(f"to_{k}") - F.col(f"from_{k}"), F.lit(0))
    return ranged.withColumn("taken", F.col("size") * F.col("rounds") + extra(1) + extra(2))


def applied(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken.

    A document that the run cuts is its taken words, joined by blanks; ``n_chars``, where
    it is a column, is counted anew for it.
    """
    some = mixed(docs, **options)
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("e")), F.col("rounds").cast("int"))
    piece = lambda k: F.when(
        F.col(f"from_{k}").isNotNull(),
        F.array(F.struct(F.col(f"from_{k}").cast("long").alias("a"), F.col(f"to_{k}").cast("long").alias("e"))),
    ).otherwise(F.array().cast("array<struct<a:bigint,e:bigint>>"))
    takes = some.select("row", "size", F.explode(F.concat(whole, piece(1), piece(2))).alias("t")).filter("size > 0")
    cut = (F.col("t.a") > 0) | (F.col("t.e") < F.col("size"))
    some_words = F.slice(words(text_of(F.col("row.text"))), F.col("t.a").cast("int") + 1, (F.col("t.e") - F.col("t.a")).cast("int"))
    text = F.when(cut, F.array_join(some_words, " ")).otherwise(F.col("row.text"))
    out = takes.select("row", text.alias("text_"), cut.alias("cut_"))
    kinds = dict(docs.dtypes)
    columns = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == "text":
            value = F.col("text_")
        elif c == "n_chars":
            value = F.when(F.col("cut_"), F.length("text_").cast(kinds[c])).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)
