"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders.  Windows of template words are joined by
hash; what lines up with an item is measured in covered words, and the values behind the
placeholders must change consistently: a question with other numbers and names is caught,
a text that shares its pattern only is not.  Windows of the plain words are joined as well, as
case and line ends decide what looks like a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farfield.llm.common import packed, stage, text_of, words

WINDOW = 5
SIMILARITY = 0.8
LITERAL = 3  # words in a window that are no placeholders; with fewer, values are compared too
#: Joins are broadcast up to so many rows on the small side (some 50 MB), and shuffled beyond.
BROADCAST_ROWS = 500_000

#: Units of measurement, as they stand after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons oz lb lbs pound pounds "
    "ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years dollar dollars euro euros cent cents usd eur percent degree degrees "
    "w kw v a hz khz mhz ghz b kb mb gb tb mph kmh"
).split()

NUMBER, NAME, UNIT = "#", "@", "~"


def slotted(text: Column) -> Column:
    """The words of a non-null text in lower case without punctuation, slots marked.

    A word that begins as a number is ``#`` and its letters and digits; a capitalised word
    inside a sentence is ``@`` and the word; a unit after a number is ``~`` and the unit.
    """
    gap = r"\x20\x09-\x0D"
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    # every pattern begins with what is rare, so that most places fail at once
    for pattern, by in (
        (f"[{NUMBER}{NAME}{UNIT}{gap}]{{2,}}|[{NUMBER}{NAME}{UNIT}\\x09-\\x0D]", " "),
        (rf"\p{{Lu}}(?<=[^.!?:;…{gap}]\x20\p{{Lu}})", f"{NAME}$0"),
        (rf"[0-9](?<=(?:^|[{gap}])[(\[$€£+-]?[0-9])", f"{NUMBER}$0"),
        (rf"[^\p{{L}}\p{{N}}#@~{gap}]+", ""),
        (rf"(#[\p{{L}}\p{{N}}]+\x20)(?=(?i:{units})(?![^{gap}]))", f"$1{UNIT}"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return words(F.lower(text))


def _is_slot(word: str) -> str:
    return f"(substr({word}, 1, 1) in ('{NUMBER}', '{NAME}', '{UNIT}'))"


def _bare(word: str) -> str:
    """SQL for a word without the mark of its slot."""
    return f"if({_is_slot(word)}, substr({word}, 2), {word})"


def windows(tokens: str) -> tuple[Column, Column]:
    """Hashes of the windows of an array of words, and the number of their places.

    Of the template windows first, by place: slots are hashed by type alone, unless the window
    has too few other words.  In texts with slots the windows of plain words follow, by place
    again, null where they hold no slot and so are the same: copies in other case have other
    slots.  Fewer words than a window make one window; no words make none.
    """
    template = f"transform({tokens}, t -> if({_is_slot('t')}, substr(t, 1, 1), t))"
    bare = f"transform({tokens}, t -> {_bare('t')})"
    several = lambda a, i: ", ".join(f"get({a}, {i} + {k})" for k in range(WINDOW))
    literal = " + ".join(f"int(coalesce(length(get(p, i + {k})) > 1 or not {_is_slot(f'get(p, i + {k})')}, true))" for k in range(WINDOW))
    slot = " or ".join(f"not get(p, i + {k}) <=> get({tokens}, i + {k})" for k in range(WINDOW))
    # only texts with slots pay for looking at them
    plain = f"transform({tokens}, (t, i) -> xxhash64({several(tokens, 'i')}))"
    typed = (
        f"transform(array({template}), p -> transform(p, (t, i) -> if({literal} >= {LITERAL}, "
        f"xxhash64({several('p', 'i')}), xxhash64('=', {several(tokens, 'i')}))))[0]"
    )
    said = f"transform(array({bare}), p -> transform(p, (t, i) -> if({slot}, xxhash64({several('p', 'i')}), null)))[0]"
    places = f"if(size({tokens}) = 0, 0, greatest(size({tokens}) - {WINDOW - 1}, 1))"
    some = (
        f"if(exists({tokens}, t -> {_is_slot('t')}), "
        f"concat(slice({typed}, 1, {places}), slice({said}, 1, {places})), slice({plain}, 1, {places}))"
    )
    return F.expr(some), F.expr(places)


def _keys() -> list[Column]:
    """What tells rows apart: the id, null or not, and the text."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("id_key"), F.xxhash64(text_of()).alias("text_key")]


def _small(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if it is within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``id_key, text_key, doc_id, item_id, similarity, n_slots, n_changed``.

    One row per document and benchmark item that it contains: windows that line up cover at
    least ``SIMILARITY`` of the item's words, and of the item's values at least that share
    turn into one value each.  ``n_changed`` of ``n_slots`` values differ from the item's.
    Null and empty texts, and items without words, match nothing; items shorter than a
    window match texts that consist of them.  Repeated rows and items count once each.
    """
    each = stage(
        benchmark.select("item_id", slotted(text_of()).alias("itok")).filter(F.size("itok") > 0).distinct(), "items"
    )
    hashes, places = windows("itok")
    item_windows = stage(
        each.select("item_id", F.size("itok").alias("n"), hashes.alias("hs"), places.alias("places"))
        .select("item_id", "n", "places", F.posexplode_outer("hs").alias("j", "h"))
        .select("item_id", "n", F.expr("j % places").alias("j"), "h").filter(F.col("h").isNotNull()).distinct(),
        "item-windows",
    )
    hashes, places = windows("tok")
    doc_windows = (
        docs.select(*_keys(), "doc_id", slotted(text_of()).alias("tok"))
        .select("id_key", "text_key", "doc_id", hashes.alias("hs"), places.alias("places"))
        # outer: else a filter on the array is inferred, and its parts are computed per word
        .select("id_key", "text_key", "doc_id", "places", F.posexplode_outer("hs").alias("i", "h"))
        .select("id_key", "text_key", "doc_id", F.expr("if(places = 0, null, i % places)").alias("i"), "h")
    )
    met = stage(doc_windows.join(_small(item_windows), "h").drop("h"), "window-matches")
    # a text may hold an item twice, and edits shift places: places are binned twice, so that
    # one occurrence is whole in a bin of either kind
    shift = F.col("i") - F.col("j")
    bins = F.array(
        F.struct(F.lit(0).alias("kind"), F.floor(shift / F.col("n")).alias("bin")),
        F.struct(F.lit(1).alias("kind"), F.floor((shift + F.col("n") / 2) / F.col("n")).alias("bin")),
    )
    where = ["id_key", "text_key", "doc_id", "item_id", "n", "kind", "bin"]
    binned = met.select("*", F.explode(bins).alias("b")).select("*", "b.*").drop("b")
    covered = stage(_covering(binned, where).filter(F.col("similarity") >= SIMILARITY), "covered")
    return _consistent(docs, each, binned, covered, where)


def _covering(met: DataFrame, where: list[str]) -> DataFrame:
    """The share of the item's words that windows cover, by ``where``."""
    places = met.groupBy(*where).agg(F.sort_array(F.collect_set("j")).alias("js"))
    steps = F.expr(
        f"aggregate(transform(js, (j, k) -> least({WINDOW}, coalesce(get(js, k + 1) - j, {WINDOW}))), 0, (a, x) -> a + x)"
    )
    return places.select(*where, (F.least(steps, F.col("n")) / F.col("n")).alias("similarity"))


def _aligned(met: DataFrame, where: list[str]) -> DataFrame:
    """``met`` with at most one ``i`` per ``j`` and one ``j`` per ``i``: those whose shift is
    closest to the most frequent one."""
    shift = F.col("i") - F.col("j")
    often = F.count("*").over(Window.partitionBy(*where, "shift"))
    usual = F.max(F.struct("often", (-F.col("shift")).alias("back"))).over(Window.partitionBy(*where))
    off = F.abs(F.col("shift") + F.col("usual.back"))
    best = lambda k, other: F.row_number().over(Window.partitionBy(*where, k).orderBy("off", other))
    near = met.withColumn("shift", shift).withColumn("often", often).withColumn("usual", usual).withColumn("off", off)
    one = near.withColumn("k", best("j", "i")).filter("k = 1").withColumn("k", best("i", "j")).filter("k = 1")
    return one.select(*met.columns)


def _consistent(docs: DataFrame, items: DataFrame, binned: DataFrame, covered: DataFrame, where: list[str]) -> DataFrame:
    """``covered`` without occurrences whose values do not change as one value each.

    An item that repeats a pattern also matches at other shifts.  Values are compared along one
    alignment, and only what that covers counts.
    """
    has_slots = items.filter(F.expr(f"exists(itok, t -> {_is_slot('t')})")).select("item_id", "itok")
    met = binned.join(covered.drop("similarity", "doc_id", "n"), ["id_key", "text_key", "item_id", "kind", "bin"], "left_semi")
    lined_up = stage(_aligned(met.distinct(), where).join(has_slots, "item_id"), "lined-up")
    texts = stage(lined_up.select("id_key", "text_key").distinct(), "slotted-texts")
    tokens = docs.select(*_keys(), text_of().alias("text")).join(_small(texts), ["id_key", "text_key"])
    tokens = tokens.dropDuplicates(["id_key", "text_key"]).select("id_key", "text_key", slotted(F.col("text")).alias("tok"))
    beside = F.expr(
        f"transform(sequence(0, {WINDOW - 1}), k -> struct(get(itok, j + k) as was, get(tok, i + k) as now))"
    )
    values = (
        lined_up.join(tokens, ["id_key", "text_key"]).select(*where, F.explode(beside).alias("s")).select(*where, "s.*")
        .filter(F.col("was").isNotNull() & F.expr(_is_slot("was")))
        # a copy in other case has other marks
        .withColumn("was", F.expr(_bare("was"))).withColumn("now", F.expr(_bare("now")))
        .groupBy(*where, "was").agg(F.count_distinct("now").alias("kinds"), F.min("now").alias("now"))
        .groupBy(*where).agg(
            F.count("*").alias("n_slots"), F.sum((F.col("kinds") == 1).cast("int")).alias("steady"),
            F.sum((F.col("now") != F.col("was")).cast("long")).alias("n_changed"),
        )
    )
    keys = ["id_key", "text_key", "item_id", "kind", "bin"]
    rated = covered.join(values.select(*keys, "n_slots", "steady", "n_changed"), keys, "left").join(
        _covering(lined_up, where).select(*keys, F.col("similarity").alias("aligned")), keys, "left"
    ).withColumn("similarity", F.coalesce("aligned", "similarity"))
    steady = (F.col("similarity") >= SIMILARITY) & (
        F.col("n_slots").isNull() | (F.col("steady") >= SIMILARITY * F.col("n_slots"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return (
        rated.filter(steady).select("id_key", "text_key", "doc_id", "item_id", "similarity", zero("n_slots"), zero("n_changed"))
        .groupBy("id_key", "text_key", "item_id")
        .agg(F.max(F.struct("similarity", -F.col("n_changed"), "n_slots", "n_changed", "doc_id")).alias("best"))
        .select("id_key", "text_key", "best.doc_id", "item_id", "best.similarity", "best.n_slots", "best.n_changed")
    )


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item."""
    bad = stage(leaks(docs, benchmark).select("id_key", "text_key").distinct(), "leaks")
    return packed(docs, *_keys()).join(_small(bad), ["id_key", "text_key"], "left_anti").select("row.*")
