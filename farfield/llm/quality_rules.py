"""Weak supervision: rules vote on a document or abstain, and expectation-maximisation weighs them.

Every document is measured once, in array expressions.  Rules turn the measures into votes
(1 good, -1 bad, 0 abstain).  Documents with equal votes are alike to the model, so the
expectation and maximisation steps are aggregates over counted vote patterns, of which there
are at most 3 to the power of the number of rules, however many documents there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.llm.common import packed, stage, text_of, words

#: Characters that mark tables and markup rather than prose.
SYMBOLS = "#*$%&|<>"

#: A word of prose: letters, digits and joining signs, with common punctuation around them.
#: Without repeated groups, which would take stack by the length of a word.
PLAIN = r"^[(\[\x22'«“¿¡]?[\p{L}\p{N}][\p{L}\p{N}\-'’.,:/@_]*[.,;:!?)\]\x22'»”…]{0,2}$(?<!!!)"

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated windows
ACCURACY = (0.95, 0.4)  # of a rule on good and on bad documents, before any document is seen
BOUNDS = ((0.9, 0.995), (0.1, 0.995))  # a rule finds one kind of fault: of the bad, it may miss most
WEIGHT = 0.02  # how many documents that belief counts as, as a share of all
ROUNDS, CLOSE = 40, 1e-4


def repeated(parts: str = "h", n: str = "n") -> Column:
    """How many words lie in 3-word windows that occur at least twice.

    ``parts`` holds a hash for each window in order, ``n`` the number of words.  Hashes are
    sorted as plain longs with the place in the low bits; places next to each other with
    equal whole hashes are repeats.  Should two different hashes share their upper bits, the
    text is done again with whole hashes as the sort key, so the count is exact either way.
    """
    places = "floor(log2(greatest(n, 2)))" + " + 1"
    fast = f"sort_array(transform({parts}, (x, i) -> shiftleft(x, b) | i))"
    at = lambda k: f"{parts}[cast(({k}) & (shiftleft(1L, b) - 1) as int)]"
    top = lambda k: f"shiftrightunsigned({k}, b)"
    exact = f"transform(sort_array(transform({parts}, (x, i) -> struct(x, i))), s -> s.i)"
    mixed = f"exists(sequence(1, size(k) - 1), j -> {top('k[j]')} = {top('k[j - 1]')} and {at('k[j]')} <> {at('k[j - 1]')})"
    order = f"if(size(k) > 1 and {mixed}, {exact}, transform(k, x -> cast(x & (shiftleft(1L, b) - 1) as int)))"
    same = lambda i, j: f"coalesce({parts}[get(o, {i})] = {parts}[get(o, {j})], false)"
    hits = f"sort_array(filter(o, (p, j) -> {same('j', 'j - 1')} or {same('j', 'j + 1')}))"
    covered = "aggregate(transform(r, (p, j) -> least(3, coalesce(get(r, j + 1) - p, 3))), 0L, (a, x) -> a + x)"

    def within(name: str, value: str, then: str) -> str:
        """``then`` with ``name`` bound to ``value``, evaluated once."""
        return f"transform(array({value}), {name} -> {then})[0]"

    text = within("b", f"cast({places} as int)", within("k", fast, within("o", order, within("r", hits, covered))))
    return F.expr(text.replace("greatest(n,", f"greatest({n},"))


def measures(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or those of ``keep``) and the measures of its ``text``.

    Null texts are empty; an empty text has no words, lines or symbols.  ``lines`` counts
    lines with a word, ``n_dup_lines`` those equal to an earlier one, ``n_same_next`` words
    equal to the word before, ``n_plain`` words that look like prose.
    """
    text, line_ends = text_of(), r"[.!?:;…\x22')\]»”][\x20\x09-\x0D]*$"
    split = packed(docs, text.alias("text"), words(text).alias("w"), keep=keep)
    hashed = split.select(
        "row", "text", "w", F.size("w").alias("n"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.expr(
            "slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, greatest(size(w) - 2, 0))"
        ).alias("h"),
    )
    size = lambda c: F.size(c).cast("long")
    # what is left when runs of everything else are taken out: few, long matches
    left = lambda others: F.length(F.regexp_replace("text", f"[{others}]+", "")).cast("long")
    word_chars = F.length(F.array_join("w", "")).cast("long")
    return hashed.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        word_chars.alias("word_chars"),
        left(f"^{SYMBOLS}").alias("n_symbols"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0).cast("long"))
        .otherwise(repeated()).alias("n_repeat_words"),
        size("lines").alias("n_lines"),
        size(F.filter("lines", lambda x: x.rlike(line_ends))).alias("n_ended_lines"),
        F.expr("size(filter(w, (x, i) -> x = get(w, i - 1)))").cast("long").alias("n_same_next"),
        left("^!").alias("n_shouts"),
        (word_chars - left(r"\p{L}\x20\x09-\x0D")).alias("n_letters"),
        size(F.filter("w", lambda x: x.rlike(PLAIN))).alias("n_plain"),
    )


def _band(value: Column, good: tuple[float, float], bad: tuple[float, float]) -> Column:
    """1 inside ``good``, -1 outside ``bad``, 0 in between."""
    return F.when(value.between(*good), 1).when(value.between(*bad), 0).otherwise(-1)


def _high(value: Column, good: float, bad: float) -> Column:
    """1 from ``good`` up, -1 below ``bad``, 0 in between."""
    return F.when(value >= good, 1).when(value >= bad, 0).otherwise(-1)


def rules() -> dict[str, Column]:
    """Votes on the columns of ``measures``; a document without words gets only abstentions but for its length."""
    n = F.col("n_words")
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), n), F.lit(0.0))
    low = lambda c, good, bad: F.when(n == 0, 0).otherwise(_band(share(c), (0, good), (0, bad)))
    of_lines = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_lines")), F.lit(0.0))
    return {
        "length": F.when(n >= MIN_WORDS, F.when(n >= 100, 1).otherwise(0)).otherwise(-1),
        "word_length": F.when(n == 0, 0).otherwise(_band(share("word_chars"), (3.0, 8.0), (2.0, 12.0))),
        "symbols": low("n_symbols", 0.05, 0.3),
        "shouts": low("n_shouts", 0.1, 0.5),
        "letters": F.when(n == 0, 0).otherwise(_high(F.try_divide(F.col("n_letters").cast("double"), F.col("word_chars")), 0.9, 0.8)),
        "plain": F.when(n == 0, 0).otherwise(_high(share("n_plain"), 0.9, 0.7)),
        "lines": F.when(n == 0, 0).otherwise(_band(of_lines("n_dup_lines"), (0, 0.2), (0, 0.5))),
        "repeats": F.when(n < 10, 0).otherwise(_band(share("n_repeat_words"), (0, 0.2), (0, 0.5))),
        "runs": low("n_same_next", 0.05, 0.3),
        "ends": F.when(F.col("n_lines") == 0, 0).when(of_lines("n_ended_lines") >= 0.5, 1).otherwise(0),
    }


def fit(patterns: DataFrame, names: list[str]) -> dict:
    """Expectation-maximisation over ``patterns`` (one column a rule, and ``n`` documents).

    A rule that does not abstain is right with one probability on good documents and with
    another on bad ones.  They start, and are held back by a prior, at ``ACCURACY``, so
    that "good" keeps its meaning.  Returns ``prior`` and, by rule, the two accuracies.
    An empty table returns the start.
    """
    model = {"prior": 0.8, "rules": {r: ACCURACY for r in names}}
    total = patterns.agg(F.sum("n")).first()[0] or 0
    if not total:
        return model
    held = max(1.0, WEIGHT * total)
    for _ in range(ROUNDS):
        p = posterior(model)
        sums = [F.sum(F.col("n") * p).alias("good")]
        for r in names:
            for vote, tag in ((1, "up"), (-1, "down")):
                mine = F.when(F.col(r) == vote, F.col("n")).otherwise(0)
                sums += [F.sum(mine * p).alias(f"{tag}_good_{r}"), F.sum(mine * (1 - p)).alias(f"{tag}_bad_{r}")]
        s = patterns.agg(*sums).first()
        part = lambda k, a, b: min(BOUNDS[k][1], max(BOUNDS[k][0], (a + ACCURACY[k] * held) / (a + b + held)))
        new = {
            "prior": min(0.99, max(0.01, s["good"] / total)),
            "rules": {
                r: (part(0, s[f"up_good_{r}"], s[f"down_good_{r}"]), part(1, s[f"down_bad_{r}"], s[f"up_bad_{r}"]))
                for r in names
            },
        }
        moved = max(
            [abs(new["prior"] - model["prior"])]
            + [abs(a - b) for r in names for a, b in zip(new["rules"][r], model["rules"][r])]
        )
        model = new
        if moved < CLOSE:
            break
    return model


def posterior(model: dict) -> Column:
    """The probability of "good", given the votes in the columns named after the rules."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, (good, bad) in model["rules"].items():
        up, down = math.log(good / (1 - bad)), math.log((1 - good) / bad)
        odds = odds + F.when(F.col(r) == 1, up).when(F.col(r) == -1, down).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def scored(docs: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """``row``, measures, ``base_failed``, the ``probability`` of quality and ``kept``; and the model.

    ``docs`` needs ``text``.  ``base_failed``: under 50 words, or over half the words in
    repeated windows.  Every row is kept or not on its own: repeated rows get equal verdicts.
    """
    votes = rules()
    measured = stage(measures(docs, keep).select("*", *(c.cast("byte").alias(f"{k}_vote") for k, c in votes.items())), "votes")
    names = [f"{k}_vote" for k in votes]
    model = fit(stage(measured.groupBy(*names).agg(F.count("*").alias("n")), "patterns"), names)
    n, r = F.col("n_words"), F.col("n_repeat_words")
    rated = measured.select(
        "*", ((n < MIN_WORDS) | (100 * r > MAX_REPEATED * n)).alias("base_failed"),
        posterior(model).alias("probability"),
    )
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5)), model
