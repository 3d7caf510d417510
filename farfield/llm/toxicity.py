"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs standing for letters), then one
Aho-Corasick pass finds whole words and beginnings of words.  Weights are log odds learned
from labelled documents; the sum over a text is normalised by its length, and exception
phrases take out what lies inside them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.llm.common import packed, stage, text_of

#: The model is fitted on at most so many labelled documents of each class.
SAMPLE = 4000
#: Terms that enter the lexicon: how sure (likelihood ratio), how telling (log odds).
SURE, TELLING = 25.0, 2.0
#: A lexicon or list of exceptions beyond so many terms is an error: nothing is cut.
LARGEST = 500_000
PREFIXES = range(3, 10)

#: Known before any label is seen, with the weight of a sure sign.
STARTING = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown")
STARTING_WEIGHT = 4.0
#: Harmless phrases around words of the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "disgusting smell", "sore loser board")

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
}
#: Digits and signs that stand for letters inside words.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_FOLD |= {0xFF41 + k: chr(97 + k) for k in range(26)}  # full width
_FOLD |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])  # unseen
_SIGNS = str.maketrans(STANDS_FOR)
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$!9]+(?=[^\W\d_])|(?<![^\W_])[0134578@$9]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?![\w@])")
_OTHER = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """Words of letters in lower case between single blanks, look-alikes replaced."""
    text = text.lower().translate(_FOLD)
    text = _INSIDE.sub(lambda m: m[0].translate(_SIGNS), text)
    return f" {_OTHER.sub(' ', text).strip()} "


def terms(line: str) -> set[str]:
    """What a folded text offers to a lexicon: its words and the beginnings of its words.

    A word is written with a blank on both sides, a beginning with one before it.
    """
    found = set()
    for w in set(line.split()):
        found.add(f" {w} ")
        found.update(f" {w[:n]}" for n in PREFIXES if n <= len(w))
    return found


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """A sample ``label, text, draw, share`` to learn from: at most ``most`` documents of either class.

    ``share`` is how many labelled documents of its class a row stands for, 1 if all are taken.

    Rows whose crc32 of the id is divisible by 5 are held out, null labels and ids are left
    out, a document with several labels has the largest, and of rows that share an id the
    smallest text counts.  Hashes of ids choose; ``draw`` is another one.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    known = stage(known.filter(~held_out()), "known-labels")
    total = {r["label"]: r["n"] for r in known.filter("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, max(1.0, total.get(1, 0) / most)).otherwise(max(1.0, total.get(0, 0) / most))
    few = [
        known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most) for c in (0, 1)
    ]
    # at most two times ``most`` ids: small enough to broadcast
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(few[0].union(few[1])), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return one.select("label", "text", F.xxhash64("doc_id", F.lit(4)).alias("draw"), share.alias("share"))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is held out; one without an id is not."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 5 == 0, F.lit(False))


#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 100_000


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def handed_on(seen: dict[int, Counter]):
        every = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(every, pa.string()), *(pa.array([seen[c][t] for t in every], pa.int64()) for c in (1, 0))],
            names=["term", "bad", "good"],
        )

    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for y, text in zip(batch["label"], batch["text"]):
            mine = seen[1 if y.as_py() else 0]
            mine.update(terms(folded(text.as_py())))
            mine[""] += 1
            if len(seen[0]) + len(seen[1]) > HELD_TERMS:
                yield handed_on(seen)
                seen = {0: Counter(), 1: Counter()}
    yield handed_on(seen)


def _whole(rated: DataFrame) -> list:
    rows = rated.limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"more than {LARGEST} terms tell classes apart: raise SURE or TELLING")
    return sorted(rows, key=lambda r: r["term"])


def learned(sample: DataFrame) -> dict:
    """The lexicon: ``weights`` by term and ``exceptions``, from documents with and without terms.

    A term enters if the likelihood ratio of its counts is sure and its odds tell.  A word
    that begins like one of the lexicon, but is as common in harmless texts, becomes an
    exception.  Without both classes the starting lexicon stands alone.
    """
    start = {"weights": {f" {w} ": STARTING_WEIGHT for w in STARTING}, "exceptions": [f" {p} " for p in EXCEPTIONS]}
    counts = sample.mapInArrow(_counted, "term string, bad long, good long").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    counts = stage(counts, "term-counts")
    total = counts.filter("term = ''").first()
    if total is None or not total["bad"] or not total["good"]:
        return start
    bad, good = float(total["bad"]), float(total["good"])
    a, b = F.col("bad").cast("double"), F.col("good").cast("double")
    part = lambda x, n: F.when(x > 0, x * F.log(x / ((a + b) * n / (bad + good)))).otherwise(0.0)
    sure = 2 * (part(a, bad) + part(b, good))
    odds = F.log((a + 0.5) / (bad + 1)) - F.log((b + 0.5) / (good + 1))
    rated = counts.filter("term <> ''").select("term", odds.alias("odds"), sure.alias("sure"), "bad", "good")
    chosen = rated.filter((F.col("odds") >= TELLING) & (F.col("sure") >= SURE))
    weights = {r["term"]: r["odds"] for r in _whole(chosen)}
    begins = [t for t in weights if not t.endswith(" ")]
    harmless = []
    if begins:
        shared = F.lit(False)
        for n in sorted({len(t) for t in begins}):  # a few lengths: those of PREFIXES
            shared = shared | F.substr("term", F.lit(1), F.lit(n)).isin([t for t in begins if len(t) == n])
        words = rated.filter(F.col("term").endswith(" ") & shared & (F.col("good") >= 5) & (F.col("odds") < 0.5))
        harmless = sorted(r["term"] for r in _whole(words))
    return {"weights": start["weights"] | weights, "exceptions": start["exceptions"] + harmless}


def _matcher(model: dict):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t, w in model["weights"].items():
        found.add_word(t, (t, w, False))
    for t in model["exceptions"]:
        found.add_word(t, (t, 0.0, True))
    found.make_automaton()
    return found


def _weight(line: str, matcher) -> tuple[float, int]:
    """Sum of weights, each word counting its heaviest term, and the number of words."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (t, w, spares) in matcher.iter(line):
        start = end - len(t) + 1
        if spares:
            spared.append((start, end))
        elif w > best.get(start, 0.0):
            best[start] = w
    if spared:
        # one pass over both in order: what starts before the farthest end so far is spared
        spared.sort()
        k, covered = 0, -1
        for s in sorted(best):
            while k < len(spared) and spared[k][0] <= s:
                covered = max(covered, spared[k][1])
                k += 1
            if s < covered:
                del best[s]
    return float(sum(best.values())), line.count(" ") - 1 if len(line) > 2 else 0


def signals(weight: float, n: int) -> tuple[float, float]:
    """What the probability is computed from: the weight in all, and per hundred words."""
    return math.log1p(weight), math.log1p(100.0 * weight / (n + 20))


def _measured(model: dict):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher = _matcher(model)
        for batch in batches:
            rows = [signals(*_weight(folded(t), matcher)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], *(pa.array([r[k] for r in rows], pa.float64()) for k in (0, 1))], names=["row", "all", "dense"]
            )

    return run


def measured(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``row`` and the two signals; null and empty texts weigh 0."""
    rows = packed(docs, text_of().alias("text"), keep=keep)
    return rows.mapInArrow(_measured(model), rows.select("row").schema.add("all", "double").add("dense", "double"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    """Lexicon and probability, both from the sample of ``labelled``."""
    import numpy as np

    sample = stage(labelled(docs, labels, label), "labelled")
    model = learned(sample)
    model["line"] = [-4.0, 1.5, 1.0]
    # two numbers for each of at most twice SAMPLE documents
    rows = measured(sample.select("label", "text", "share"), model).select("row.label", "row.share", "all", "dense").toPandas()
    y, w = rows["label"].to_numpy(float), rows["share"].to_numpy(float)
    if 0 < y.sum() < len(y):
        x, held = np.column_stack([np.ones(len(y)), rows["all"], rows["dense"]]), np.array([0.01, 0.1, 0.1])
        # either class counts as its share of all labels, however few of it were drawn, so the
        # threshold of one half keeps its meaning
        w = w / w.mean()
        line = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (w * (y - p)) - held * line)
            line += step
            if abs(step).max() < 1e-8:
                break
        model["line"] = line.tolist()
    return model


def scored(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``score``, from 0 to 1; equal texts get equal scores."""
    c, a, d = model["line"]
    return measured(docs, model, keep).select("row", (1 / (1 + F.exp(-(F.lit(c) + a * F.col("all") + d * F.col("dense"))))).alias("score"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    return scored(docs, fit(docs, labels)).filter(F.col("score") < threshold).select("row.*")
