"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs, drawn from its code point.  Three letters in a row
are bound into one vector: the first turned by two places, the second by one, all multiplied.
A text is the bundle (sum) of the vectors of its letter triples, a language the bundle of its
texts, each scaled to length one.  A text gets the language whose profile makes the smallest
angle with its own, both taken relative to the mean of all profiles.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.llm.common import packed, text_of

DIMS = 2048
SEED = 12
FOLDS, HELD = 4, 2
NONE = "und"
PART = 1 << 18  # characters looked at together; a longer text is a part of its own
TRIPLES = 1 << 11  # vectors held at once


def held_out(doc_id: Column | str) -> Column:
    """Whether a document stays out of learning: its checksum decides (a null id learns)."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % FOLDS == HELD, F.lit(False))


def _letters():
    """A function from code points to lower-case letters, 0 for what is no letter."""
    import sys

    import numpy as np

    table = np.zeros(sys.maxunicode + 1, np.int32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            table[c] = ord(s.lower()[0])
    return table


def _signs(letters, dims: int, seed: int):
    """The vector of each letter (0: the gap between words), of -1 and 1."""
    import numpy as np

    return np.stack([
        np.random.default_rng([seed, c]).integers(0, 2, dims, dtype=np.int8) * 2 - 1 for c in letters.tolist()
    ]) if len(letters) else np.zeros((0, dims), np.int8)


def _triples(texts: list, table):
    """``document, triple, count`` of texts; a triple is three code points as one number."""
    import numpy as np

    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points])
    flat = table[np.concatenate([np.r_[p, 0, 0] for p in points])] if texts else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(texts)), sizes + 2)
    # a gap before the first letter of each text; one gap between words
    flat = np.r_[0, flat].astype(np.int64)
    doc = np.r_[0, doc]
    stays = np.r_[True, (flat[1:] != 0) | (flat[:-1] != 0)]
    flat, doc = flat[stays], doc[stays]
    # triples lie around a letter, from its neighbour or gap on either side
    middle = np.flatnonzero(flat[1:-1] != 0) + 1
    codes = (flat[middle - 1] << 42) | (flat[middle] << 21) | flat[middle + 1]
    names, codes = np.unique(codes, return_inverse=True)
    pairs, counts = np.unique(doc[middle] * len(names) + codes, return_counts=True)
    return pairs // max(1, len(names)), names, pairs % max(1, len(names)), counts


def _bound(names, dims: int, seed: int):
    """The vectors of triples."""
    import numpy as np

    parts = np.stack([(names >> 42), (names >> 21) & 0x1FFFFF, names & 0x1FFFFF])
    letters, at = np.unique(parts, return_inverse=True)
    signs, at = _signs(letters, dims, seed), at.reshape(parts.shape)
    return np.roll(signs, 2, axis=1)[at[0]] * np.roll(signs, 1, axis=1)[at[1]] * signs[at[2]]


def _bundles(texts: list, table, dims: int, seed: int):
    """A vector of length one for each text, zero for a text without letters."""
    import numpy as np

    doc, names, triple, counts = _triples(texts, table)
    out = np.zeros((len(texts), dims), np.float32)
    order = np.argsort(triple, kind="stable")
    doc, triple, counts = doc[order], triple[order], counts[order].astype(np.float32)
    for cut in range(0, len(names), TRIPLES):
        vectors = _bound(names[cut:cut + TRIPLES], dims, seed).astype(np.float32)
        a, b = np.searchsorted(triple, [cut, cut + TRIPLES])
        dense = np.zeros((len(texts), len(vectors)), np.float32)
        dense[doc[a:b], triple[a:b] - cut] = counts[a:b]
        out += dense @ vectors
    size = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1, keepdims=True)).astype(np.float32)
    return np.divide(out, size, out=out, where=size > 0)


def _parts(texts: list):
    """Places where to cut a list of texts."""
    cut = 0
    while cut < len(texts):
        end, held = cut + 1, len(texts[cut])
        while end < len(texts) and held + len(texts[end]) <= PART:
            held += len(texts[end])
            end += 1
        yield cut, end
        cut = end


def _learning(dims: int, seed: int):
    def learn(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table, sums = _letters(), {}
        for batch in batches:
            texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
            for a, b in _parts(texts):
                made = _bundles(texts[a:b], table, dims, seed).astype(np.float64)
                for lang in set(langs[a:b]):
                    mine = made[[k for k, x in enumerate(langs[a:b]) if x == lang]].sum(axis=0)
                    sums[lang] = sums[lang] + mine if lang in sums else mine
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dims, pa.string()), pa.array(np.arange(dims, dtype=np.int32)), pa.array(total)],
                names=["lang", "at", "value"],
            )

    return learn


def fit(docs: DataFrame, dims: int = DIMS, seed: int = SEED) -> dict:
    """``langs`` (sorted) and ``profiles`` (one row each) from ``doc_id, text, lang``.

    Learns from rows that ``held_out`` leaves and whose language is not null.  Every task adds up
    its own texts; what reaches the driver is one profile per language, however many texts.
    """
    import numpy as np

    rows = docs.filter(F.col("lang").isNotNull() & ~held_out("doc_id")).select("lang", text_of().alias("text"))
    sums = rows.mapInArrow(_learning(dims, seed), "lang string, at int, value double")
    # parts are rounded before they are added, so that their order does not matter
    exact = F.sum(F.round(F.col("value") * (1 << 20)).cast("decimal(38,0)")).cast("double").alias("value")
    got = sums.groupBy("lang", "at").agg(exact).toPandas().sort_values(["lang", "at"])
    langs = sorted(set(got["lang"]))
    raw = got["value"].to_numpy(dtype=np.float64).reshape(len(langs), dims) if langs else np.zeros((0, dims))
    size = np.sqrt((raw ** 2).sum(axis=1, keepdims=True))
    return {"langs": langs, "profiles": np.divide(raw, size, out=np.zeros_like(raw), where=size > 0), "seed": seed}


def _scoring(model: dict):
    langs, profiles, seed = model["langs"], model["profiles"], model["seed"]

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = _letters()
        mean = profiles.mean(axis=0) if len(langs) > 1 else np.zeros(profiles.shape[1])
        apart = profiles - mean
        size = np.sqrt((apart ** 2).sum(axis=1, keepdims=True))
        apart = np.divide(apart, size, out=np.zeros_like(apart), where=size > 0)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in _parts(texts):
                made = _bundles(texts[a:b], table, profiles.shape[1], seed).astype(np.float64)
                some = made.any(axis=1) & bool(langs)
                made -= mean
                size = np.sqrt((made ** 2).sum(axis=1, keepdims=True))
                near = np.divide(made, size, out=np.zeros_like(made), where=size > 0) @ apart.T
                best = near.argmax(axis=1) if langs else np.zeros(b - a, np.int64)
                cosine = near[np.arange(b - a), best] if langs else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([
                    batch["row"].slice(a, b - a),
                    pa.array([langs[k] if s else NONE for k, s in zip(best.tolist(), some.tolist())], pa.string()),
                    pa.array(np.where(some, np.clip((1 + cosine) / 2, 0, 1), 0.0)),
                ], names=["row", "lang_pred", "score"])

    return score


def identified(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``row, lang_pred, score`` for the whole ``text`` of each row.

    ``score`` is the cosine with the chosen profile, moved to 0 to 1; of equal ones the first
    language in code point order is chosen.  A null text, one without letters, and any text where
    nothing was learned are ``und`` with score 0.
    """
    rows = packed(docs, text_of().alias("text"), keep=keep)
    return rows.mapInArrow(_scoring(model), rows.select("row").schema.add("lang_pred", "string").add("score", "double"))
