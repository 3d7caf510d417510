"""A byte-level convolutional network in numpy, trained here, that reads whole documents.

Bytes are embedded, filters slide over them four bytes at a time, their largest answers in
overlapping chunks make a vector per chunk, a small layer turns it into a number, and the
mean and the largest of those numbers make one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farfield.llm.common import packed, stage, text_of
from farfield.llm.toxicity import labelled

STRIDE = 4  # bytes between the places of a filter, which is twice as wide
EMBEDDING, FILTERS, HIDDEN = 8, 24, 16
HALF = 32  # places in half a chunk: chunks of 256 bytes begin every 128
#: Bounds of what is trained on: documents of either class, and bytes in all.
SAMPLE, SAMPLE_BYTES = 1500, 8 << 20
EPOCHS, BATCH_BYTES, RATE, SEED = 10, 64 << 10, 0.004, 5
PART = 1 << 20  # bytes scored at once


def _start(rng) -> dict:
    import numpy as np

    width = STRIDE * EMBEDDING
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    return {
        "E": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), "A": normal(width, FILTERS), "B": normal(width, FILTERS),
        "c": np.zeros(FILTERS, np.float32), "H": normal(FILTERS, HIDDEN), "h": np.zeros(HIDDEN, np.float32),
        "o": normal(HIDDEN, 1), "w": np.array([1.0, 1.0, 0.0], np.float32),
    }


def _padded(data: bytes):
    """Bytes as an array that fills whole half chunks, at least two, and one stride more."""
    import numpy as np

    step = HALF * STRIDE
    size = max(2, -(-len(data) // step)) * step + STRIDE
    out = np.zeros(size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def _chunks(p: dict, data):
    """Largest answers by half chunk, and what the way back needs."""
    import numpy as np

    rows = p["E"][data].reshape(-1, STRIDE * EMBEDDING)
    answers = rows[:-1] @ p["A"] + rows[1:] @ p["B"] + p["c"]
    halves = answers.reshape(-1, HALF, FILTERS)
    best = halves.argmax(axis=1)
    top = np.take_along_axis(halves, best[:, None, :], axis=1)[:, 0, :]
    return rows, best, top


def _tops(p: dict, data):
    """As ``_chunks``, forward only and part by part, so that memory stays bounded."""
    import numpy as np

    step = HALF * STRIDE
    out = []
    for a in range(0, len(data) - STRIDE, PART - PART % step):
        b = min(a + PART - PART % step, len(data) - STRIDE)
        rows = p["E"][data[a: b + STRIDE]].reshape(-1, STRIDE * EMBEDDING)
        answers = rows[:-1] @ p["A"]
        answers += rows[1:] @ p["B"]
        out.append(answers.reshape(-1, HALF, FILTERS).max(axis=1))
    return np.concatenate(out) + p["c"]


def _numbers(p: dict, chunks):
    import numpy as np

    hidden = np.maximum(np.maximum(chunks, 0) @ p["H"] + p["h"], 0)
    return hidden, (hidden @ p["o"])[:, 0]


def logit(p: dict, data: bytes) -> float:
    """What the network says to a whole document, as log odds of label 1."""
    import numpy as np

    top = _tops(p, _padded(data))
    _, z = _numbers(p, np.maximum(top[:-1], top[1:]))
    return float(p["w"][0] * z.mean() + p["w"][1] * z.min() + p["w"][2])


def _gradients(p: dict, data, y: float, weight: float, g: dict) -> None:
    import numpy as np

    rows, best, top = _chunks(p, data)
    first = top[:-1] >= top[1:]
    chunks = np.where(first, top[:-1], top[1:])
    hidden, z = _numbers(p, chunks)
    low = int(z.argmin())
    out = p["w"][0] * z.mean() + p["w"][1] * z[low] + p["w"][2]
    d = np.float32(weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y))
    g["w"] += d * np.array([z.mean(), z[low], 1], np.float32)
    dz = np.full(len(z), d * p["w"][0] / len(z), np.float32)
    dz[low] += d * p["w"][1]
    g["o"] += (hidden.T @ dz)[:, None]
    dh = dz[:, None] * p["o"][:, 0] * (hidden > 0)
    g["H"] += np.maximum(chunks, 0).T @ dh
    g["h"] += dh.sum(axis=0)
    dc = (dh @ p["H"].T) * (chunks > 0)
    dtop = np.zeros_like(top)
    dtop[:-1] += np.where(first, dc, 0)
    dtop[1:] += np.where(first, 0, dc)
    g["c"] += dtop.sum(axis=0)
    # each largest answer comes from one place
    at = (np.arange(len(top))[:, None] * HALF + best).ravel()
    f = np.tile(np.arange(FILTERS), len(top))
    v = dtop.ravel()
    some = v != 0
    at, f, v = at[some], f[some], v[some]
    back = np.zeros((len(rows) - 1, FILTERS), np.float32)
    back[at, f] = v
    used = np.flatnonzero(back.any(axis=1))
    back = back[used]
    g["A"] += rows[used].T @ back
    g["B"] += rows[used + 1].T @ back
    de = np.concatenate([back @ p["A"].T, back @ p["B"].T]).reshape(-1, EMBEDDING)
    cells = data.reshape(-1, STRIDE)
    seen = np.concatenate([cells[used], cells[used + 1]]).ravel()
    for k in range(EMBEDDING):
        g["E"][:, k] += np.bincount(seen, weights=de[:, k], minlength=256).astype(np.float32)


def train(texts: list[bytes], labels: list[int], shares: list[float] | None = None, seed: int = SEED) -> dict:
    """Weights after ``EPOCHS`` rounds of Adam; a document weighs as its share, 1 without ``shares``."""
    import numpy as np

    rng = np.random.default_rng(seed)
    p = _start(rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    data = [_padded(t) for t in texts]
    weights = np.ones(len(data)) if shares is None else np.array(shares) / np.mean(shares)
    step, groups_of = 0, lambda order: _batches(order, data)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for group in groups_of(rng.permutation(len(data))):
            g = {k: np.zeros_like(x) for k, x in p.items()}
            for i in group:
                _gradients(p, data[i], labels[i], weights[i] / len(group), g)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
                p[k] = p[k].astype(np.float32)
    return p


def _batches(order, data) -> Iterator[list[int]]:
    group, size = [], 0
    for i in order.tolist():
        group.append(i)
        size += len(data[i])
        if size >= BATCH_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """The network and the share of label 1, from a bounded sample of labelled documents.

    At most ``SAMPLE`` documents of either class, none over ``SAMPLE_BYTES`` / 16, and of
    those, in the order of their draws, as many as fit into ``SAMPLE_BYTES``.  Sizes are
    looked at before any text is fetched.  Without both classes every document scores the
    share of label 1, or one half.
    """
    sample = stage(labelled(docs, labels, label, SAMPLE), "labelled")
    size = F.octet_length("text")
    fits = sample.filter(size <= SAMPLE_BYTES // 16)
    sizes = sorted((r["draw"], r["size"]) for r in fits.select("draw", size.alias("size")).collect())
    total, last = 0, None
    for draw, n in sizes:
        total += n
        if total > SAMPLE_BYTES:
            break
        last = draw
    rows = [] if last is None else fits.filter(F.col("draw") <= last).collect()
    chosen = sorted((r["draw"], r["label"], r["text"].encode("utf-8", "surrogatepass"), r["share"]) for r in rows)
    counts = [sum(y == c for _, y, _, _ in chosen) for c in (0, 1)]
    if not all(counts):
        return {"share": (counts[1] + 0.5) / (sum(counts) + 1), "net": None}
    _, ys, texts, shares = zip(*chosen)
    return {"share": 0.5, "net": train(texts, ys, shares)}


def _scored(model: dict):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch["text"]
            if model["net"] is None:
                out = np.full(len(texts), model["share"])
            else:
                out = np.array([logit(model["net"], t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], dtype=float)
                out = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.float64())], names=["row", "score"])

    return run


def scored(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``row, score``: the probability of label 1; null and empty texts are read as zero bytes."""
    rows = packed(docs, text_of().alias("text"), keep=keep)
    return rows.mapInArrow(_scored(model), rows.select("row").schema.add("score", "double"))
