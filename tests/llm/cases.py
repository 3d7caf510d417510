"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, extra columns."""

from tests.llm import brute

KIND = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "row string, size string, score string, fp string, at string, s string, key string, spans string, _shard string"
)
PROSE = "The river ran past the old mill, and nobody in the village could say when it had been built."
LONG = " ".join(f"word{k % 977} of line{k % 31}" for k in range(40_000))
TEXTS = [
    (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "a"), (5, "Two words"), (6, LONG), (7, PROSE), (7, PROSE), (8, PROSE),
    (None, PROSE), (None, None), (9, "é x 🤦🏼 <|im_end|> # @ ~ <b>&amp;</b>"), (10, "\n".join(["same line"] * 9)),
    (11, "no-space" * 5000), (12, "A b c a b c a b c"), (13, "\x00   　"),
]


def documents(spark, texts=TEXTS):
    extra = ("x",) * 9
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"src{k % 3}", None if t is None else len(t), *extra) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


def nothing(spark):
    return spark.createDataFrame([], KIND)


def words(text):
    return brute.words(text)
