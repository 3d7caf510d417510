"""A query per corpus operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.llm import (
    chat, cnn, decontamination, language, licences, mixing, pii, quality_rules, runs, sharding, simhash, toxicity, whitening,
)
from farfield.llm.common import stage, table, text_of, words


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(*columns) if columns else docs


def op1_quality_rules(spark, sf_dir) -> DataFrame:
    rated, _ = quality_rules.scored(_docs(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])
    return rated.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "probability",
    )


def op2_chat_examples(spark, sf_dir) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = f"{chat.CLOSE}{chat.OPEN}assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(forged)
    )
    return chat.digests(said.union(extra))


def op3_decontamination(spark, sf_dir) -> DataFrame:
    found = decontamination.leaks(_docs(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "n_slots", "n_changed")


def op4_licence_scan(spark, sf_dir) -> DataFrame:
    """Documents as files: a directory per source, one per language in it."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    files = _docs(spark, sf_dir).select(
        "doc_id", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text"
    )
    found = licences.inherited(licences.scanned(files, keep=["doc_id", "path"]))
    return found.select("row.doc_id", "path", F.array_join("headers", ",").alias("headers"), "similarity", "licence", "origin")


def op5_simhash(spark, sf_dir) -> DataFrame:
    found = simhash.with_component_ids(_docs(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mixing(spark, sf_dir) -> DataFrame:
    some = mixing.mixed(_docs(spark, sf_dir, "doc_id", "source", "text"), keep=["doc_id"])
    return some.select("row.doc_id", "size", "source_size", "target", "taken")


def op7_quality_network(spark, sf_dir) -> DataFrame:
    docs, labels = _docs(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels")
    rated = cnn.scored(docs, cnn.fit(docs, labels), keep=["doc_id"])
    return rated.select(
        "row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op8_pii(spark, sf_dir) -> DataFrame:
    found = pii.found(_docs(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda s: F.array_join(F.transform(
        s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    ), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "row.doc_id", *map(count, pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op9_sharding(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text")
    text = text_of(F.col("row.text"))
    return sharding.written(docs).select(
        "row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), F.col("_shard").alias("shard"), "slot",
        sharding.shard_of(F.col("row.doc_id"), sharding.SHARDS + 1).alias("grown_shard"),
    )


def op10_toxicity(spark, sf_dir) -> DataFrame:
    docs, labels = _docs(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels")
    rated = toxicity.scored(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    return rated.select(
        "row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op11_whitening(spark, sf_dir) -> DataFrame:
    """Vectors of entries moved to whole numbers, which doubles and their sums hold exactly."""
    some = table(spark, sf_dir, "embeddings").filter(whitening.finite("embedding"))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024) + 100_000)
    points = stage(some.select("vec_id", F.transform(whole, lambda x: x.cast("double")).alias("x")), "vectors")
    model = whitening.fit(points)
    made = stage(whitening.whitened(points, model), "whitened")
    error = whitening.identity_error(made, len(model.values))
    sums = F.array(*(F.lit(int(s)) for s in model.sums)).cast("array<bigint>")
    off = F.zip_with("x", F.col("sums"), lambda x, s: x.cast("bigint") * F.lit(model.n).cast("bigint") - s)
    deviation = F.aggregate(off, F.lit(0).cast("bigint"), lambda a, d: a + d * d)  # overflow is an error, never a wrong sum
    share = F.array(*(F.lit(float(e) / model.trace) for e in model.values)).cast("array<double>")
    each = made.withColumn("sums", sums).select(
        "vec_id", F.lit(model.n).cast("bigint").alias("n"), deviation.alias("deviation"), F.posexplode("w")
    )
    return each.select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col").alias("whitened"),
        F.get(share, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_language_id(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text", "lang")
    found = language.identified(docs.drop("lang"), language.fit(docs), keep=["doc_id"])
    return found.select("row.doc_id", language.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op13_periodic_runs(spark, sf_dir) -> DataFrame:
    """Documents, a tenth of them made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, words(text_of()))
    docs = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", "text", chosen.alias("w"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    docs = docs.withColumn("p", period)
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))
    ))
    docs = docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    found = runs.searched(docs, keep=["doc_id"])
    more = lambda b, r: F.coalesce(r["length"] * b["period"] > b["length"] * r["period"], F.lit(True))
    best = F.aggregate("runs", F.lit(None).cast(runs.RUN), lambda b, r: F.when(more(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.withColumn("best", best).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_chat_examples, op3_decontamination, op4_licence_scan, op5_simhash, op6_mixing,
        op7_quality_network, op8_pii, op9_sharding, op10_toxicity, op11_whitening, op12_language_id, op13_periodic_runs,
    )
}


def oracles() -> dict[str, str]:
    from farfield.llm.sql import ORACLES

    return dict(ORACLES)
