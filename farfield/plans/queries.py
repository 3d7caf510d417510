"""One query per operator, each over whole tables of a scale-factor folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from farfield.functions import hashing, measures as M, text as T
from farfield.operators import audit, evaluate, lof as L, lsh, sets, synth
from farfield.operators.knn import CANDIDATE, QUERY, edges, knn
from farfield.plans import tables as D
from farfield.session import stage
from farfield.sources import files
from farfield.streaming import areas as A
from farfield.streaming.detect import detector
from farfield.streaming.rlof import delete_rows
from farfield.streaming.sources import file_stream, parsed, replay

K, TOP = D.K, D.TOP
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def pairs(neighbourhoods):
    return rounded(edges(neighbourhoods), "dist")


# --- local outlier factors --------------------------------------------------------------

@query
def lof_top_n(spark, sf_dir):
    scored = L.top_outliers(L.lof(D.customers(spark, sf_dir), K), TOP)
    return rounded(scored.select("i", "n", "kd", "lof"), "kd", "lof")


@query
def lof_scores(spark, sf_dir):
    return rounded(L.lof(D.customers(spark, sf_dir), K), "kd", "lrd", "lof")


@query
def lof_with_copies(spark, sf_dir):
    scored = L.lof_with_points(D.parts(spark, sf_dir), K)
    return rounded(scored.select("i", "n", "kd", "lof"), "kd", "lof")


@query
def lof_manhattan(spark, sf_dir):
    scored = L.lof(D.suppliers(spark, sf_dir), 3, "manhattan")
    return rounded(scored, "kd", "lrd", "lof")


@query
def lof_exactly_k(spark, sf_dir):
    """Factors over exactly k neighbours each, as an index without ties would give."""
    return rounded(L.lof(D.parts(spark, sf_dir), K, technique="kd"), "kd", "lrd", "lof")


@query
def lof_in_buckets(spark, sf_dir):
    family = hashing.projection_family(D.PROJECTIONS, D.OFFSETS, D.WIDTH)
    scored = L.lof(D.customers(spark, sf_dir), K, technique="tables", hashed=family)
    return rounded(scored, "kd", "lrd", "lof")


@query
def lof_labels(spark, sf_dir):
    return L.label_top(L.lof(D.customers(spark, sf_dir), K), TOP).select("i", "label")


@query
def top_inliers(spark, sf_dir):
    scored = stage(L.lof(D.customers(spark, sf_dir), K), "scored")
    return L.top_inliers(scored, 5, scored.count()).select("i", F.round("lof", 6).alias("lof"))


@query
def k_distances(spark, sf_dir):
    near = knn(sets.distinct_points(D.parts(spark, sf_dir)), K)
    return rounded(near.select("i", "kd", "n"), "kd")


@query
def reach_distances(spark, sf_dir):
    near = stage(knn(sets.distinct_points(D.customers(spark, sf_dir)), K), "near")
    kd = near.select(F.col("i").alias("j"), "kd")
    reach = edges(near).join(kd, "j").select("i", "j", M.reach_distance(F.col("kd"), F.col("dist")).alias("reach"))
    return rounded(reach, "reach")


# --- neighbours -------------------------------------------------------------------------

@query
def knn_with_ties(spark, sf_dir):
    return pairs(knn(sets.distinct_points(D.parts(spark, sf_dir)), K))


@query
def knn_exactly_k(spark, sf_dir):
    return pairs(lsh.first_k(knn(sets.distinct_points(D.parts(spark, sf_dir)), K), K))


@query
def nearest_one(spark, sf_dir):
    return pairs(lsh.first_k(knn(sets.distinct_points(D.customers(spark, sf_dir)), 1), 1))


@query
def knn_cosine(spark, sf_dir):
    return pairs(knn(D.embeddings(spark, sf_dir), 4, "cosine"))


@query
def knn_own_measure(spark, sf_dir):
    """Neighbours under a user's measure: the largest difference of a coordinate."""
    largest = M.Measure("largest", None, lambda a, b: abs(a - b).max(axis=-1))
    return pairs(knn(sets.distinct_points(D.suppliers(spark, sf_dir)), 3, largest))


@query
def linear_top_k(spark, sf_dir):
    """For each supplier the 4 nearest customers and the sum of their distances."""
    shifted = F.col("i") + 1_000_000_000_000
    ask = D.suppliers(spark, sf_dir).select(shifted.alias("i"), "x", F.lit(QUERY).alias("role"))
    data = D.customers(spark, sf_dir).select("i", "x", F.lit(CANDIDATE).alias("role"))
    near = lsh.first_k(knn(ask.unionByName(data), 4), 4)
    total = F.aggregate("nbrs", F.lit(0.0), lambda s, e: s + e["dist"])
    found = near.select((F.col("i") - 1_000_000_000_000).alias("q"), total.alias("total"), F.posexplode("nbrs"))
    return rounded(
        found.select("q", (F.col("pos") + 1).alias("place"), F.col("col.j").alias("j"), "total"), "total"
    )


@query
def reverse_neighbours(spark, sf_dir):
    near = knn(sets.distinct_points(D.customers(spark, sf_dir)), K)
    return edges(near).groupBy("j").agg(F.count("*").alias("listed_by"), F.min("i").alias("first_lister"))


@query
def box_search(spark, sf_dir):
    found = sets.box_search(D.parts(spark, sf_dir), D.BOX_LOW, D.BOX_HIGH)
    return found.select("i", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"))


@query
def box_join(spark, sf_dir):
    """Customers within 50 of a supplier's balance and 2 of its nation code."""
    boxes = D.suppliers(spark, sf_dir).select(
        F.col("i").alias("box"),
        F.array(F.col("x")[0] - 50, F.col("x")[1] - 2).alias("lo"),
        F.array(F.col("x")[0] + 50, F.col("x")[1] + 2).alias("hi"),
    )
    return sets.box_join(D.customers(spark, sf_dir), boxes, [100.0, 5.0]).select("box", "i")


@query
def exact_lookup(spark, sf_dir):
    """For every part, the stored point with its coordinates."""
    wanted = D.parts(spark, sf_dir).select(F.col("i").alias("q"), "x")
    return sets.exact_lookup(sets.distinct_points(D.parts(spark, sf_dir)), wanted).select("q", "i")


@query
def delete_points(spark, sf_dir):
    brand = D.table(spark, sf_dir, "part").filter("p_brand = 'Brand#2'")
    gone = brand.select(D.vector("p_size", "p_retailprice").alias("x"))
    return sets.delete_points(D.parts(spark, sf_dir), gone).select("i")


@query
def add_points(spark, sf_dir):
    rows = D.table(spark, sf_dir, "part").select(
        "p_brand", F.col("p_partkey").alias("seq"), D.vector("p_size", "p_retailprice").alias("x")
    )
    stored = sets.first_arrivals(rows.filter("p_brand = 'Brand#2'").drop("p_brand"))
    arriving = rows.filter("p_brand <> 'Brand#2'").drop("p_brand")
    return sets.add_points(stored, arriving).select(
        "seq", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2")
    )


@query
def first_arrivals(spark, sf_dir):
    rows = D.parts(spark, sf_dir).withColumnRenamed("i", "seq")
    return sets.first_arrivals(rows).select("seq", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"))


@query
def union_distinct(spark, sf_dir):
    coordinates = lambda p: p.select(F.col("x")[1].alias("nation"))
    return sets.union_distinct(
        coordinates(D.customers(spark, sf_dir)), coordinates(D.suppliers(spark, sf_dir))
    )


@query
def set_difference(spark, sf_dir):
    urgent = D.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    buyers = urgent.select(F.col("o_custkey").alias("i"))
    return sets.difference(D.customers(spark, sf_dir).select("i"), buyers, ["i"])


@query
def profile_difference(spark, sf_dir):
    """Points whose exact and bucketed factors differ by more than 0.01."""
    points = D.customers(spark, sf_dir)
    family = hashing.projection_family(D.PROJECTIONS, D.OFFSETS, D.WIDTH)
    near = stage(lsh.lsh_knn(sets.distinct_points(points), K, family), "near")
    differ = sets.unmatched_within(L.profiles(near), L.lof(points, K), ["i"], "lof", 0.01)
    return rounded(differ, "received", "expected")


# --- distances --------------------------------------------------------------------------

@query
def vector_distances(spark, sf_dir):
    """All distances between each embedding and the one after it."""
    a = D.embeddings(spark, sf_dir)
    b = a.select((F.col("i") - 1).alias("i"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    shifted = lambda v: F.transform(v, lambda e: e + 1)
    named = {
        "euclidean": M.euclidean(x, y),
        "squared": M.squared_euclidean(x, y),
        "manhattan": M.manhattan(x, y),
        "cosine": M.cosine(x, y),
        "intersect": M.intersection(shifted(x), shifted(y)),
        "dot": M.dot(x, y),
        "by_name": M.resolve("EUCLIDEAN").column(x, y),
    }
    both = a.join(b, "i")
    return both.select("i", *(F.round(c, 6).alias(n) for n, c in named.items()))


@query
def hamming_distances(spark, sf_dir):
    a = D.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    b = a.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("other"))
    return a.join(b, "c_custkey").select(
        "c_custkey",
        M.hamming_bits(F.col("c_custkey"), F.col("c_custkey") + 1).cast("int").alias("bits"),
        M.hamming_text(F.col("c_name"), F.col("other")).alias("letters"),
    )


@query
def ml_vector_round_trip(spark, sf_dir):
    back = T.from_ml_vector(T.to_ml_vector(F.col("x")))
    total = F.aggregate("back", F.lit(0.0), lambda s, v: s + v)
    return D.embeddings(spark, sf_dir).withColumn("back", back).select(
        "i", F.size("back").alias("dims"), F.round(total, 6).alias("total")
    )


@query
def virtual_point_distances(spark, sf_dir):
    """Each supplier as an area of radius 100: its virtual points, and how far the buyers of
    its line items are from them."""
    areas = D.suppliers(spark, sf_dir).select(F.col("i").alias("center"), "x", F.lit(100.0).alias("radius"))
    rim = A.virtual_points(areas, 2).select("center", "axis", "side", F.col("x").alias("vx"))
    sold = D.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("center"), "l_orderkey")
    bought = D.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("i"))
    met = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select("center", "i").distinct()
    here = met.join(D.customers(spark, sf_dir), "i")
    there = areas.withColumnRenamed("x", "cx")
    apart = here.join(there, "center").select(
        "center", "radius", M.euclidean(F.col("x"), F.col("cx")).alias("l2"),
        M.manhattan(F.col("x"), F.col("cx")).alias("l1"),
    )
    away = lambda d, m: F.round(
        M.virtual_distance(F.col(d), F.col("radius"), F.col("axis"), F.col("side"), m), 6
    )
    return apart.join(rim, "center").groupBy("center", "axis", "side").agg(
        F.round(F.first(F.col("vx")[0]), 6).alias("v1"),
        F.round(F.first(F.col("vx")[1]), 6).alias("v2"),
        F.min(away("l2", "euclidean")).alias("nearest_l2"),
        F.max(away("l1", "manhattan")).alias("farthest_l1"),
    )


# --- text and files ---------------------------------------------------------------------

@query
def parsed_words(spark, sf_dir):
    line = F.concat_ws(" ", "p_size", "p_brand", "p_type", F.lit(""))
    x = T.parse_point(line)
    rows = D.table(spark, sf_dir, "part").select("p_partkey", x.alias("x"))
    return rows.select("p_partkey", F.size("x").alias("words"), *(F.col("x")[j].alias(f"x{j}") for j in range(3)))


@query
def parsed_documents(spark, sf_dir):
    """Whole texts as vectors: how many words, and a checksum of their values."""
    x = T.parse_point(F.regexp_replace("text", r"\s", " "))
    rows = D.table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    return rows.select(
        "doc_id",
        F.size("x").alias("words"),
        F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 3).alias("checksum"),
    )


@query
def keyed_scan(spark, sf_dir):
    rows = D.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat_ws(
            " ", "c_custkey", "c_acctbal", "c_nationkey",
            F.when(F.col("c_nationkey") != 0, (F.col("c_mktsegment") == "BUILDING").cast("int")),
        ).alias("line"),
    )
    read = files.keyed_points(spark, D.written_lines(rows, "c_custkey", "keyed"), 2)
    return read.select("key", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"), "label")


@query
def assigned_keys(spark, sf_dir):
    rows = D.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(" ", "p_partkey", "p_size", F.lit("dropped"), "p_brand").alias("line")
    )
    return files.assign_keys(spark, D.written_lines(rows, "p_partkey", "unkeyed"))


@query
def vector_scan(spark, sf_dir):
    rows = D.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(" ", "p_brand", "p_size", "p_partkey").alias("line")
    )
    path = D.written_lines(rows, "p_partkey", "vectors")
    read = files.vector_lines(spark, path, expected_columns=3)
    return read.select("pos", "key", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"))


@query
def first_vectors(spark, sf_dir):
    """The first hundred lines only: the reader's row limit."""
    rows = D.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(" ", "p_brand", "p_size", "p_retailprice").alias("line")
    )
    read = files.vector_lines(spark, D.written_lines(rows, "p_partkey", "vectors"), max_rows=100)
    return read.select("pos", "key", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"))


@query
def appended_lines(spark, sf_dir):
    """Result lines of two runs, appended to one folder and read back."""
    path = D.scratch(spark, "appended")
    for status in ("F", "O"):
        rows = D.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status)
        files.append_lines(rows.select(F.concat_ws(", ", "o_orderkey", "o_orderstatus").alias("line")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def expected_outlier_file(spark, sf_dir):
    rows = D.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat_ws(" ", "c_nationkey", F.floor("c_acctbal"), F.lit("Noise")).alias("line")
    )
    return files.expected_outliers(spark, D.written_lines(rows, "c_custkey", "outliers"))


@query
def classed_scan(spark, sf_dir):
    rows = D.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat_ws(" ", "c_acctbal", "c_nationkey", "c_mktsegment").alias("line")
    )
    read = files.classed_points(spark, D.written_lines(rows, "c_custkey", "classed"))
    return read.groupBy("class").agg(
        F.count("*").alias("n"), F.round(F.max("x"), 6).alias("most"), F.max("y").alias("nation")
    )


@query
def relabelled_classes(spark, sf_dir):
    """Line items as 41 features and a class; classes kept, relabelled, counted."""
    name = (
        F.when(F.col("l_returnflag") == "N", "normal").when(F.col("l_returnflag") == "R", "back")
        .otherwise("other")
    )
    features = F.array_join(F.array_repeat(F.col("l_linenumber").cast("string"), 41), ",")
    rows = D.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat(features, F.lit(","), name, F.lit(".")).alias("line")
    )
    kept = files.classed_records(spark, D.written_lines(rows, "l_orderkey", "records"))
    counts = kept.groupBy("label").agg(
        F.count("*").alias("n"), F.countDistinct("key").alias("keys"),
        F.max(F.size(F.split("line", " "))).alias("words"),
    )
    return counts


@query
def label_counts(spark, sf_dir):
    labelled = D.table(spark, sf_dir, "events").select(
        (F.col("event_type") == "error").cast("int").alias("label")
    )
    return files.class_counts(labelled)


@query
def label_read_back(spark, sf_dir):
    """Result lines with several labels per key: the last one counts."""
    rows = D.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(
            F.lit("[RESULT]: "), F.col("o_custkey"), F.lit(", "),
            (F.col("o_orderstatus") == "F").cast("int"),
        ).alias("line"),
    )
    return files.read_labels(spark, D.written_lines(rows, "o_orderkey", "labels"), sink=True)


@query
def filtered_column(spark, sf_dir):
    return files.column_where(D.table(spark, sf_dir, "part"), "p_name", F.col("p_size") > 40)


@query
def profile_file(spark, sf_dir):
    """Scores written as CSV with a header, and read back."""
    path = D.scratch(spark, "profiles")
    files.write_profiles(L.lof_with_points(D.suppliers(spark, sf_dir), 3), path, 2)
    schema = "x1 double, x2 double, n int, kd double, lrd double, lof double"
    return rounded(spark.read.csv(path, header=True, schema=schema), "kd", "lrd", "lof")


@query
def expected_profile_file(spark, sf_dir):
    rows = D.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat_ws(
            " ", F.lit("p"), "s_acctbal", "s_nationkey", F.lit(":"),
            F.concat(F.lit("lof="), F.col("s_suppkey") / 4),
        ).alias("line"),
    )
    return files.expected_profiles(spark, D.written_lines(rows, "s_suppkey", "expected"))


@query
def run_parameters(spark, sf_dir):
    name = F.concat(
        F.lit("wilt-d5-rlof-k"), F.col("p_size"), F.lit("-euc-lsh-h2-t4-w"), F.col("p_partkey"),
        F.lit("-i10-a2000-"), F.col("p_size") * 7, F.lit("ms"),
    )
    found = evaluate.with_run_parameters(D.table(spark, sf_dir, "part").select(name.alias("run")))
    return found.select("run", "dims", "k", "hashes", "tables", "window", "inlier_percent", "max_age", "ms")


# --- evaluation -------------------------------------------------------------------------

def _scored_events(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select(
        F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label")
    )


@query
def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(_scored_events(spark, sf_dir)), "auc")


@query
def roc_curve(spark, sf_dir):
    return rounded(evaluate.roc_curve(_scored_events(spark, sf_dir)), "fpr", "tpr")


@query
def parameter_sweep(spark, sf_dir):
    scored = D.table(spark, sf_dir, "orders").select(
        F.ascii("o_orderpriority").alias("run"),
        F.col("o_totalprice").alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    return rounded(evaluate.sweep(scored, "run"), "auc")


@query
def label_agreement(spark, sf_dir):
    expected = D.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"))
    actual = D.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), (F.col("n_chars") > 2000).cast("int").alias("label")
    )
    both = evaluate.compare_labels(expected, actual)
    return both.groupBy("expected", "actual").agg(F.count("*").alias("n"))


@query
def neighbour_quality(spark, sf_dir):
    points = D.embeddings(spark, sf_dir)
    family = hashing.sign_family(D.PLANES)
    near = lsh.first_k(lsh.lsh_knn(points, 4, family), 4)
    exact = lsh.first_k(knn(points, 4), 4)
    rated = evaluate.neighbour_quality(near, exact, lsh.touched_pairs(points, family))
    return rounded(rated, "precision", "recall", "correct_pct", "touched_pct")


@query
def neighbour_quality_grid(spark, sf_dir):
    """All 36 cells: three families, three numbers of hashes, four numbers of tables."""
    projected, gridded, sided = (D.by_rule(16, h, 64, salt) for h, salt in ((8, 1), (8, 2), (64, 3)))
    offsets = np.arange(128).reshape(16, 8) * 37 % 100
    made = {
        "l2": hashing.projection_family(projected - 0.5, offsets, D.GRID_L2),
        "l1": hashing.grid_family(gridded * D.GRID_L1, D.GRID_L1),
        "cos": hashing.sign_family(sided - 0.5, "cosine", "cos"),
    }
    grid = lsh.quality_grid(D.embeddings(spark, sf_dir), 4, 64, made=made)
    return rounded(grid, "precision", "recall", "correct_pct", "touched_pct")


# --- locality-sensitive hashing ---------------------------------------------------------

@query
def lsh_planes(spark, sf_dir):
    return pairs(lsh.lsh_knn(D.embeddings(spark, sf_dir), K, hashing.sign_family(D.PLANES)))


@query
def lsh_cosine(spark, sf_dir):
    family = hashing.sign_family(D.GAUSSIAN, "cosine", "cos")
    return pairs(lsh.first_k(lsh.lsh_knn(D.embeddings(spark, sf_dir), 4, family), 4))


@query
def lsh_l2(spark, sf_dir):
    family = hashing.projection_family(D.PROJECTIONS, D.OFFSETS, D.WIDTH)
    return pairs(lsh.lsh_knn(sets.distinct_points(D.customers(spark, sf_dir)), K, family))


@query
def lsh_l1(spark, sf_dir):
    family = hashing.grid_family(D.SHIFTS, D.WIDTH)
    return pairs(lsh.lsh_knn(sets.distinct_points(D.customers(spark, sf_dir)), K, family))


@query
def lsh_own_family(spark, sf_dir):
    """Buckets by a user's own hashes: ranges of one coordinate per table."""
    steps = (500.0, 3.0)
    family = hashing.Family(
        "ranges", M.resolve("euclidean"), 2, lambda x, t: F.floor(x[t] / steps[t]).cast("string")
    )
    return pairs(lsh.lsh_knn(sets.distinct_points(D.customers(spark, sf_dir)), K, family))


@query
def lsh_with_probing(spark, sf_dir):
    family = hashing.sign_family(D.PROBES)
    found = lsh.lsh_knn(D.embeddings(spark, sf_dir), K, family, probe=True)
    return rounded(found.select("i", "n", "kd"), "kd")


def _probed_words(spark, sf_dir, bits):
    family = hashing.sign_family(D.by_rule(1, bits, 64, 4) - 0.5)
    found = lsh.lsh_knn(D.embeddings(spark, sf_dir), K, family, probe=True)
    return rounded(found.select("i", "n", "kd"), "kd")


@query
def lsh_probing_32_bits(spark, sf_dir):
    return _probed_words(spark, sf_dir, 32)


@query
def lsh_probing_64_bits(spark, sf_dir):
    return _probed_words(spark, sf_dir, 64)


@query
def bucket_members(spark, sf_dir):
    family = hashing.sign_family(D.FLAT_PLANES)
    found = lsh.bucket_neighbours(D.customers(spark, sf_dir), 4, family)
    return found.select("i", "word", F.explode("members").alias("member"))


@query
def bucket_width(spark, sf_dir):
    """The estimated bucket radius of the customers, from 30 sampled neighbours."""
    r = lsh.neighbour_radius(sets.distinct_points(D.customers(spark, sf_dir)), "euclidean")
    return D.customers(spark, sf_dir).agg(F.count("*").alias("points")).select(
        "points", F.round(F.lit(r), 6).alias("radius")
    )


# --- summarized areas -------------------------------------------------------------------

def _areas(spark, sf_dir):
    near = stage(knn(sets.distinct_points(D.customers(spark, sf_dir)), K), "near")
    where = sets.distinct_points(D.customers(spark, sf_dir))
    scored = near.select("i", "nbrs").join(L.profiles(near), "i").join(where, "i")
    scored = stage(scored, "scored")
    centers = L.top_inliers(scored, 5, scored.count())
    return stage(A.summarize(scored, centers, 0), "areas")


@query
def summarized_areas(spark, sf_dir):
    made = _areas(spark, sf_dir)
    return rounded(made.select("center", "radius", "number", "avg_kd", "avg_lrd"), "radius", "avg_kd", "avg_lrd")


@query
def area_members(spark, sf_dir):
    wide = _areas(spark, sf_dir).withColumn("radius", F.col("radius") * 10)
    shifted = D.suppliers(spark, sf_dir).withColumn("i", F.col("i") + 1_000_000_000_000)
    found = A.members(wide, shifted, "euclidean")
    return rounded(found.withColumn("i", F.col("i") - 1_000_000_000_000), "dist")


@query
def absorbed_areas(spark, sf_dir):
    """Areas after suppliers falling inside ten radii joined them with made-up profiles."""
    wide = stage(_areas(spark, sf_dir).withColumn("radius", F.col("radius") * 10), "wide")
    shifted = D.suppliers(spark, sf_dir).withColumn("i", F.col("i") + 1_000_000_000_000)
    joined = A.members(wide, shifted, "euclidean").withColumn("kd", F.col("dist")).withColumn("lrd", F.lit(0.5))
    after = A.absorb(wide, joined, 7)
    return rounded(after.drop("x"), "radius", "avg_kd", "avg_lrd")


@query
def cascading_delete(spark, sf_dir):
    """Neighbour lists after the customers of nation 3 are deleted, not refilled."""
    points = sets.distinct_points(D.customers(spark, sf_dir))
    near = stage(knn(points, K).join(points, "i"), "near")
    gone = points.filter(F.col("x")[1] == 3).select("i")
    return rounded(delete_rows(near, gone).select("i", "n", "kd"), "kd")


# --- streams ----------------------------------------------------------------------------

@query
def incremental_lof(spark, sf_dir):
    """Customers replayed as a stream in three batches; labels when all have been seen."""
    records = D.customer_records(spark, sf_dir)
    path, home = replay(records, 3), D.scratch(spark, "ilof")
    model = detector("ilof", spark, f"{home}/state", k=K)
    model.start(parsed(file_stream(spark, path), 2), f"{home}/checkpoint").awaitTermination()
    return model.labels(TOP)


@query
def incremental_lof_scores(spark, sf_dir):
    records = D.customer_records(spark, sf_dir)
    path, home = replay(records, 2), D.scratch(spark, "ilof")
    model = detector("ilof", spark, f"{home}/state", k=K)
    model.start(parsed(file_stream(spark, path), 2), f"{home}/checkpoint").awaitTermination()
    return rounded(model.scores().select("i", "n", "kd", "lrd", "lof"), "kd", "lrd", "lof")


def _stream_by(spark, sf_dir, technique, hashed=None):
    """Scores after two batches whose arrivals find their lists by ``technique``."""
    records = D.customer_records(spark, sf_dir)
    path, home = replay(records, 2), D.scratch(spark, "ilof")
    model = detector("ilof", spark, f"{home}/state", k=K, technique=technique, hashed=hashed)
    model.start(parsed(file_stream(spark, path), 2), f"{home}/checkpoint").awaitTermination()
    return rounded(model.scores().select("i", "n", "kd", "lrd", "lof"), "kd", "lrd", "lof")


@query
def incremental_kd(spark, sf_dir):
    return _stream_by(spark, sf_dir, "kd")


@query
def incremental_tables(spark, sf_dir):
    """Arrivals probe the stored buckets of two tables."""
    return _stream_by(spark, sf_dir, "tables", hashing.projection_family(D.PROJECTIONS, D.OFFSETS, D.WIDTH))


@query
def incremental_planes(spark, sf_dir):
    """Arrivals probe stored buckets of sides; those alone in theirs the nearest ones."""
    return _stream_by(spark, sf_dir, "planes", hashing.sign_family(D.STREAM_PLANES))


@query
def stream_profiles(spark, sf_dir):
    """What the stream knows of every point at the end, with its neighbours and their reach."""
    path, home = replay(D.customer_records(spark, sf_dir), 2), D.scratch(spark, "ilof")
    model = detector("ilof", spark, f"{home}/state", k=3)
    model.start(parsed(file_stream(spark, path), 2), f"{home}/checkpoint").awaitTermination()
    return rounded(model.profiles().drop("x"), "kd", "lrd", "lof", "dist", "reach")


def _windowed(spark, sf_dir, sink=None, trace=None):
    """Customers in three batches; what is taken in at a time depends on their order only."""
    records = D.customer_records(spark, sf_dir)
    rows = records.count()
    path, home = replay(records, 3), D.scratch(spark, "rlof")
    model = detector(
        "rlof", spark, f"{home}/state",
        k=K, window=rows // 2, inlier_percent=5, max_age=rows // 3, dims=2, top=TOP, step=rows // 3, trace=trace,
    )
    stream = parsed(file_stream(spark, path), 2)
    model.start(stream, f"{home}/checkpoint", sink, rows).awaitTermination()
    return model


@query
def windowed_lof(spark, sf_dir):
    return _windowed(spark, sf_dir).labels().groupBy("reason", "label").agg(F.count("*").alias("n"))


@query
def windowed_labels(spark, sf_dir):
    """What the stream's sink holds at the end: every arrival, its label and why it got it."""
    sink = D.scratch(spark, "rlof-sink")
    _windowed(spark, sf_dir, sink)
    return spark.read.parquet(sink).select("key", "label", "reason")


@query
def windowed_steps(spark, sf_dir):
    """The window and the areas after each group: profiles, virtual neighbours, clocks; and whom
    the group updated, among whom no virtual point may be."""
    trace = D.scratch(spark, "rlof-trace")
    _windowed(spark, sf_dir, D.scratch(spark, "rlof-sink"), trace)
    ids = F.transform("nbrs", lambda e: e["j"])
    points = spark.read.parquet(f"{trace}/window").select(
        "step", F.lit("point").alias("kind"), "i", "n", "ts", "kd", "lrd", "lof",
        F.size(F.filter(ids, lambda j: j < 0)).alias("n_virtual"),
        F.array_join(F.transform(F.array_sort(ids), lambda j: j.cast("string")), " ").alias("nbrs"),
    )
    areas = spark.read.parquet(f"{trace}/areas").select(
        "step", F.lit("area").alias("kind"), F.col("center").alias("i"), F.col("number").cast("int").alias("n"), "ts",
        F.col("radius").alias("kd"), F.col("avg_lrd").alias("lrd"), F.col("avg_kd").alias("lof"),
        F.lit(0).alias("n_virtual"), F.lit("").alias("nbrs"),
    )
    updates = spark.read.parquet(f"{trace}/updates").select("step", F.lit("update").alias("kind"), "i", F.lit(0).alias("n_virtual"), F.lit("").alias("nbrs"))
    return rounded(points.unionByName(areas).unionByName(updates, allowMissingColumns=True), "kd", "lrd", "lof")


# --- generators and audits --------------------------------------------------------------

@query
def planted_neighbours(spark, sf_dir):
    """Four perturbed copies of every embedding: all within the radius of their original."""
    grown = synth.with_neighbours(D.embeddings(spark, sf_dir), 4, 0.01, seed=3)
    origin = D.embeddings(spark, sf_dir).select(F.col("i").alias("o"), F.col("x").alias("y"))
    moved = grown.withColumn("o", F.floor(F.col("i") / 5)).join(origin, "o")
    off = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))
    return moved.groupBy("o").agg(
        F.count("*").alias("copies"), F.max((off <= 0.01).cast("int")).alias("inside"),
        F.min((off <= 0.01).cast("int")).alias("all_inside"),
    )


@query
def random_vectors(spark, sf_dir):
    """As many random vectors as there are embeddings, measured."""
    rows = D.embeddings(spark, sf_dir).count()
    drawn = synth.random_vectors(spark, rows, 16, 512, seed=5)
    return drawn.select(
        F.size("x").alias("dims"), F.array_min("x").alias("low"), F.array_max("x").alias("high")
    ).agg(
        F.count("*").alias("n"), F.min("dims").alias("dims"),
        (F.min("low") >= 0).cast("int").alias("floor_ok"), (F.max("high") < 512).cast("int").alias("top_ok"),
    )


@query
def profile_audit(spark, sf_dir):
    near = stage(knn(sets.distinct_points(D.parts(spark, sf_dir)), K), "near")
    return audit.profile_checks(near, K)


@query
def deletion_audit(spark, sf_dir):
    points = sets.distinct_points(D.customers(spark, sf_dir))
    near = stage(knn(points, K).join(points, "i"), "near")
    gone = points.filter(F.col("x")[1] == 3).select("i")
    return audit.deletion_checks(delete_rows(near, gone), gone)


@query
def area_audit(spark, sf_dir):
    return audit.area_checks(_areas(spark, sf_dir), 2)
