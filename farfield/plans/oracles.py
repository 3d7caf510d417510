"""ANSI SQL with the meaning of each registered query, for checking on whole tables."""

from __future__ import annotations

from farfield.functions.text import NUMBER
from farfield.plans import tables as D
from farfield.plans.hash_sql import grid, probing
from farfield.plans.stream_sql import two_batches
from farfield.plans.window_sql import window_steps

K, TOP = D.K, D.TOP

CUSTOMERS = "SELECT min(c_custkey) i, c_acctbal x1, c_nationkey::DOUBLE x2 FROM customer GROUP BY 2, 3"
SUPPLIERS = "SELECT min(s_suppkey) i, s_acctbal x1, s_nationkey::DOUBLE x2 FROM supplier GROUP BY 2, 3"
PARTS = "SELECT min(p_partkey) i, p_size::DOUBLE x1, p_retailprice x2 FROM part GROUP BY 2, 3"
RECORDS = 'SELECT c_custkey::VARCHAR "key", c_custkey i, c_acctbal x1, c_nationkey::DOUBLE x2 FROM customer'
EMBEDDINGS = "SELECT vec_id i, embedding::DOUBLE[] x FROM embeddings"

L2 = "sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))"
L1 = "abs(a.x1 - b.x1) + abs(a.x2 - b.x2)"
LIST_L2 = "list_distance(a.x, b.x)"
LIST_COS = "list_cosine_distance(a.x, b.x)"


def neighbours(points: str, k: int, dist: str = L2, order: str = "rank() OVER (PARTITION BY i ORDER BY dist)") -> str:
    """CTEs ``pts`` and ``nn(i, j, dist)``."""
    return f"""pts AS MATERIALIZED ({points}),
    nn AS MATERIALIZED (SELECT i, j, dist FROM (
        SELECT *, {order} rk FROM (
            SELECT a.i, b.i j, {dist} dist FROM pts a JOIN pts b ON a.i <> b.i) d) r
        WHERE rk <= {k})"""


FIRST = "row_number() OVER (PARTITION BY i ORDER BY dist, j)"

FACTORS = """kds AS MATERIALIZED (SELECT i, max(dist) kd, count(*) n FROM nn GROUP BY i),
    lrds AS MATERIALIZED (SELECT nn.i, count(*) / sum(greatest(kds.kd, nn.dist)) lrd
        FROM nn JOIN kds ON kds.i = nn.j GROUP BY nn.i),
    lofs AS MATERIALIZED (SELECT nn.i, sum(o.lrd) / (any_value(m.lrd) * count(*)) lof
        FROM nn JOIN lrds o ON o.i = nn.j JOIN lrds m ON m.i = nn.i GROUP BY nn.i),
    scored AS MATERIALIZED (SELECT i, coalesce(n, 0)::INTEGER n, coalesce(kd, 'inf'::DOUBLE) kd,
            coalesce(lrd, 'inf'::DOUBLE) lrd, coalesce(lof, 'nan'::DOUBLE) lof
        FROM pts LEFT JOIN kds USING (i) LEFT JOIN lrds USING (i) LEFT JOIN lofs USING (i))"""


def factors(points: str, k: int, dist: str = L2) -> str:
    return f"WITH {neighbours(points, k, dist)}, {FACTORS}"


PAIRS = "SELECT i, j, round(dist, 6) dist FROM nn"
FLAGGED = f"top AS (SELECT i FROM scored ORDER BY lof DESC, i LIMIT {TOP})"


def vector(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def sign_buckets(planes) -> str:
    """CTE ``buckets(i, t, w)`` over list points: one word of sides per table."""
    parts = []
    for t, normals in enumerate(planes):
        word = " || ".join(f"CASE WHEN list_dot_product(x, {vector(g)}) > 0 THEN '1' ELSE '0' END" for g in normals)
        parts.append(f"SELECT i, x, {t} t, {word} w FROM pts")
    return "buckets AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def flat_buckets(signature) -> str:
    return "buckets AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT i, x1, x2, {t} t, {signature(t)} w FROM pts" for t in range(2)
    ) + ")"


def projected(t: int) -> str:
    steps = [
        f"floor((x1 * {float(g[0])!r} + x2 * {float(g[1])!r} + {o}) / {D.WIDTH} + 0.5)::BIGINT::VARCHAR"
        for g, o in zip(D.PROJECTIONS[t], D.OFFSETS[t])
    ]
    return " || ',' || ".join(steps)


def gridded(t: int) -> str:
    u = D.SHIFTS[t][0]
    return " || ',' || ".join(
        f"floor((x{d + 1} - {float(u[d])!r}) / {D.WIDTH})::BIGINT::VARCHAR" for d in range(2)
    )


def bucketed(points: str, buckets: str, k: int, dist: str, self_too: bool = False, order: str | None = None) -> str:
    """CTEs for neighbours among points that share a bucket."""
    rank = order or "rank() OVER (PARTITION BY i ORDER BY dist)"
    skip = "" if self_too else "AND a.i <> b.i"
    return f"""pts AS MATERIALIZED ({points}), {buckets},
    cand AS MATERIALIZED (SELECT DISTINCT a.i, b.i j, {dist} dist FROM buckets a JOIN buckets b
        ON a.t = b.t AND a.w = b.w {skip}),
    nn AS MATERIALIZED (SELECT i, j, dist FROM (SELECT *, {rank} rk FROM cand) r WHERE rk <= {k})"""


def hash_of(word: str) -> str:
    folded = (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({word}, ''), "
        "lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"
    )
    return f"CASE WHEN {word} = '' THEN 0 ELSE (({folded}) + 2147483648) % 4294967296 - 2147483648 END::DOUBLE"


def number_or_hash(word: str) -> str:
    return (
        f"CASE WHEN regexp_matches({word}, '{NUMBER}') "
        f"THEN try_cast(regexp_replace({word}, '[fd]$', '') AS DOUBLE) ELSE {hash_of(word)} END"
    )


SUMMARIZED = f"""{factors(CUSTOMERS, K)},
    centers AS (SELECT i FROM scored ORDER BY lof, i
        LIMIT (SELECT ceil(count(*) * 5 / 100.0)::BIGINT FROM scored)),
    areas AS MATERIALIZED (SELECT c.i center, any_value(p.x1) x1, any_value(p.x2) x2, any_value(s.kd) radius,
            count(*) + 1 number, avg(o.kd) avg_kd, avg(o.lrd) avg_lrd
        FROM centers c JOIN scored s ON s.i = c.i JOIN pts p ON p.i = c.i
        JOIN nn ON nn.i = c.i JOIN scored o ON o.i = nn.j GROUP BY c.i),
    inside AS MATERIALIZED (SELECT a.center, b.i, a.number, a.avg_kd, a.avg_lrd, {L2} dist
        FROM areas a JOIN (SELECT s_suppkey i, s_acctbal x1, s_nationkey::DOUBLE x2 FROM supplier) b
        ON {L2} <= a.radius * 10)"""

EVENTS = "ev AS (SELECT value score, (event_type = 'error')::INTEGER label FROM events)"

QUALITY = """near AS (SELECT i, list(j ORDER BY dist, j) a FROM near_pairs GROUP BY i),
    exact AS (SELECT i, list(j ORDER BY dist, j) e FROM exact_pairs GROUP BY i),
    paired AS (SELECT i, coalesce(a, []::BIGINT[]) a, coalesce(e, []::BIGINT[]) e
        FROM near FULL JOIN exact USING (i)),
    sums AS (SELECT count(*) queries, sum(len(list_intersect(a, e)))::BIGINT tp,
        sum(len(a) - len(list_intersect(a, e)))::BIGINT fp, sum(len(e) - len(list_intersect(a, e)))::BIGINT fn,
        sum((a[1:least(len(a), len(e))] = e[1:least(len(a), len(e))])::INTEGER)::BIGINT correct FROM paired)"""

PERCENT = """round(tp * 100.0 / (tp + fp), 6)::DOUBLE "precision", round(tp * 100.0 / (tp + fn), 6)::DOUBLE recall,
    round(correct * 100.0 / queries, 6)::DOUBLE correct_pct"""


def counted(name: str, rows: str, violated: str) -> str:
    return (
        f"SELECT '{name}' \"check\", count(*) checked, coalesce(sum(({violated})::BIGINT), 0)::BIGINT violations "
        f"FROM {rows}"
    )


def oracles() -> dict[str, str]:
    sql = {}

    # local outlier factors
    scores = "round(kd, 6) kd, round(lrd, 6) lrd, round(lof, 6) lof"
    sql["lof_top_n"] = f"""{factors(CUSTOMERS, K)}
        SELECT i, n, round(kd, 6) kd, round(lof, 6) lof FROM scored ORDER BY scored.lof DESC, i LIMIT {TOP}"""
    sql["lof_scores"] = f"{factors(CUSTOMERS, K)} SELECT i, n, {scores} FROM scored"
    sql["lof_with_copies"] = f"""{factors(PARTS, K)}
        SELECT p.p_partkey i, n, round(kd, 6) kd, round(lof, 6) lof FROM scored JOIN pts USING (i)
        JOIN part p ON p.p_size = pts.x1 AND p.p_retailprice = pts.x2"""
    sql["lof_manhattan"] = f"{factors(SUPPLIERS, 3, L1)} SELECT i, n, {scores} FROM scored"
    sql["lof_exactly_k"] = f"""WITH {neighbours(PARTS, K, order=FIRST)}, {FACTORS}
        SELECT i, n, {scores} FROM scored"""
    sql["lof_in_buckets"] = f"""WITH {bucketed(CUSTOMERS, flat_buckets(projected), K, L2, order=FIRST)}, {FACTORS}
        SELECT i, n, {scores} FROM scored"""
    sql["lof_labels"] = f"""{factors(CUSTOMERS, K)}, {FLAGGED}
        SELECT i, (i IN (SELECT i FROM top))::INTEGER label FROM scored"""
    sql["top_inliers"] = f"""{factors(CUSTOMERS, K)} SELECT i, round(lof, 6) lof FROM (
        SELECT * FROM scored ORDER BY lof, i LIMIT (SELECT ceil(count(*) * 5 / 100.0)::BIGINT FROM scored)) t"""
    sql["k_distances"] = f"""WITH {neighbours(PARTS, K)}
        SELECT i, round(max(dist), 6) kd, count(*)::INTEGER n FROM nn GROUP BY i"""
    sql["reach_distances"] = f"""WITH {neighbours(CUSTOMERS, K)}, {FACTORS}
        SELECT nn.i, nn.j, round(greatest(kds.kd, nn.dist), 6) reach FROM nn JOIN kds ON kds.i = nn.j"""

    # neighbours
    sql["knn_with_ties"] = f"WITH {neighbours(PARTS, K)} {PAIRS}"
    sql["knn_exactly_k"] = f"WITH {neighbours(PARTS, K, order=FIRST)} {PAIRS}"
    sql["nearest_one"] = f"WITH {neighbours(CUSTOMERS, 1, order=FIRST)} {PAIRS}"
    sql["knn_cosine"] = f"WITH {neighbours(EMBEDDINGS, 4, LIST_COS)} {PAIRS}"
    largest = "greatest(abs(a.x1 - b.x1), abs(a.x2 - b.x2))"
    sql["knn_own_measure"] = f"WITH {neighbours(SUPPLIERS, 3, largest)} {PAIRS}"
    sql["linear_top_k"] = f"""WITH d AS (SELECT a.s_suppkey q, b.c_custkey j,
            sqrt((a.s_acctbal - b.c_acctbal) * (a.s_acctbal - b.c_acctbal)
                + (a.s_nationkey - b.c_nationkey)::DOUBLE * (a.s_nationkey - b.c_nationkey)) dist
            FROM supplier a CROSS JOIN customer b),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, j) place FROM d)
        SELECT q, place::INTEGER place, j, round(sum(dist) OVER (PARTITION BY q), 6) total FROM r WHERE place <= 4"""
    sql["reverse_neighbours"] = f"""WITH {neighbours(CUSTOMERS, K)}
        SELECT j, count(*) listed_by, min(i) first_lister FROM nn GROUP BY j"""
    (l1, l2), (h1, h2) = D.BOX_LOW, D.BOX_HIGH
    sql["box_search"] = f"""SELECT p_partkey i, p_size::DOUBLE x1, p_retailprice x2 FROM part
        WHERE p_size BETWEEN {l1} AND {h1} AND p_retailprice BETWEEN {l2} AND {h2}"""
    sql["box_join"] = """SELECT s_suppkey box, c_custkey i FROM supplier JOIN customer
        ON c_acctbal BETWEEN s_acctbal - 50 AND s_acctbal + 50
        AND c_nationkey BETWEEN s_nationkey - 2 AND s_nationkey + 2"""
    sql["exact_lookup"] = """SELECT p_partkey q, min(p_partkey) OVER (PARTITION BY p_size, p_retailprice) i
        FROM part"""
    sql["delete_points"] = """SELECT p_partkey i FROM part p WHERE NOT EXISTS (SELECT 1 FROM part g
        WHERE g.p_brand = 'Brand#2' AND g.p_size = p.p_size AND g.p_retailprice = p.p_retailprice)"""
    sql["add_points"] = """SELECT coalesce(min(p_partkey) FILTER (WHERE p_brand = 'Brand#2'), min(p_partkey)) seq,
        p_size::DOUBLE x1, p_retailprice x2 FROM part GROUP BY 2, 3"""
    sql["first_arrivals"] = "SELECT min(p_partkey) seq, p_size::DOUBLE x1, p_retailprice x2 FROM part GROUP BY 2, 3"
    sql["union_distinct"] = """SELECT c_nationkey::DOUBLE nation FROM customer
        UNION SELECT s_nationkey::DOUBLE FROM supplier"""
    sql["set_difference"] = """SELECT c_custkey i FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""
    exact = f"WITH {neighbours(CUSTOMERS, K)}, {FACTORS}"
    near = bucketed(CUSTOMERS, flat_buckets(projected), K, L2)
    sql["profile_difference"] = f"""WITH e AS MATERIALIZED ({exact} SELECT i, lof expected FROM scored),
        r AS MATERIALIZED (WITH {near}, {FACTORS} SELECT i, lof received FROM scored)
        SELECT i, round(received, 6) received, round(expected, 6) expected FROM r FULL JOIN e USING (i)
        WHERE NOT coalesce(abs(received - expected) <= 0.01, false)"""

    # distances
    up = "list_transform({0}, lambda e: e + 1)"
    x1, y1 = up.format("a.x"), up.format("b.x")
    least = f"list_sum(list_transform(list_zip({x1}, {y1}), lambda z: least(z[1], z[2])))"
    gaps = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])))"
    sql["vector_distances"] = f"""WITH e AS ({EMBEDDINGS}) SELECT a.i, round({LIST_L2}, 6) euclidean,
        round({LIST_L2} * {LIST_L2}, 6) squared, round({gaps}, 6) manhattan, round({LIST_COS}, 6) cosine,
        round(1 - {least} / greatest(list_sum({x1}), list_sum({y1})), 6) "intersect",
        round(list_dot_product(a.x, b.x), 6) dot, round({LIST_L2}, 6) by_name
        FROM e a JOIN e b ON b.i = a.i + 1"""
    sql["hamming_distances"] = """SELECT a.c_custkey, bit_count(xor(a.c_custkey, a.c_custkey + 1))::INTEGER bits,
        hamming(a.c_name, b.c_name)::INTEGER letters FROM customer a JOIN customer b
        ON b.c_custkey = a.c_custkey + 1"""
    sql["ml_vector_round_trip"] = """SELECT vec_id i, len(embedding)::INTEGER dims,
        round(list_sum(embedding::DOUBLE[]), 6) total FROM embeddings"""
    sql["virtual_point_distances"] = """WITH met AS (SELECT DISTINCT l_suppkey, o_custkey
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        d AS (SELECT s_suppkey center, s_acctbal, s_nationkey, abs(c_acctbal - s_acctbal) g1,
                abs(c_nationkey - s_nationkey)::DOUBLE g2
            FROM met JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey),
        e AS (SELECT *, sqrt(g1 * g1 + g2 * g2) d2, g1 + g2 d1 FROM d),
        v AS (SELECT *, unnest([0, 0, 1, 1]) axis, unnest([0, 1, 0, 1]) side FROM e)
        SELECT center, axis, side,
            round(any_value(s_acctbal + CASE WHEN axis = 0 THEN 100 * (1 - 2 * side) ELSE 0 END), 6) v1,
            round(any_value(s_nationkey + CASE WHEN axis = 1 THEN 100 * (1 - 2 * side) ELSE 0 END), 6)::DOUBLE v2,
            round(min(CASE WHEN axis > 0 THEN sqrt(d2 * d2 + 10000) WHEN side = 0 THEN d2 - 100 ELSE d2 + 100 END), 6) nearest_l2,
            round(max(CASE WHEN axis = 0 AND side = 0 THEN d1 - 100 ELSE d1 + 100 END), 6) farthest_l1
        FROM v GROUP BY center, axis, side"""

    # text and files
    sql["parsed_words"] = f"""WITH w AS (SELECT p_partkey, string_split(lower(p_size || ' ' || p_brand || ' ' || p_type), ' ') w
        FROM part) SELECT p_partkey, len(w)::INTEGER words, {number_or_hash('w[1]')} x0,
        {number_or_hash('w[2]')} x1, {number_or_hash('w[3]')} x2 FROM w"""
    sql["parsed_documents"] = f"""WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]', ' ', 'g'), ' +$', '') l FROM documents),
        w AS (SELECT doc_id, unnest(string_split(l, ' ')) w FROM l)
        SELECT doc_id, count(*)::INTEGER words, round(sum({number_or_hash('w')}), 3) checksum FROM w GROUP BY doc_id"""
    sql["keyed_scan"] = """SELECT c_custkey::VARCHAR "key", c_acctbal x1, c_nationkey::DOUBLE x2,
        CASE WHEN c_nationkey <> 0 THEN (c_mktsegment = 'BUILDING')::INTEGER END label FROM customer"""
    sql["assigned_keys"] = """SELECT k "key", k || ' ' || p_partkey || ' ' || p_size || ' ' || p_brand line FROM (
        SELECT *, row_number() OVER (ORDER BY p_partkey) k FROM part) t"""
    sql["vector_scan"] = """SELECT row_number() OVER (ORDER BY p_partkey) - 1 pos, p_brand "key",
        p_size::DOUBLE x1, p_partkey::DOUBLE x2 FROM part"""
    sql["first_vectors"] = """SELECT * FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 pos, p_brand "key",
        p_size::DOUBLE x1, p_retailprice x2 FROM part) t WHERE pos < 100"""
    sql["appended_lines"] = """SELECT o_orderkey || ', ' || o_orderstatus line FROM orders
        WHERE o_orderstatus IN ('F', 'O')"""
    sql["expected_outlier_file"] = "SELECT DISTINCT c_nationkey::DOUBLE x, floor(c_acctbal)::DOUBLE y FROM customer"
    sql["classed_scan"] = """SELECT c_mktsegment "class", count(*) n, round(max(c_acctbal), 6) most,
        max(c_nationkey)::DOUBLE nation FROM customer GROUP BY 1"""
    sql["relabelled_classes"] = """SELECT (l_returnflag = 'R')::INTEGER label, count(*) n, count(*) "keys",
        43 words FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY 1"""
    sql["label_counts"] = "SELECT (event_type = 'error')::INTEGER label, count(*) n FROM events GROUP BY 1"
    sql["label_read_back"] = """SELECT o_custkey::VARCHAR "key", arg_max((o_orderstatus = 'F')::INTEGER, o_orderkey) label
        FROM orders GROUP BY o_custkey"""
    sql["filtered_column"] = "SELECT p_name FROM part WHERE p_size > 40"
    sql["profile_file"] = f"""{factors(SUPPLIERS, 3)} SELECT s_acctbal x1, s_nationkey::DOUBLE x2, n, {scores}
        FROM scored JOIN pts USING (i) JOIN supplier ON s_acctbal = x1 AND s_nationkey = x2"""
    sql["expected_profile_file"] = "SELECT s_acctbal x, s_nationkey::DOUBLE y, s_suppkey / 4.0 lof FROM supplier"
    sql["expected_profile_file"] = sql["expected_profile_file"].replace("/ 4.0", "/ 4::DOUBLE")
    sql["run_parameters"] = """SELECT 'wilt-d5-rlof-k' || p_size || '-euc-lsh-h2-t4-w' || p_partkey || '-i10-a2000-'
            || p_size * 7 || 'ms' run, 5 dims, p_size k, 2 hashes, 4 tables, p_partkey::INTEGER "window",
        10 inlier_percent, 2000 max_age, (p_size * 7)::BIGINT ms FROM part"""

    # evaluation
    area = """sum(neg::DOUBLE * (before + pos / 2.0)) / (sum(pos)::DOUBLE * sum(neg))"""
    steps = """SELECT {0} score, sum(label) pos, sum(1 - label) neg FROM {1} GROUP BY {0} score"""
    sql["roc_auc"] = f"""WITH {EVENTS}, s AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM ({steps.format('', 'ev')}) g)
        SELECT round({area}, 6) auc FROM s"""
    sql["roc_curve"] = f"""WITH {EVENTS}, s AS (SELECT score, sum(pos) OVER w tp, sum(neg) OVER w fp
            FROM ({steps.format('', 'ev')}) g WINDOW w AS (ORDER BY score DESC)),
        e AS (SELECT max(tp) p, max(fp) n FROM s)
        SELECT score, round(fp::DOUBLE / n, 6) fpr, round(tp::DOUBLE / p, 6) tpr FROM s CROSS JOIN e
        UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE"""
    sql["parameter_sweep"] = f"""WITH o AS (SELECT ascii(o_orderpriority) run, o_totalprice score,
            (o_orderstatus = 'F')::INTEGER label FROM orders),
        s AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY run ORDER BY score DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM ({steps.format('run,', 'o')}) g),
        a AS (SELECT run, {area} auc FROM s GROUP BY run)
        SELECT run, round(auc, 6) auc, run = (SELECT run FROM a ORDER BY auc DESC, run LIMIT 1) chosen FROM a"""
    sql["label_agreement"] = """SELECT toxic expected, (n_chars > 2000)::INTEGER actual, count(*) n
        FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"""
    planes = sign_buckets(D.PLANES)
    sql["neighbour_quality"] = f"""WITH {bucketed(EMBEDDINGS, planes, 4, LIST_L2, order=FIRST)},
        near_pairs AS (SELECT * FROM nn),
        exact_pairs AS (SELECT i, j, dist FROM (SELECT *, {FIRST} rk FROM (
            SELECT a.i, b.i j, {LIST_L2} dist FROM pts a JOIN pts b ON a.i <> b.i) d) r WHERE rk <= 4),
        {QUALITY},
        seen AS (SELECT count(*) pairs FROM (SELECT DISTINCT a.i, b.i j FROM buckets a JOIN buckets b
            ON a.t = b.t AND a.w = b.w) q)
        SELECT queries, tp, fp, fn, {PERCENT},
            round(pairs * 100.0 / (queries::DOUBLE * queries), 6) touched_pct FROM sums CROSS JOIN seen"""

    sql["neighbour_quality_grid"] = grid(EMBEDDINGS, 4)

    # locality-sensitive hashing
    sql["lsh_planes"] = f"WITH {bucketed(EMBEDDINGS, planes, K, LIST_L2)} {PAIRS}"
    sql["lsh_cosine"] = f"""WITH {bucketed(EMBEDDINGS, sign_buckets(D.GAUSSIAN), 4, LIST_COS, order=FIRST)} {PAIRS}"""
    sql["lsh_l2"] = f"WITH {bucketed(CUSTOMERS, flat_buckets(projected), K, L2)} {PAIRS}"
    sql["lsh_l1"] = f"WITH {bucketed(CUSTOMERS, flat_buckets(gridded), K, L1)} {PAIRS}"
    ranges = lambda t: f"floor({('x1 / 500', 'x2 / 3')[t]})::BIGINT::VARCHAR"
    sql["lsh_own_family"] = f"WITH {bucketed(CUSTOMERS, flat_buckets(ranges), K, L2)} {PAIRS}"
    word = " + ".join(
        f"CASE WHEN c_acctbal * {float(g[0])!r} + c_nationkey * {float(g[1])!r} > 0 THEN {1 << (5 - p)} ELSE 0 END"
        for p, g in enumerate(D.FLAT_PLANES[0])
    )
    sql["bucket_members"] = f"""WITH b AS (SELECT c_custkey i, ({word})::BIGINT word FROM customer),
        m AS (SELECT word, i member, row_number() OVER (PARTITION BY word ORDER BY i) place FROM b)
        SELECT b.i, b.word, m.member FROM b JOIN m ON m.word = b.word AND m.place <= 4"""

    sides = " + ".join(
        f"CASE WHEN list_dot_product(x, {vector(g)}) > 0 THEN {1 << (len(D.PROBES[0]) - 1 - p)} ELSE 0 END"
        for p, g in enumerate(D.PROBES[0])
    )
    sql["lsh_with_probing"] = f"""WITH pts AS MATERIALIZED ({EMBEDDINGS}),
        b AS MATERIALIZED (SELECT i, x, ({sides})::BIGINT w FROM pts),
        sizes AS (SELECT w, count(*) size FROM b GROUP BY w),
        lonely AS (SELECT b.i, b.x, b.w FROM b JOIN sizes s ON s.w = b.w AND s.size = 1),
        reach AS (SELECT l.i, l.x, s.w, sum(s.size) OVER (PARTITION BY l.i ORDER BY bit_count(xor(l.w, s.w)), s.w
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before
            FROM lonely l JOIN sizes s ON s.w <> l.w),
        asked AS (SELECT i, x, w FROM b UNION ALL SELECT i, x, w FROM reach WHERE coalesce(before, 0) < {K}),
        cand AS (SELECT a.i, b.i j, {LIST_L2} dist FROM asked a JOIN b ON b.w = a.w AND b.i <> a.i),
        nn AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY i ORDER BY dist) rk FROM cand) r WHERE rk <= {K})
        SELECT i, count(*)::INTEGER n, round(max(dist), 6) kd FROM nn GROUP BY i"""
    for bits in (32, 64):
        sql[f"lsh_probing_{bits}_bits"] = probing(EMBEDDINGS, bits, K)
    sql["bucket_width"] = f"""WITH pts AS MATERIALIZED ({CUSTOMERS}),
        ask AS (SELECT * FROM pts ORDER BY (i % 2147483648 * 2654435761) % 4294967296, i LIMIT 30),
        d AS (SELECT a.i, min({L2}) dist FROM ask a JOIN pts b ON a.i <> b.i GROUP BY a.i)
        SELECT (SELECT count(*) FROM customer) points, round(0.9 * avg(dist), 6) radius FROM d"""

    # summarized areas
    sql["summarized_areas"] = f"""{SUMMARIZED} SELECT center, round(radius, 6) radius, number,
        round(avg_kd, 6) avg_kd, round(avg_lrd, 6) avg_lrd FROM areas"""
    sql["area_members"] = f"{SUMMARIZED} SELECT center, i, round(dist, 6) dist FROM inside"
    sql["absorbed_areas"] = f"""{SUMMARIZED}, taken AS (SELECT center, count(*) more, sum(dist) kds,
            sum(0.5::DOUBLE) lrds, min(dist) closest FROM inside GROUP BY center)
        SELECT a.center, round(coalesce(closest, radius * 10), 6) radius, number + coalesce(more, 0) number,
            round((avg_kd * number + coalesce(kds, 0)) / (number + coalesce(more, 0)), 6) avg_kd,
            round((avg_lrd * number + coalesce(lrds, 0)) / (number + coalesce(more, 0)), 6) avg_lrd,
            CASE WHEN more IS NULL THEN 0 ELSE 7 END::BIGINT ts
        FROM areas a LEFT JOIN taken t ON t.center = a.center"""
    sql["cascading_delete"] = f"""WITH {neighbours(CUSTOMERS, K)}, {FACTORS}
        SELECT kds.i, (count(q.i) FILTER (WHERE q.x2 <> 3))::INTEGER n, round(any_value(kd), 6) kd
        FROM kds JOIN pts p ON p.i = kds.i JOIN nn ON nn.i = kds.i JOIN pts q ON q.i = nn.j
        WHERE p.x2 <> 3 GROUP BY kds.i"""

    # streams: what they hold at the end equals the batch result
    sql["stream_profiles"] = f"""{factors(CUSTOMERS, 3)}
        SELECT scored.i, scored.n, {scores.replace('(kd', '(scored.kd')}, j, round(dist, 6) dist, round(greatest(o.kd, dist), 6) reach
        FROM scored LEFT JOIN nn USING (i) LEFT JOIN kds o ON o.i = nn.j"""
    sql["incremental_lof"] = f"""{factors(CUSTOMERS, K)}, {FLAGGED}
        SELECT c_custkey::VARCHAR "key", (pts.i IN (SELECT i FROM top))::INTEGER label
        FROM pts JOIN customer ON c_acctbal = x1 AND c_nationkey = x2"""
    sql["incremental_lof_scores"] = sql["lof_scores"]
    alike = "buckets AS MATERIALIZED (SELECT *, 0 t, '' w FROM pts)"
    sides = " || ".join(
        f"CASE WHEN x1 * {float(g[0])!r} + x2 * {float(g[1])!r} > 0 THEN '1' ELSE '0' END" for g in D.STREAM_PLANES[0]
    )
    words = f"buckets AS MATERIALIZED (SELECT *, 0 t, {sides} w FROM pts)"
    ties = "rank() OVER (PARTITION BY i ORDER BY dist)"
    sql["incremental_kd"] = two_batches(CUSTOMERS, alike, L2, K, FIRST)
    sql["incremental_tables"] = two_batches(CUSTOMERS, flat_buckets(projected), L2, K, FIRST)
    sql["incremental_planes"] = two_batches(CUSTOMERS, words, L2, K, ties, probe=True)
    windowed = "WITH RECURSIVE " + window_steps(RECORDS, K, "c // 2", 5, "c // 3", TOP, "c // 3")
    sql["windowed_labels"] = f'{windowed} SELECT "key", label, reason FROM labelled'
    sql["windowed_lof"] = f"{windowed} SELECT reason, label, count(*) n FROM labelled GROUP BY ALL"
    sql["windowed_steps"] = f"""{windowed}
        SELECT step, 'point' kind, i, len(nbrs)::INTEGER n, ts, {scores},
            len(list_filter(nbrs, lambda e: e.j < 0))::INTEGER n_virtual,
            coalesce(array_to_string(list_sort(list_transform(nbrs, lambda e: e.j)), ' '), '') nbrs
        FROM window_points
        UNION ALL
        SELECT step, 'area', center, number::INTEGER, ts, round(radius, 6), round(avg_lrd, 6), round(avg_kd, 6), 0, ''
        FROM window_areas
        UNION ALL
        SELECT step, 'update', unnest(updated), NULL, NULL, NULL, NULL, NULL, 0, '' FROM steps"""

    # generators and audits
    sql["planted_neighbours"] = 'SELECT vec_id o, 5::BIGINT copies, 1 "inside", 1 all_inside FROM embeddings'
    sql["random_vectors"] = "SELECT count(*) n, 16 dims, 1 floor_ok, 1 top_ok FROM embeddings"
    sql["profile_audit"] = f"WITH {neighbours(PARTS, K)}, {FACTORS}," + f"""
        near AS (SELECT kds.i, any_value(kd) kd, count(*) n, sum((dist < kd)::INTEGER) closer FROM nn
            JOIN kds ON kds.i = nn.i GROUP BY kds.i)
        {counted('at least k neighbours', 'near', f'n < {K}')}
        UNION ALL {counted('fewer than k closer than kd', 'near', f'closer > {K - 1}')}
        UNION ALL {counted('all neighbours within kd', 'near', 'false')}
        UNION ALL {counted('sorted ascending', 'near', 'false')}
        UNION ALL {counted('self not a neighbour', 'near', 'i IN (SELECT i FROM nn WHERE i = j)')}
        UNION ALL {counted('valid reach distance', 'nn', 'dist < 0')}"""
    sql["deletion_audit"] = f"""WITH {neighbours(CUSTOMERS, K)},
        l AS (SELECT i FROM pts WHERE x2 <> 3),
        e AS (SELECT nn.i FROM nn JOIN l ON l.i = nn.i JOIN l m ON m.i = nn.j)
        {counted('not a point', 'l', 'false')} UNION ALL {counted('not a neighbour', 'e', 'false')}"""
    sql["area_audit"] = f"""{SUMMARIZED}
        {counted('unique centre', 'areas', 'center IN (SELECT center FROM areas GROUP BY 1 HAVING count(*) > 1)')}
        UNION ALL {counted('real centre', 'areas', 'center < 0')}
        UNION ALL {counted('two virtual points per axis', 'areas', 'false')}"""
    return sql
