"""SQL for hash families whose parameters follow ``tables.by_rule``, on vectors of 64 coordinates."""

from __future__ import annotations

from farfield.plans import tables as D


def rule(n: str, salt: int) -> str:
    """The ``n``-th number of ``tables.by_rule``."""
    return f"((({n}) * ({n}) % 10007 * 7919 + ({n}) * 104729 + {salt * 15485863}) % 10007)::DOUBLE / 10007::DOUBLE"


def rows_of(tables: int, hashes: int, salt: int, number: str) -> str:
    """``t, h, g``: a list of 64 numbers per table and hash; ``number`` makes one of ``{{}}``, the rule's."""
    made = number.format(rule(f"(t * {hashes} + h) * 64 + d", salt))
    return f"""SELECT t, h, list_transform(range(64), lambda d: {made}) g
        FROM (SELECT unnest(range({tables})) t), (SELECT unnest(range({hashes})) h)"""


def probing(points: str, bits: int, k: int) -> str:
    """Neighbours in own buckets, or for points alone in theirs in the nearest that hold ``k`` points."""
    return f"""WITH pts AS MATERIALIZED ({points}), planes AS MATERIALIZED ({rows_of(1, bits, 4, "{} - 0.5")}),
        b AS MATERIALIZED (SELECT i, any_value(x) x,
            string_agg(CASE WHEN list_dot_product(x, g) > 0 THEN '1' ELSE '0' END, '' ORDER BY h) w
            FROM pts, planes GROUP BY i),
        sizes AS MATERIALIZED (SELECT w, count(*) size FROM b GROUP BY w),
        lonely AS (SELECT b.i, b.x, b.w FROM b JOIN sizes s ON s.w = b.w AND s.size = 1),
        reach AS (SELECT l.i, l.x, s.w, sum(s.size) OVER (PARTITION BY l.i ORDER BY bit_count(xor(l.w::BIT, s.w::BIT)), s.w
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before
            FROM lonely l JOIN sizes s ON s.w <> l.w),
        asked AS (SELECT i, x, w FROM b UNION ALL SELECT i, x, w FROM reach WHERE coalesce(before, 0) < {k}),
        cand AS (SELECT a.i, b.i j, list_distance(a.x, b.x) dist FROM asked a JOIN b ON b.w = a.w AND b.i <> a.i),
        nn AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY i ORDER BY dist) rk FROM cand) r WHERE rk <= {k})
        SELECT i, count(*)::INTEGER n, round(max(dist), 6) kd FROM nn GROUP BY i"""


def grid(points: str, k: int) -> str:
    """Quality of all 36 cells: every hash value, then buckets by their first ones."""
    manhattan = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2])))"
    cells = f"floor((p[1] - p[2]) / {D.GRID_L1}::DOUBLE)::BIGINT"
    return f"""WITH pts AS MATERIALIZED ({points}),
    atoms AS MATERIALIZED (
        SELECT 'l2' family, i, t, h, 1 times,
            floor((list_dot_product(x, g) + (t * 8 + h) * 37 % 100) / {D.GRID_L2}::DOUBLE + 0.5)::BIGINT::VARCHAR v
        FROM pts, ({rows_of(16, 8, 1, "{} - 0.5")})
        UNION ALL
        SELECT 'l1', i, t, h, 1, md5(list_transform(list_zip(x, g), lambda p: {cells})::VARCHAR)
        FROM pts, ({rows_of(16, 8, 2, f"{{}} * {D.GRID_L1}::DOUBLE")})
        UNION ALL
        SELECT 'cos', i, t, h, 8, (list_dot_product(x, g) > 0)::INTEGER::VARCHAR
        FROM pts, ({rows_of(16, 64, 3, "{} - 0.5")})),
    signed AS MATERIALIZED (
        SELECT family, n * times hashes, i, t, string_agg(v, ',' ORDER BY h) w
        FROM atoms, (SELECT unnest([2, 4, 8]) n) WHERE h < n * times GROUP BY ALL),
    shared AS MATERIALIZED (
        SELECT a.family, a.hashes, a.i, b.i j, min(a.t) since FROM signed a JOIN signed b USING (family, hashes, t, w) GROUP BY ALL),
    dists AS MATERIALIZED (
        SELECT f.family, a.i, b.i j, CASE f.family WHEN 'l2' THEN list_distance(a.x, b.x)
            WHEN 'cos' THEN list_cosine_distance(a.x, b.x) ELSE {manhattan} END dist
        FROM pts a, pts b, (SELECT unnest(['l2', 'l1', 'cos']) family) f),
    exact AS MATERIALIZED (
        SELECT family, i, list(j ORDER BY dist, j) e FROM (
            SELECT *, row_number() OVER (PARTITION BY family, i ORDER BY dist, j) r FROM dists) WHERE r <= {k} GROUP BY ALL),
    near AS MATERIALIZED (
        SELECT family, hashes, "tables", i, list(j ORDER BY dist, j) a, any_value(pairs) pairs FROM (
            SELECT *, row_number() OVER (PARTITION BY family, hashes, "tables", i ORDER BY dist, j) r,
                count(*) OVER (PARTITION BY family, hashes, "tables") pairs
            FROM shared JOIN dists USING (family, i, j), (SELECT unnest([2, 4, 8, 16]) "tables") c WHERE since < "tables")
        WHERE r <= {k} GROUP BY family, hashes, "tables", i),
    sums AS (SELECT family, hashes, "tables", count(*) queries, sum(len(list_intersect(a, e)))::BIGINT tp,
        sum(len(a) - len(list_intersect(a, e)))::BIGINT fp, sum(len(e) - len(list_intersect(a, e)))::BIGINT fn,
        sum((a[1:least(len(a), len(e))] = e[1:least(len(a), len(e))])::INTEGER)::BIGINT correct, any_value(pairs) pairs
        FROM near JOIN exact USING (family, i) GROUP BY ALL)
    SELECT family, hashes, "tables", queries, tp, fp, fn, round(tp * 100.0 / (tp + fp), 6)::DOUBLE "precision",
        round(tp * 100.0 / (tp + fn), 6)::DOUBLE recall, round(correct * 100.0 / queries, 6)::DOUBLE correct_pct,
        round(pairs * 100.0 / (queries::DOUBLE * queries), 6) touched_pct FROM sums"""
