"""SQL for a stream of customers in two batches whose arrivals search in buckets."""

from __future__ import annotations


def searched(name: str, known: str, asking: str, dist: str, k: int, order: str, probe: bool) -> str:
    """CTE ``name(i, j, dist)``: lists of points ``asking`` among those ``known``, in shared buckets.

    With ``probe``, points alone in theirs search the nearest buckets that hold ``k`` points.
    """
    nearest = f"""UNION ALL
        SELECT i, x1, x2, 0, w FROM (SELECT l.i, l.x1, l.x2, s.w, sum(s.size) OVER (
                PARTITION BY l.i ORDER BY bit_count(xor(l.w::BIT, s.w::BIT)), s.w
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before
            FROM {name}_own l JOIN {name}_sizes o ON o.w = l.w AND o.size = 1 JOIN {name}_sizes s ON s.w <> l.w)
        WHERE coalesce(before, 0) < {k}"""
    return f"""{name}_known AS MATERIALIZED (SELECT b.* FROM buckets b, half WHERE {known}),
    {name}_own AS MATERIALIZED (SELECT b.* FROM buckets b, half WHERE {asking}),
    {name}_sizes AS MATERIALIZED (SELECT w, count(*) size FROM {name}_known WHERE t = 0 GROUP BY w),
    {name}_asked AS MATERIALIZED (SELECT i, x1, x2, t, w FROM {name}_own {nearest if probe else ""}),
    {name} AS MATERIALIZED (SELECT i, j, dist FROM (SELECT *, {order} rk FROM (
        SELECT DISTINCT a.i, b.i j, {dist} dist
        FROM {name}_asked a JOIN {name}_known b ON a.t = b.t AND a.w = b.w AND a.i <> b.i)) WHERE rk <= {k})"""


def two_batches(points: str, buckets: str, dist: str, k: int, order: str, probe: bool = False) -> str:
    """Scores after the second batch.  Its points search in buckets among all; every list of the
    first batch that they enter, by exact distance, grows by them, ties kept."""
    return f"""WITH pts AS MATERIALIZED ({points}), {buckets},
    half AS (SELECT min(c_custkey) - 1 + ceil((max(c_custkey) - min(c_custkey) + 1) / 2) h FROM customer),
    {searched("early", "i <= h", "i <= h", dist, k, order, probe)},
    {searched("late", "true", "i > h", dist, k, order, probe)},
    reach AS MATERIALIZED (SELECT p.i, CASE WHEN count(j) < {k} THEN 'inf'::DOUBLE ELSE max(dist) END r
        FROM pts p, half LEFT JOIN early e ON e.i = p.i WHERE p.i <= h GROUP BY p.i),
    entered AS MATERIALIZED (SELECT a.i, b.i j, {dist} dist FROM pts a JOIN reach ON reach.i = a.i, pts b, half
        WHERE b.i > h AND {dist} <= r),
    nn AS MATERIALIZED (
        SELECT i, j, dist FROM (SELECT *, rank() OVER (PARTITION BY i ORDER BY dist) rk FROM (
            SELECT * FROM early UNION ALL SELECT * FROM entered)) WHERE rk <= {k}
        UNION ALL SELECT * FROM late),
    kds AS MATERIALIZED (SELECT p.i, coalesce(max(dist), 'inf'::DOUBLE) kd, count(j)::INTEGER n
        FROM pts p LEFT JOIN nn ON nn.i = p.i GROUP BY p.i),
    lrds AS MATERIALIZED (SELECT p.i, any_value(p.kd) kd, any_value(p.n) n,
            coalesce(count(j) / sum(greatest(o.kd, dist)), 'inf'::DOUBLE) lrd
        FROM kds p LEFT JOIN nn ON nn.i = p.i LEFT JOIN kds o ON o.i = nn.j GROUP BY p.i)
    SELECT p.i, any_value(p.n) n, round(any_value(p.kd), 6) kd, round(any_value(p.lrd), 6) lrd,
        round(coalesce(sum(o.lrd) / (any_value(p.lrd) * any_value(p.n)), 'nan'::DOUBLE), 6) lof
    FROM lrds p LEFT JOIN nn ON nn.i = p.i LEFT JOIN lrds o ON o.i = nn.j GROUP BY p.i"""
