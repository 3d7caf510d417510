"""SQL for the window stream: a recursive query that takes one group of arrivals a turn.

A turn's row holds the whole state as lists: ``win`` (points with their neighbours), ``areas``,
``top``, and what the turn did: ``gone`` (points that left), ``owned`` (keys and their points) and
``updated`` (points inserted or changed).
"""

from __future__ import annotations


def window_steps(records: str, k: int, size: str, percent: int, max_age: str, top: int, step: str) -> str:
    """CTEs from the records to ``labelled``; ``records`` gives ``key, i, x1, x2``, points of two dimensions.

    ``size``, ``max_age`` and ``step`` are expressions over the number of records, ``c``.
    """
    dist = "sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))"
    ratio = lambda t, b: (
        f"CASE WHEN {b} = 0 THEN CASE WHEN {t} = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE {t} / {b} END"
    )
    point = "STRUCT(i BIGINT, x1 DOUBLE, x2 DOUBLE, kd DOUBLE, lrd DOUBLE, lof DOUBLE, ts BIGINT, nbrs STRUCT(dist DOUBLE, j BIGINT)[])[]"
    area = "STRUCT(center BIGINT, x1 DOUBLE, x2 DOUBLE, radius DOUBLE, number BIGINT, avg_kd DOUBLE, avg_lrd DOUBLE, ts BIGINT)[]"
    centre = "(-1 - j) // 4"  # of a virtual point in two dimensions
    return f"""recs AS MATERIALIZED (
  SELECT key, i, x1, x2, row_number() OVER (ORDER BY i, key) - 1 AS place FROM ({records})
), par AS MATERIALIZED (SELECT {size} AS size, {max_age} AS max_age, {step} AS most FROM (SELECT count(*) AS c FROM recs)
), steps AS (
  SELECT 0 AS step, 0::BIGINT AS taken, 0::BIGINT AS clock, []::{point} AS win, []::{area} AS areas,
    []::STRUCT(i BIGINT, lof DOUBLE)[] AS top, []::STRUCT(i BIGINT, label INTEGER, reason VARCHAR)[] AS gone,
    []::STRUCT(key VARCHAR, i BIGINT)[] AS owned, []::BIGINT[] AS updated
  UNION ALL
  SELECT * FROM (
  WITH s AS MATERIALIZED (
    SELECT steps.*, CASE WHEN size > len(win) THEN least(most, size - len(win)) ELSE most END AS room, size - most AS size, max_age
    FROM steps, par),
  w AS MATERIALIZED (SELECT u.* FROM (SELECT unnest(win) AS u FROM s)),
  area AS MATERIALIZED (SELECT u.* FROM (SELECT unnest(areas) AS u FROM s)),
  held AS MATERIALIZED (SELECT i, e.dist, e.j FROM (SELECT i, unnest(nbrs) AS e FROM w)),
  g AS MATERIALIZED (SELECT recs.* FROM recs, s WHERE place >= taken AND place < taken + room),
  owner AS MATERIALIZED (
    SELECT g.x1, g.x2, any_value(w.i) IS NULL AS fresh, coalesce(any_value(w.i), min(g.i)) AS i
    FROM g LEFT JOIN w ON w.x1 = g.x1 AND w.x2 = g.x2 GROUP BY 1, 2),
  f AS MATERIALIZED (SELECT i, x1, x2 FROM owner WHERE fresh),
  inside AS MATERIALIZED (
    SELECT center, i, dist FROM (SELECT center, radius, b.i, {dist} AS dist FROM area a, f b) WHERE dist <= radius),
  -- neighbours of the arrivals: points, then virtual points within the bound that these leave
  near AS MATERIALIZED (SELECT i, j, dist FROM (
      SELECT *, rank() OVER (PARTITION BY i ORDER BY dist) AS r FROM (
        SELECT a.i, b.i AS j, {dist} AS dist FROM f a, (SELECT i, x1, x2 FROM w UNION ALL FROM f) b WHERE a.i <> b.i))
    WHERE r <= {k}),
  bound AS MATERIALIZED (
    SELECT f.*, CASE WHEN count(near.j) >= {k} THEN max(near.dist) ELSE 'inf'::DOUBLE END AS bound
    FROM f LEFT JOIN near USING (i) GROUP BY ALL),
  rim AS MATERIALIZED (SELECT i, j, dist FROM (
      SELECT *, rank() OVER (PARTITION BY i ORDER BY dist) AS r FROM (
        SELECT i, bound, -1 - (center * 4 + axis * 2 + side) AS j,
          CASE WHEN axis = 1 THEN sqrt(d * d + radius * radius) WHEN side = 0 THEN d - radius ELSE d + radius END AS dist
        FROM (SELECT a.i, a.bound, b.center, b.radius, {dist} AS d FROM bound a, area b),
          (SELECT unnest([0, 1]) AS axis), (SELECT unnest([0, 1]) AS side)) WHERE dist <= bound)
    WHERE r <= {k}),
  -- who is reached by them
  hits AS MATERIALIZED (SELECT i, j, dist FROM (
      SELECT *, rank() OVER (PARTITION BY i ORDER BY dist) AS r FROM (
        SELECT a.i, b.i AS j, {dist} AS dist, CASE WHEN len(a.nbrs) < {k} THEN 'inf'::DOUBLE ELSE a.kd END AS reach FROM w a, f b)
      WHERE dist <= reach)
    WHERE r <= {k}),
  touched AS MATERIALIZED (SELECT DISTINCT i FROM hits),
  cut AS MATERIALIZED (SELECT i, j, dist FROM (
      SELECT *, rank() OVER (PARTITION BY i ORDER BY dist) AS r FROM (
        FROM near UNION ALL FROM rim UNION ALL FROM hits UNION ALL SELECT i, j, dist FROM held WHERE i IN (FROM touched)))
    WHERE r <= {k}),
  edge AS MATERIALIZED (FROM cut UNION ALL SELECT i, j, dist FROM held WHERE i NOT IN (FROM touched)),
  kds AS MATERIALIZED (
    SELECT p.i, CASE WHEN new THEN coalesce(max(dist), 'inf'::DOUBLE) ELSE any_value(was) END AS kd, any_value(was) AS was, new
    FROM (SELECT i, kd AS was, i IN (FROM touched) AS new FROM w UNION ALL SELECT i, NULL, true FROM f) p LEFT JOIN cut USING (i)
    GROUP BY p.i, new),
  moved AS MATERIALIZED (SELECT i FROM kds WHERE new AND kd IS DISTINCT FROM was),
  dense AS MATERIALIZED (
    SELECT i FROM kds WHERE new UNION SELECT i FROM edge WHERE j IN (FROM moved) AND i IN (SELECT i FROM kds WHERE NOT new)),
  every_kd AS MATERIALIZED (SELECT i AS j, kd FROM kds),
  lrds AS MATERIALIZED (
    SELECT i, CASE WHEN m = 0 THEN 'inf'::DOUBLE ELSE {ratio('m::DOUBLE', 'reach')} END AS lrd FROM (
      SELECT dense.i, count(e.j) AS m, sum(greatest(e.dist, coalesce(o.kd, area.avg_kd))) AS reach
      FROM dense LEFT JOIN edge e ON e.i = dense.i LEFT JOIN every_kd o ON o.j = e.j
        LEFT JOIN area ON e.j < 0 AND area.center = (-1 - e.j) // 4
      GROUP BY dense.i)),
  every_lrd AS MATERIALIZED (SELECT i, lrd FROM lrds UNION ALL SELECT i, lrd FROM w WHERE i NOT IN (FROM dense)),
  factor AS MATERIALIZED (SELECT i FROM dense UNION SELECT i FROM edge WHERE j IN (FROM dense)),
  lofs AS MATERIALIZED (
    SELECT i, CASE WHEN m = 0 THEN 'nan'::DOUBLE ELSE {ratio('around', '(own * m)')} END AS lof FROM (
      SELECT factor.i, count(e.j) AS m, sum(coalesce(o.lrd, area.avg_lrd)) AS around, any_value(mine.lrd) AS own
      FROM factor JOIN every_lrd mine ON mine.i = factor.i LEFT JOIN edge e ON e.i = factor.i LEFT JOIN every_lrd o ON o.i = e.j
        LEFT JOIN area ON e.j < 0 AND area.center = (-1 - e.j) // 4
      GROUP BY factor.i)),
  stays AS MATERIALIZED (
    SELECT i, (SELECT clock FROM s) + row_number() OVER (ORDER BY i) - 1 AS ts FROM f WHERE i NOT IN (SELECT i FROM inside)),
  now AS MATERIALIZED (SELECT (SELECT clock FROM s) + (SELECT count(*) FROM stays) AS clock),
  all_points AS MATERIALIZED (
    SELECT p.i, p.x1, p.x2, kds.kd, every_lrd.lrd, CASE WHEN p.i IN (FROM factor) THEN lofs.lof ELSE p.lof END AS lof, p.ts
    FROM (SELECT i, x1, x2, lof, ts FROM w UNION ALL SELECT f.i, f.x1, f.x2, NULL, stays.ts FROM f LEFT JOIN stays USING (i)) p
      JOIN kds USING (i) JOIN every_lrd USING (i) LEFT JOIN lofs USING (i)),
  -- areas take in what fell into them
  areas2 AS MATERIALIZED (
    SELECT center, a.x1, a.x2, coalesce(closest, radius) AS radius, number + coalesce(more, 0) AS number,
      CASE WHEN more IS NULL THEN avg_kd ELSE (avg_kd * number + kds) / (number + more) END AS avg_kd,
      CASE WHEN more IS NULL THEN avg_lrd ELSE (avg_lrd * number + lrds) / (number + more) END AS avg_lrd,
      CASE WHEN more IS NULL THEN ts ELSE (SELECT clock FROM now) END AS ts
    FROM area a LEFT JOIN (
      SELECT center, count(*) AS more, sum(kd) AS kds, sum(lrd) AS lrds, min(dist) AS closest
      FROM inside JOIN all_points USING (i) GROUP BY center) USING (center)),
  p3 AS MATERIALIZED (SELECT * FROM all_points WHERE i NOT IN (SELECT i FROM inside)),
  e3 AS MATERIALIZED (SELECT * FROM edge WHERE i NOT IN (SELECT i FROM inside) AND j NOT IN (SELECT i FROM inside)),
  -- summarize
  centers AS MATERIALIZED (
    SELECT i FROM (SELECT i, row_number() OVER (ORDER BY round(lof, 9), i) AS r, count(*) OVER () AS c FROM p3)
    WHERE c > (SELECT size FROM s) AND r <= ceil(c * {percent} / 100.0)),
  doomed AS MATERIALIZED (SELECT i FROM centers UNION SELECT j FROM e3 WHERE i IN (FROM centers)),
  made AS MATERIALIZED (
    SELECT i AS center, x1, x2, kd AS radius, m + 1 AS number, {ratio('kds', 'm')} AS avg_kd, {ratio('lrds', 'm')} AS avg_lrd,
      (SELECT clock FROM now) AS ts
    FROM (
      SELECT c.i, any_value(c.x1) AS x1, any_value(c.x2) AS x2, any_value(c.kd) AS kd, count(e.j) AS m,
        coalesce(sum(coalesce(o.kd, v.avg_kd)), 0) AS kds, coalesce(sum(coalesce(o.lrd, v.avg_lrd)), 0) AS lrds
      FROM p3 c LEFT JOIN e3 e ON e.i = c.i LEFT JOIN p3 o ON o.i = e.j
        LEFT JOIN areas2 v ON e.j < 0 AND v.center = (-1 - e.j) // 4
      WHERE c.i IN (FROM centers) GROUP BY c.i)),
  areas3 AS MATERIALIZED (FROM areas2 UNION ALL FROM made),
  p4 AS MATERIALIZED (SELECT * FROM p3 WHERE i NOT IN (FROM doomed)),
  e4 AS MATERIALIZED (SELECT * FROM e3 WHERE i NOT IN (FROM doomed) AND j NOT IN (FROM doomed)),
  -- age out
  full_ AS MATERIALIZED (SELECT (SELECT count(*) FROM p4) > size AS yes, max_age FROM s),
  aged AS MATERIALIZED (SELECT i, lof FROM p4 WHERE (SELECT yes FROM full_) AND (SELECT clock FROM now) - ts > (SELECT max_age FROM full_)),
  expired AS MATERIALIZED (SELECT center FROM areas3 WHERE (SELECT yes FROM full_) AND (SELECT clock FROM now) - ts > (SELECT max_age FROM full_)),
  best AS MATERIALIZED (
    SELECT i, lof FROM (SELECT u.* FROM (SELECT unnest(top) AS u FROM s) UNION ALL FROM aged) ORDER BY round(lof, 9) DESC, i LIMIT {top}),
  p5 AS MATERIALIZED (SELECT * FROM p4 WHERE i NOT IN (SELECT i FROM aged)),
  e5 AS MATERIALIZED (
    SELECT * FROM e4 WHERE i NOT IN (SELECT i FROM aged) AND j NOT IN (SELECT i FROM aged)
      AND (j >= 0 OR {centre} NOT IN (FROM expired))),
  left_ AS MATERIALIZED (
    SELECT DISTINCT i, 0 AS label, 'absorbed' AS reason FROM inside
    UNION ALL SELECT i, 0, 'summarized' FROM doomed WHERE i >= 0
    UNION ALL SELECT i, (i IN (SELECT i FROM best))::INTEGER, 'aged' FROM aged)
  SELECT step + 1, taken + (SELECT count(*) FROM g), (SELECT clock FROM now),
    coalesce((SELECT list(struct_pack(i := i, x1 := x1, x2 := x2, kd := kd, lrd := lrd, lof := lof, ts := ts, nbrs := coalesce(nbrs, [])) ORDER BY i)
      FROM p5 LEFT JOIN (SELECT i, list(struct_pack(dist := dist, j := j) ORDER BY dist, j) AS nbrs FROM e5 GROUP BY i) USING (i)), []),
    coalesce((SELECT list(struct_pack(center := center, x1 := x1, x2 := x2, radius := radius, number := number, avg_kd := avg_kd, avg_lrd := avg_lrd, ts := ts)
      ORDER BY center) FROM areas3 WHERE center NOT IN (FROM expired)), []),
    CASE WHEN (SELECT yes FROM full_) THEN coalesce((SELECT list(struct_pack(i := i, lof := lof)) FROM best), []) ELSE top END,
    coalesce((SELECT list(struct_pack(i := i, label := label, reason := reason)) FROM left_), []),
    coalesce((SELECT list(struct_pack(key := key, i := i)) FROM (SELECT g.key, owner.i FROM g JOIN owner USING (x1, x2))), []),
    coalesce((SELECT list(i) FROM factor), [])
  FROM s WHERE taken < (SELECT count(*) FROM recs)
  )
), at_end AS MATERIALIZED (SELECT * FROM steps ORDER BY step DESC LIMIT 1
), keys AS MATERIALIZED (SELECT o.key, o.i FROM (SELECT unnest(owned) AS o FROM steps)
), gone AS MATERIALIZED (SELECT u.i, u.label, u.reason FROM (SELECT unnest(gone) AS u FROM steps)
), window_points AS MATERIALIZED (SELECT step, u.* FROM (SELECT step, unnest(win) AS u FROM steps)
), window_areas AS MATERIALIZED (SELECT step, u.* FROM (SELECT step, unnest(areas) AS u FROM steps)
), rated AS MATERIALIZED (
  SELECT i, lof FROM window_points WHERE step = (SELECT step FROM at_end) UNION ALL SELECT u.* FROM (SELECT unnest(top) AS u FROM at_end)
), final AS MATERIALIZED (SELECT i FROM rated ORDER BY round(lof, 9) DESC, i LIMIT {top}
), labelled AS (
  SELECT key, label, reason FROM keys JOIN gone USING (i)
  UNION ALL
  SELECT key, (i IN (FROM final))::INTEGER, 'final' FROM keys WHERE i NOT IN (SELECT i FROM gone)
)"""
