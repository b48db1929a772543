"""DuckDB SQL of the registered queries, put together from common table expressions.

Written from the definitions, not from the Spark plans: stencils are windows over a dense grid, density clusters a
recursive closure over neighbouring pixels, least squares an elimination spelt out column by column.
"""

from __future__ import annotations

from blinkframe.sources.events import EPOCH_US, FRAME_US, HEIGHT, WIDTH

F_US = FRAME_US
POSITIVE = "event_type IN ('click', 'purchase', 'view')"


def _events(name: str, x: str, y: str) -> str:
    return f"""
    {name} AS (
      SELECT t_us // {F_US} AS frame, event_id AS event_seq, ({x})::INT AS x, ({y})::INT AS y, t_us AS timestamp_us, {POSITIVE} AS polarity
      FROM (SELECT *, (event_id * 7919 + user_id * 104729) % 6561 AS h, (epoch_us(ts) - {EPOCH_US}) // 1000 AS t_us FROM events)
    )"""


_digits = lambda ks: " + ".join(f"((h // {3**k}) % 3)" for k in ks)
EV = _events("ev", "(user_id * 37) % 120 + 4 + (event_id * 31) % 5 - 2", "(user_id * 53) % 88 + 4 + ((event_id // 5) * 17) % 5 - 2")
EM = _events("ev", f"(user_id % 5) * 24 + 16 + {_digits(range(4))} - 4", f"((user_id // 5) % 3) * 28 + 20 + {_digits(range(4, 8))} - 4")


def image(signed: bool) -> str:
    weight = f"greatest(timestamp_us - frame * {F_US}, 1)::DOUBLE"
    value = f"CASE WHEN polarity THEN {weight} ELSE -{weight} END" if signed else weight
    return f"img AS (SELECT frame, x, y, sum({value}) AS value FROM ev WHERE x BETWEEN 0 AND {WIDTH - 1} AND y BETWEEN 0 AND {HEIGHT - 1} GROUP BY ALL)"


GRID = f"""grid AS MATERIALIZED (
      SELECT frame, x, y, sum(value) AS v FROM (
        SELECT frame, x, y, value FROM img
        UNION ALL SELECT f.frame, x.range, y.range, 0.0 FROM (SELECT DISTINCT frame FROM img) f, range({WIDTH}) x, range({HEIGHT}) y
      ) GROUP BY ALL
    )"""


def _pass(made: str, source: str, across: str, along: str, step: int, kept: str) -> str:
    """One smoothing along an axis; ``kept`` columns go along, so that no plane has to be joined to another."""
    w = f"OVER (PARTITION BY frame, {across} ORDER BY {along})"
    whole = f"OVER (PARTITION BY frame, {across} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    low = lambda k: f"coalesce(lag(v, {k * step}) {w}, first_value(v) {whole})"
    high = lambda k: f"coalesce(lead(v, {k * step}) {w}, last_value(v) {whole})"
    return f"{made} AS MATERIALIZED (SELECT frame, x, y{kept}, ({low(2)} + 4 * {low(1)} + 6 * v + 4 * {high(1)} + {high(2)}) / 16 AS v FROM {source})"


WAVELET = ",\n    ".join([
    GRID, _pass("h1", "grid", "y", "x", 1, ", v AS g"), _pass("v1", "h1", "x", "y", 1, ", g"), _pass("h2", "v1", "y", "x", 2, ", g, v AS a"), _pass("v2", "h2", "x", "y", 2, ", g, a"),
    "planes AS (SELECT frame, x, y, g - a AS f1, a - v AS f2 FROM v2)",
])


def spots(factor: float = 1.5, most: int = 256) -> str:
    return f"""{WAVELET},
    sig AS (SELECT frame, stddev_pop(f1) AS sigma FROM planes GROUP BY frame),
    kept AS (SELECT p.frame, p.x, p.y, CASE WHEN f2 > {factor} * sigma THEN f2 ELSE 0.0 END AS v FROM planes p JOIN sig USING (frame)),
    rows3 AS (SELECT *, max(v) OVER (PARTITION BY frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM kept),
    best AS (SELECT *, max(m) OVER (PARTITION BY frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mm FROM rows3),
    peaks AS (SELECT frame, x, y, v, row_number() OVER (PARTITION BY frame ORDER BY v DESC, y, x) AS rank FROM best
              WHERE v > 0 AND v >= mm AND x BETWEEN 1 AND {WIDTH - 2} AND y BETWEEN 1 AND {HEIGHT - 2}),
    spots AS (
      SELECT p.frame, p.rank, p.x, p.y, p.v AS value, sum(k.x * k.v) / sum(k.v) AS com_x, sum(k.y * k.v) / sum(k.v) AS com_y
      FROM peaks p JOIN kept k ON k.frame = p.frame AND k.x BETWEEN p.x - 1 AND p.x + 1 AND k.y BETWEEN p.y - 1 AND p.y + 1
      WHERE p.rank <= {most} GROUP BY ALL
    )"""


def dbscan(eps: float, least: int) -> str:
    return f"""
    px AS (SELECT frame, x, y, count(*) AS n, min(event_seq) AS s FROM ev GROUP BY ALL),
    nb AS (SELECT a.frame, a.s, b.s AS o, b.n FROM px a JOIN px b ON a.frame = b.frame AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps * eps}),
    core AS (SELECT frame, s FROM nb GROUP BY ALL HAVING sum(n) >= {least}),
    link AS (SELECT nb.s, nb.o FROM nb JOIN core a ON a.s = nb.s JOIN core b ON b.s = nb.o),
    reach(s, root) AS (SELECT s, s FROM core UNION SELECT l.o, r.root FROM reach r JOIN link l ON l.s = r.s),
    roots AS (SELECT s, min(root) AS root FROM reach GROUP BY s),
    marked AS (SELECT s, root FROM roots UNION ALL SELECT nb.s, min(r.root) FROM nb JOIN roots r ON r.s = nb.o WHERE nb.s NOT IN (SELECT s FROM core) GROUP BY nb.s),
    mem AS (SELECT e.*, m.root AS cluster_id FROM ev e JOIN px USING (frame, x, y) JOIN marked m ON m.s = px.s)"""


#: Sums of whole numbers are exact in any order; ``vx`` to ``vxy`` are covariances times n squared.
MEASURES = """
    cl0 AS (
      SELECT frame, cluster_id, count(*) AS n_events, count(*) FILTER (polarity) AS n_positive, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
             sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * x)::BIGINT AS sxx, sum(y * y)::BIGINT AS syy, sum(x * y)::BIGINT AS sxy
      FROM mem GROUP BY ALL
    ), cl1 AS (
      SELECT *, n_events - n_positive AS n_negative, (2 * n_positive - n_events) / n_events AS polarity_balance, sx / n_events AS centroid_x, sy / n_events AS centroid_y,
             (n_events * sxx - sx * sx)::DOUBLE AS vx, (n_events * syy - sy * sy)::DOUBLE AS vy, (n_events * sxy - sx * sy)::DOUBLE AS vxy FROM cl0
    ), cl2 AS (SELECT *, sqrt((vx - vy) * (vx - vy) + 4 * vxy * vxy) AS root, 2 * (n_events * n_events)::DOUBLE AS twice FROM cl1
    ), cl AS (
      SELECT *, (vx + vy + root) / twice AS lambda_1, (vx + vy - root) / twice AS lambda_2,
             CASE WHEN (vx + vy + root) / twice <= 1e-9 THEN 1.0 ELSE greatest(vx + vy - root, 0.0) / (vx + vy + root) END AS isotropy FROM cl2
    )"""

HIST = "hist AS (SELECT frame, cluster_id, x, y, count(*) FILTER (polarity) AS n_pos, count(*) FILTER (NOT polarity) AS n_neg, count(*) AS n FROM mem GROUP BY ALL)"

MEAN_XY = "fit AS (SELECT frame, cluster_id, sum(x * n) / sum(n) AS x, sum(y * n) / sum(n) AS y, 0.0 AS sigma_x, 0.0 AS sigma_y, 0.0 AS residual FROM hist GROUP BY ALL)"

_TURN = "2 * pi()"
PHASOR = f"""
    box AS (SELECT frame, cluster_id, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM hist GROUP BY ALL),
    wave AS (
      SELECT frame, cluster_id, x0, y0, w, h, sum(n) AS n, sum(x * n) AS sx, sum(y * n) AS sy,
             sum(n * cos({_TURN} * (x - x0) / w)) AS cx, sum(n * sin({_TURN} * (x - x0) / w)) AS ix,
             sum(n * cos({_TURN} * (y - y0) / h)) AS cy, sum(n * sin({_TURN} * (y - y0) / h)) AS iy
      FROM hist JOIN box USING (frame, cluster_id) GROUP BY ALL
    ), fit AS (
      SELECT frame, cluster_id,
             CASE WHEN w < 2 OR h < 2 THEN sx / n ELSE x0 + ((CASE WHEN sqrt(cx * cx + ix * ix) <= 1e-9 * n THEN 0.0 ELSE atan2(ix, cx) END * w / ({_TURN})) % w + w) % w END AS x,
             CASE WHEN w < 2 OR h < 2 THEN sy / n ELSE y0 + ((CASE WHEN sqrt(cy * cy + iy * iy) <= 1e-9 * n THEN 0.0 ELSE atan2(iy, cy) END * h / ({_TURN})) % h + h) % h END AS y,
             0.0 AS sigma_x, 0.0 AS sigma_y,
             CASE WHEN w < 2 OR h < 2 THEN 0.0 ELSE 1 - 0.5 * (least(sqrt(cx * cx + ix * ix) / n, 1.0) + least(sqrt(cy * cy + iy * iy) / n, 1.0)) END AS residual
      FROM wave
    )"""


def log_gaussian() -> str:
    """Normal equations of the parabola and their elimination, one column after the other."""
    terms = ["1", "u", "v", "u * u", "v * v"]
    cells = [f"sum(n * ({terms[i]}) * ({terms[j]}))::DOUBLE AS m{i}{j}" for i in range(5) for j in range(5)] + [f"sum(n * ({terms[i]}) * ln(n)) AS m{i}5" for i in range(5)]
    steps = []
    for k in range(5):
        done = [f"m{i}{j} AS m{i}{j}" if i == k else f"m{i}{j} - m{i}{k} / m{k}{k} * m{k}{j} AS m{i}{j}" for i in range(5) for j in range(6)]
        steps.append(f"e{k + 1} AS (SELECT frame, cluster_id, x0, y0, k, {', '.join(done)} FROM e{k})")
    theta = ", ".join(f"m{i}5 / m{i}{i} AS t{i}" for i in range(5))
    return f"""
    own AS (SELECT *, x - min(x) OVER c AS u, y - min(y) OVER c AS v, min(x) OVER c AS x0, min(y) OVER c AS y0 FROM hist WINDOW c AS (PARTITION BY frame, cluster_id)),
    e0 AS (SELECT frame, cluster_id, x0, y0, count(*) AS k, {', '.join(cells)} FROM own GROUP BY ALL HAVING count(*) >= 5),
    {', '.join(steps)},
    th AS (SELECT frame, cluster_id, x0, y0, {theta} FROM e5 WHERE least(abs(m11), abs(m22), abs(m33), abs(m44)) > 1e-9),
    fit AS (
      SELECT frame, cluster_id, x0 - t1 / (2 * t3) AS x, y0 - t2 / (2 * t4) AS y, sqrt(-0.5 / t3) AS sigma_x, sqrt(-0.5 / t4) AS sigma_y,
             sqrt(avg((ln(n) - t0 - t1 * u - t2 * v - t3 * u * u - t4 * v * v) ** 2)) AS residual
      FROM th JOIN own USING (frame, cluster_id, x0, y0) WHERE t3 < -1e-9 AND t4 < -1e-9 GROUP BY frame, cluster_id, x0, y0, t1, t2, t3, t4
    )"""


def gaussian(samples: str, seed: str, rounds: int, floor: str) -> str:
    """Damped least squares as a recursion, a step each round: ``samples`` (frame, id, x, y, v), ``seed`` (frame, id, p0 to p5).

    The matrix is positive definite by its damping, so that the elimination needs no exchange of rows.
    """
    p, q = [f"p{i}" for i in range(6)], [f"q{i}" for i in range(6)]
    state = f"frame, id, it, {', '.join(p)}, damping, reached"
    slopes = ["p4 * g * dx / p2 ** 2", "p4 * g * dy / p3 ** 2", "p4 * g * dx * dx / p2 ** 3", "p4 * g * dy * dy / p3 ** 3", "g", "1.0"]
    at = "exp(-0.5 * ((x - {0}0) ** 2 / {0}2 ** 2 + (y - {0}1) ** 2 / {0}3 ** 2))"
    made = f"SELECT {state}, x, y, v, x - p0 AS dx, y - p1 AS dy, {at.format('p')} AS g FROM gf JOIN {samples} USING (frame, id) WHERE going AND it < {rounds}"
    made = f"SELECT *, v - p5 - p4 * g AS r, {', '.join(f'{j} AS j{i}' for i, j in enumerate(slopes))} FROM ({made})"
    cells = [f"sum(j{i} * j{j}){' + damping' if i == j else ''} AS m{i}{j}" for i in range(6) for j in range(6)] + [f"sum(j{i} * r) AS m{i}6" for i in range(6)]
    made = f"SELECT {state}, sum(r * r) AS error, {', '.join(cells)} FROM ({made}) GROUP BY {state}"
    for k in range(6):
        done = [f"m{i}{j} / m{k}{k} AS m{i}{j}" if i == k else f"m{i}{j} - m{i}{k} / m{k}{k} * m{k}{j} AS m{i}{j}" for i in range(6) for j in range(k + 1, 7)]
        made = f"SELECT {state}, error, {', '.join(done)} FROM ({made})"
    tried = ["p0 + m06", "p1 + m16", "least(greatest(p2 + m26, 0.5), 6.0)", "least(greatest(p3 + m36, 0.5), 6.0)", "greatest(p4 + m46, 1e-3)", f"greatest(p5 + m56, {floor})"]
    made = f"SELECT {state}, error, sqrt({' + '.join(f'm{i}6 ** 2' for i in range(6))}) AS step, {', '.join(f'{t} AS q{i}' for i, t in enumerate(tried))} FROM ({made})"
    made = f"SELECT t.*, sum((s.v - q5 - q4 * {at.format('q')}) ** 2) AS new FROM ({made}) t JOIN {samples} s USING (frame, id) GROUP BY ALL"
    better = ", ".join(f"CASE WHEN new < error THEN {b} ELSE {a} END" for a, b in zip(p, q, strict=True))
    return f"""
    gf AS (
      SELECT frame, id, 0 AS it, {', '.join(f'{c}::DOUBLE AS {c}' for c in p)}, 1e-2::DOUBLE AS damping, 'inf'::DOUBLE AS reached, true AS going FROM {seed}
      UNION ALL
      SELECT frame, id, it + 1, {better}, CASE WHEN new < error THEN damping * 0.7 ELSE damping * 2 END, CASE WHEN new < error THEN new ELSE reached END, step >= 1e-3 FROM ({made})
    ),
    gauss AS (
      SELECT *, sqrt(reached / (SELECT count(*) FROM {samples} s WHERE s.frame = o.frame AND s.id = o.id)) AS rest FROM (
        SELECT frame, id, unnest(arg_max({{{', '.join(f"'{c}': {c}" for c in (*p, 'reached'))}}}, it)) FROM gf GROUP BY frame, id
      ) o WHERE reached < 'inf'::DOUBLE
    )"""


def cluster_gaussian() -> str:
    spread = lambda c: f"least(greatest((max({c}) - min({c}) + 1) / 4, 0.7), 4.0)"
    return f"""
    gp AS MATERIALIZED (SELECT frame, cluster_id AS id, x, y, n::DOUBLE AS v FROM hist),
    gs AS MATERIALIZED (
      SELECT frame, id, sum(x * v) / sum(v) AS p0, sum(y * v) / sum(v) AS p1, {spread('x')} AS p2, {spread('y')} AS p3, greatest(max(v) - min(v), 1.0) AS p4, greatest(min(v), 0.0) AS p5
      FROM gp GROUP BY ALL HAVING count(*) >= 5
    ),
    {gaussian('gp', 'gs', 20, '0.0')},
    fit AS (SELECT frame, id AS cluster_id, p0 AS x, p1 AS y, p2 AS sigma_x, p3 AS sigma_y, rest AS residual FROM gauss)"""


def window_gaussian(radius: int, sigma: float) -> str:
    """Fits of image windows around spots, with the limits of localizations and their times."""
    return f"""
    inside AS (
      SELECT frame, rank AS id, com_x, com_y, round(com_x) AS wx, round(com_y) AS wy FROM spots
      WHERE round(com_x) >= {radius} AND round(com_y) >= {radius} AND round(com_x) + {radius} < {WIDTH} AND round(com_y) + {radius} < {HEIGHT}
    ),
    gp AS MATERIALIZED (SELECT i.frame, i.id, g.x, g.y, g.v FROM inside i JOIN grid g ON g.frame = i.frame AND abs(g.x - wx) <= {radius} AND abs(g.y - wy) <= {radius}),
    gs AS MATERIALIZED (SELECT frame, id, com_x AS p0, com_y AS p1, {sigma} AS p2, {sigma} AS p3, greatest(max(v) - min(v), 1.0) AS p4, min(v) AS p5 FROM inside JOIN gp USING (frame, id) GROUP BY ALL),
    {gaussian('gp', 'gs', 15, "'-inf'::DOUBLE")}"""


def credible(low: float, high: float, most: float, radius: float, nm: float = 65.0) -> str:
    return f"""
    good AS (
      SELECT frame, id AS rank, p0 AS x, p1 AS y, p2 AS sigma_x, p3 AS sigma_y, p4 AS amplitude, p5 AS background, rest AS fit_error FROM gauss
      WHERE p2 * {nm} BETWEEN {low} AND {high} AND p3 * {nm} BETWEEN {low} AND {high} AND (p2 + p3) / 2 / sqrt(greatest(abs(p4), 1.0)) * {nm} <= {most}
    ), times AS (
      SELECT g.frame, g.rank, sum(e.timestamp_us / (1 + (e.x - g.x) ** 2 + (e.y - g.y) ** 2)) / sum(1 / (1 + (e.x - g.x) ** 2 + (e.y - g.y) ** 2)) AS t
      FROM good g JOIN ev e ON e.frame = g.frame AND (e.x - g.x) ** 2 + (e.y - g.y) ** 2 <= {radius * radius} GROUP BY ALL
    ), loc AS (SELECT good.*, coalesce(round(t)::BIGINT, frame * {F_US} + {F_US // 2}) AS timestamp_us FROM good LEFT JOIN times USING (frame, rank))"""


RADIAL = """
    box AS (SELECT frame, cluster_id, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM hist GROUP BY ALL HAVING max(x) - min(x) >= 2 AND max(y) - min(y) >= 2),
    dense AS (
      SELECT b.frame, b.cluster_id, x0, y0, w, h, i, j, coalesce(n, 0)::DOUBLE AS v FROM (SELECT *, unnest(range(w)) AS i FROM box) b, LATERAL (SELECT unnest(range(b.h)) AS j) r
      LEFT JOIN hist ON hist.frame = b.frame AND hist.cluster_id = b.cluster_id AND hist.x = x0 + i AND hist.y = y0 + j
    ),
    slope AS (
      SELECT *, 0.5 * (lead(v) OVER a - lag(v) OVER a) AS sx, 0.5 * (lead(v) OVER d - lag(v) OVER d) AS sy FROM dense
      WINDOW a AS (PARTITION BY frame, cluster_id, j ORDER BY i), d AS (PARTITION BY frame, cluster_id, i ORDER BY j)
    ),
    inner_ AS (SELECT * FROM slope WHERE i BETWEEN 1 AND w - 2 AND j BETWEEN 1 AND h - 2),
    smooth AS (
      SELECT a.frame, a.cluster_id, a.x0, a.y0, a.i, a.j, sum(b.sx) / 9 AS gx, sum(b.sy) / 9 AS gy
      FROM inner_ a JOIN inner_ b ON a.frame = b.frame AND a.cluster_id = b.cluster_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL
    ),
    line AS (SELECT *, gx * gx + gy * gy AS g2, gx * j - gy * i AS dot FROM smooth WHERE gx * gx + gy * gy > 1e-9),
    eq AS (
      SELECT frame, cluster_id, x0, y0, sum(g2 * gy * gy) AS a, -sum(g2 * gy * gx) AS b, sum(g2 * gx * gx) AS c, -sum(g2 * gy * dot) AS r, sum(g2 * gx * dot) AS s
      FROM line GROUP BY ALL HAVING abs(sum(g2 * gy * gy) * sum(g2 * gx * gx) - sum(g2 * gy * gx) ** 2) >= 1e-9
    ),
    mid AS (SELECT *, (r * c - s * b) / (a * c - b * b) AS cx, (a * s - r * b) / (a * c - b * b) AS cy FROM eq),
    fit AS (
      SELECT m.frame, m.cluster_id, m.x0 + cx AS x, m.y0 + cy AS y, 0.0 AS sigma_x, 0.0 AS sigma_y, sqrt(sum(g2 * (gx * cy - gy * cx - dot) ** 2) / sum(g2)) AS residual
      FROM mid m JOIN line l ON l.frame = m.frame AND l.cluster_id = m.cluster_id GROUP BY m.frame, m.cluster_id, m.x0, m.y0, cx, cy
    )"""

#: Separable transform of the counts; what is taken off as the mean has no frequency.
SPECTRUM = f"""
    px AS (SELECT frame, x, y, count(*) AS n FROM ev GROUP BY ALL),
    varied AS (SELECT frame FROM px GROUP BY frame HAVING sum(n * n) - sum(n) ** 2 / {WIDTH * HEIGHT}.0 > 1e-6),
    across AS (
      SELECT frame, y, u.range AS u, sum(n * cos(2 * pi() * ((u.range * x) % {WIDTH}) / {WIDTH})) AS re, -sum(n * sin(2 * pi() * ((u.range * x) % {WIDTH}) / {WIDTH})) AS im
      FROM px, range({WIDTH}) u GROUP BY ALL
    ),
    turn AS (SELECT range AS k, cos(2 * pi() * range / {HEIGHT}) AS c, sin(2 * pi() * range / {HEIGHT}) AS s FROM range({HEIGHT})),
    down AS (SELECT frame, u, v.range AS v, sum(re * c + im * s) AS re, sum(im * c - re * s) AS im FROM across, range({HEIGHT}) v JOIN turn ON k = (v.range * y) % {HEIGHT} GROUP BY ALL),
    ring AS (SELECT *, sqrt((least(u, {WIDTH} - u) / {WIDTH / 2}) ** 2 + (least(v, {HEIGHT} - v) / {HEIGHT / 2}) ** 2) AS radius FROM down)"""

#: Greedy linking, a localization each step: tracks that are free, those of the current frame, and lengths that ended.
TRACKS = """
    nth AS (SELECT row_number() OVER (ORDER BY frame, cluster_id) AS i, frame, x, y FROM loc),
    walk AS (
      SELECT 0::BIGINT AS i, -9::BIGINT AS frame, []::STRUCT(x DOUBLE, y DOUBLE, n BIGINT)[] AS free, []::STRUCT(x DOUBLE, y DOUBLE, n BIGINT)[] AS made, []::BIGINT[] AS ended
      UNION ALL
      SELECT i, frame, CASE WHEN nearest IS NULL THEN free ELSE list_concat(free[:nearest - 1], free[nearest + 1:]) END,
             list_append(made, {'x': x, 'y': y, 'n': 1 + coalesce(free[nearest].n, 0)}), ended
      FROM (
        SELECT *, CASE WHEN list_min(d) <= 2.25 THEN len(d) - list_position(list_reverse(d), list_min(d)) + 1 END AS nearest FROM (
          SELECT *, [(t.x - x) ** 2 + (t.y - y) ** 2 for t in free] AS d FROM (
            SELECT o.i, o.frame, o.x, o.y,
                   CASE WHEN o.frame = w.frame THEN w.free WHEN o.frame = w.frame + 1 THEN w.made ELSE [] END AS free, CASE WHEN o.frame = w.frame THEN w.made ELSE [] END AS made,
                   CASE WHEN o.frame = w.frame THEN [] WHEN o.frame = w.frame + 1 THEN [t.n for t in w.free] ELSE list_concat([t.n for t in w.free], [t.n for t in w.made]) END AS ended
            FROM walk w JOIN nth o ON o.i = w.i + 1)))
    ),
    tracks AS (
      SELECT unnest(ended) AS length FROM walk
      UNION ALL SELECT unnest(list_concat([t.n for t in free], [t.n for t in made])) FROM walk WHERE i = (SELECT max(i) FROM walk)
    )"""


def feedback(window: int, most: int = 8) -> str:
    """Drift with feedback, a frame each step; ``held`` are the corrected points so far."""
    wide, inner = 2 * most + 3, 2 * most + 1
    vertex = lambda a, b: f"CASE WHEN abs({a} - 2 * {mid} + {b}) < 1e-9 THEN 0.0 ELSE greatest(least(0.5 * ({a} - {b}) / ({a} - 2 * {mid} + {b}), 0.5), -0.5) END"
    at = lambda dx, dy: f"score[(best // {inner} + {1 + dy}) * {wide} + best % {inner} + {1 + dx} + 1]"
    mid = at(0, 0)
    return f"""
    fr AS (SELECT row_number() OVER (ORDER BY frame) AS i, frame, list({{'x': x, 'y': y}}) AS points FROM loc GROUP BY frame),
    fold AS (
      SELECT 0::BIGINT AS i, -1::BIGINT AS frame, 0.0::DOUBLE AS shift_x, 0.0::DOUBLE AS shift_y, []::STRUCT(frame BIGINT, x DOUBLE, y DOUBLE)[] AS held
      UNION ALL
      SELECT i, frame, sx, sy, list_concat(ref, [{{'frame': frame, 'x': p.x - sx, 'y': p.y - sy}} for p in points]) FROM (
        SELECT *, CASE WHEN len(ref) = 0 THEN 0.0 ELSE best % {inner} - {most} + {vertex(at(-1, 0), at(1, 0))} END AS sx,
               CASE WHEN len(ref) = 0 THEN 0.0 ELSE best // {inner} - {most} + {vertex(at(0, -1), at(0, 1))} END AS sy FROM (
          SELECT *, list_position(scored, list_max(scored)) - 1 AS best FROM (
            SELECT *, [score[(k // {inner} + 1) * {wide} + k % {inner} + 2] for k in range({inner * inner})] AS scored FROM (
              SELECT *, [len([1 for c in pairs if c = k]) for k in range({wide * wide})] AS score FROM (
                SELECT *, flatten([[CASE WHEN abs(round(r.x) - round(p.x)) <= {most + 1} AND abs(round(r.y) - round(p.y)) <= {most + 1}
                                    THEN ((round(r.y) - round(p.y) + {most + 1}) * {wide} + round(r.x) - round(p.x) + {most + 1})::BIGINT ELSE -1 END for r in ref] for p in points]) AS pairs FROM (
                  SELECT f.i, f.frame, f.points, [h for h in held if h.frame >= f.frame - {window}] AS ref FROM fold JOIN fr f ON f.i = fold.i + 1))))))
    )"""


TIMED = """
    loc0 AS (
      SELECT fit.*, cl.n_events, cl.polarity_balance,
             CASE WHEN sigma_x > 0 AND sigma_y > 0 THEN 2.5 * greatest(sigma_x, sigma_y, 1.0) ELSE 0.5 * greatest(x_max - x_min + 1, y_max - y_min + 1) END AS radius
      FROM fit JOIN cl USING (frame, cluster_id)
    ), loc1 AS (
      SELECT l.frame, l.cluster_id, m.timestamp_us AS t, (m.x - l.x) ** 2 + (m.y - l.y) ** 2 AS d2, radius FROM loc0 l JOIN mem m ON m.frame = l.frame AND m.cluster_id = l.cluster_id
    ), loc2 AS (
      SELECT frame, cluster_id, round(coalesce(sum(t / (1 + d2)) FILTER (d2 <= radius * radius) / sum(1 / (1 + d2)) FILTER (d2 <= radius * radius), avg(t)))::BIGINT AS timestamp_us
      FROM loc1 GROUP BY ALL
    ), loc AS (SELECT l.* EXCLUDE (radius), t.timestamp_us FROM loc0 l JOIN loc2 t USING (frame, cluster_id))"""

NEIGHBOURS = """
    nn AS (
      SELECT a.frame, a.cluster_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS distance
      FROM loc a JOIN loc b ON a.frame = b.frame AND a.cluster_id <> b.cluster_id GROUP BY ALL
    )"""


def drift(window: int, most: int = 8) -> str:
    inner = f"(SELECT range - {most} AS s FROM range({2 * most + 1}))"
    vertex = lambda a, b: f"CASE WHEN abs({a} - 2 * c + {b}) < 1e-9 THEN 0.0 ELSE greatest(least(0.5 * ({a} - {b}) / ({a} - 2 * c + {b}), 0.5), -0.5) END"
    at = lambda dx, dy: f"coalesce(max(s.v) FILTER (s.sx = b.sx + {dx} AND s.sy = b.sy + {dy}), 0)"
    return f"""
    mov AS (SELECT frame, round(x)::BIGINT AS x, round(y)::BIGINT AS y, count(*) AS n FROM loc GROUP BY ALL),
    ref AS (SELECT frame + k AS frame, round(x)::BIGINT AS x, round(y)::BIGINT AS y, count(*) AS n FROM loc, (SELECT range + 1 AS k FROM range({window})) GROUP BY ALL),
    shared AS (SELECT DISTINCT frame FROM mov WHERE frame IN (SELECT frame FROM ref)),
    sc AS (
      SELECT m.frame, r.x - m.x AS sx, r.y - m.y AS sy, sum(r.n * m.n) AS v FROM mov m JOIN ref r ON r.frame = m.frame
      WHERE abs(r.x - m.x) <= {most + 1} AND abs(r.y - m.y) <= {most + 1} GROUP BY ALL
    ), ranked AS (
      SELECT f.frame, x.s AS sx, y.s AS sy, coalesce(sc.v, 0) AS v, row_number() OVER (PARTITION BY f.frame ORDER BY coalesce(sc.v, 0) DESC, y.s, x.s) AS k
      FROM shared f CROSS JOIN {inner} x CROSS JOIN {inner} y LEFT JOIN sc ON sc.frame = f.frame AND sc.sx = x.s AND sc.sy = y.s
    ), top AS (
      SELECT b.frame, b.sx, b.sy, b.v, b.v::DOUBLE AS c, {at(-1, 0)}::DOUBLE AS w, {at(1, 0)}::DOUBLE AS e, {at(0, -1)}::DOUBLE AS n, {at(0, 1)}::DOUBLE AS s
      FROM ranked b LEFT JOIN sc s ON s.frame = b.frame WHERE b.k = 1 GROUP BY ALL
    ), shifts AS (
      SELECT frame, sx + {vertex('w', 'e')} AS shift_x, sy + {vertex('n', 's')} AS shift_y, v::BIGINT AS overlap FROM top
      UNION ALL SELECT DISTINCT frame, 0.0, 0.0, 0 FROM mov WHERE frame NOT IN (SELECT frame FROM shared)
    )"""


def focus(metric: str, where: str) -> str:
    return f"metrics AS (SELECT frame, avg({metric}) AS metric FROM loc WHERE {where} GROUP BY frame)"


def query(*parts: str, recursive: bool = False) -> str:
    *tables, select = parts
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(tables)}\n{select}"
