"""DuckDB SQL of the fitted methods: start, Lloyd loops, silhouettes, density peaks, records.

The same whole-number arithmetic as :mod:`.functions.grid`, so both engines
come to the same centres.  Lloyd iterations are a recursive query that carries
every k; the walk over the candidates and the choice of peaks fold lists.
"""

from __future__ import annotations

from .defaults import (
    COARSE_K_MAX,
    COARSE_K_MIN,
    COARSE_K_PER_PEAK,
    COARSE_MAX_ITER,
    K_BASELINE,
    K_MAX,
    K_MIN,
    KMEANS_MAX_ITER,
    SEED,
)
from .functions.grid import EXACT_BITS, FINEST
from .operators.kmeans import DRAWN, START_ROUNDS

_RANGE = 4294967296
#: A ground truth for the labelled comparison, the same text in both engines.
TRUTH_SQL = "CAST(logon_count % 3 = 0 AS INT)"


def _dist(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))")


def _draw(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) AS BIGINT)"


def _nearest(points: str, centres: str, out: str, columns: str) -> str:
    """``out``: every row of ``points`` with its least distance to the rows of ``centres (i, x)``."""
    return f"""{out} AS MATERIALIZED (SELECT {columns}, min(d) AS d, arg_min(i, (d, i)) AS i FROM (
    SELECT p.*, c.i, {_dist('p.x', 'c.x')} AS d FROM {points} p CROSS JOIN {centres} c) GROUP BY {columns})"""


def matrix_cte(matrix_sql: str) -> str:
    """Grid, points and ordered starts from ``matrix_sql`` (user, dim, value)."""
    rounds, last = [], "cand0"
    for r in range(1, START_ROUNDS + 1):
        number = _draw(f"'{SEED}'", f"'{r}'", '"user"', "array_to_string(x, ',')")
        rounds.append(_nearest("pts", f"cand{r - 1}", f"near_round{r}", '"user", x'))
        rounds.append(f"""picked{r} AS (SELECT DISTINCT x FROM near_round{r}, (SELECT sum(d) AS phi FROM near_round{r})
  WHERE {number} / {_RANGE}.0 * CAST(phi AS DOUBLE) < CAST(d AS DOUBLE) * {float(DRAWN)}),
cand{r} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x) - 1 AS i, x
  FROM (SELECT x FROM cand{r - 1} UNION SELECT x FROM picked{r}))""")
        last = f"cand{r}"
    rounds.append(_nearest("pts", last, "near_last", '"user", x'))
    draws = ", ".join(_draw(f"'{SEED}'", "'start'", f"'{j}'") for j in range(COARSE_K_MAX))
    joined = ",\n".join(rounds)
    return f"""matrix AS MATERIALIZED ({matrix_sql}),
shape AS (SELECT max(abs(value)) AS mx, max(dim) + 1 AS d FROM matrix),
grid AS MATERIALIZED (SELECT pow(2, least({FINEST}, floor(log2(sqrt(pow(2, {EXACT_BITS}) / d) / (2 * mx))))) AS s
  FROM shape),
cells AS MATERIALIZED (SELECT "user", dim, CAST(floor(value * s + 0.5) AS BIGINT) AS x FROM matrix, grid),
pts AS MATERIALIZED (SELECT "user", list(x ORDER BY dim) AS x FROM cells GROUP BY "user"),
cand0 AS MATERIALIZED (SELECT 0 AS i, x FROM pts ORDER BY {_draw(f"'{SEED}'", "'first'", '"user"')}, "user" LIMIT 1),
{joined},
weighed AS (SELECT c.i, c.x, count(n.i) AS w FROM {last} c LEFT JOIN near_last n ON n.i = c.i GROUP BY c.i, c.x),
field AS MATERIALIZED (SELECT list(x ORDER BY i) AS xs, list(CAST(w AS HUGEINT) ORDER BY i) AS ws, count(*) AS m,
  [{draws}] AS draws FROM weighed),
walk(j, picks, gaps, mass) AS (
  SELECT 0, CAST([] AS BIGINT[]), CAST(NULL AS HUGEINT[]), ws FROM field
  UNION ALL
  SELECT j + 1, list_append(picks, pick), gaps2,
    list_transform(range(1, m + 1), lambda i: ws[i] * gaps2[i])
  FROM (SELECT *, list_transform(range(1, m + 1), lambda i: least(coalesce(gaps[i], steps[i]), steps[i])) AS gaps2
    FROM (SELECT *, list_transform(range(1, m + 1), lambda q: CAST(list_sum(list_transform(
        range(1, len(xs[1]) + 1), lambda z: (xs[q][z] - xs[pick][z]) * (xs[q][z] - xs[pick][z]))) AS HUGEINT)) AS steps
      FROM (SELECT w.*, f.*, list_position(list_transform(range(1, m + 1), lambda i:
          list_sum(mass[1:i]) * {_RANGE} > draws[j + 1] * list_sum(mass)), true) AS pick
        FROM walk w CROSS JOIN field f WHERE j < least({COARSE_K_MAX}, m) AND list_sum(mass) > 0))))
,
starts AS MATERIALIZED (SELECT list_transform(picks, lambda p: xs[p]) AS starts
  FROM (SELECT picks FROM walk ORDER BY j DESC LIMIT 1), field)"""


def fits_cte(name: str, models: str, most: int) -> str:
    """``name_fit (k, centres, it)``, ``name_sums`` and ``name_label`` of the models ``(k)``."""
    return f"""{name}_loop(k, it, centres, done) AS (
  SELECT k, 0, starts[1:k], false FROM {models}, starts
  UNION ALL
  SELECT k, it + 1, fresh, fresh = centres FROM (
    SELECT k, it, centres, list_transform(range(0, len(centres)), lambda c: coalesce(
        list_filter(moved, lambda v: v.c = c)[1].x, centres[c + 1])) AS fresh
    FROM (SELECT k, it, centres, list({{'c': c, 'x': x}}) AS moved FROM (
      SELECT k, it, centres, c, list(x ORDER BY dim) AS x FROM (
        SELECT a.k, a.it, a.centres, a.c, e.dim,
          CAST((2 * sum(e.x) + count(*) - ((2 * sum(e.x) + count(*)) % (2 * count(*)) + 2 * count(*))
            % (2 * count(*))) // (2 * count(*)) AS BIGINT) AS x
        FROM (SELECT k, it, centres, "user", list_position(ds, list_min(ds)) - 1 AS c FROM (
          SELECT l.k, l.it, l.centres, p."user", list_transform(l.centres, lambda y: list_sum(list_transform(
              range(1, len(y) + 1), lambda i: (y[i] - p.x[i]) * (y[i] - p.x[i])))) AS ds
          FROM {name}_loop l CROSS JOIN pts p WHERE NOT l.done AND l.it < {most})) a
        JOIN cells e ON e."user" = a."user" GROUP BY a.k, a.it, a.centres, a.c, e.dim)
      GROUP BY k, it, centres, c) GROUP BY k, it, centres))),
{name}_fit AS MATERIALIZED (SELECT k, centres FROM {name}_loop QUALIFY row_number() OVER (PARTITION BY k ORDER BY it DESC) = 1),
{name}_label AS MATERIALIZED (SELECT k, "user", x, list_position(ds, list_min(ds)) - 1 AS c, list_min(ds) AS d FROM (
  SELECT f.k, p."user", p.x, list_transform(f.centres, lambda y: list_sum(list_transform(
    range(1, len(y) + 1), lambda i: (y[i] - p.x[i]) * (y[i] - p.x[i])))) AS ds FROM {name}_fit f CROSS JOIN pts p))"""


def _silhouettes(labels: str, out: str) -> str:
    """``out (k, silhouette)``: the mean over points of labels (k, user, x, c)."""
    return f"""{out}_sum AS MATERIALIZED (SELECT k, c, count(DISTINCT l."user") AS n, e.dim, CAST(sum(e.x) AS DOUBLE) AS y
  FROM {labels} l JOIN cells e ON e."user" = l."user" GROUP BY k, c, e.dim),
{out}_stat AS MATERIALIZED (SELECT s.k, s.c, any_value(n) AS n, list(y ORDER BY dim) AS y, any_value(psi) AS psi
  FROM {out}_sum s JOIN (SELECT k, c, sum(list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE) * v))) AS psi
    FROM {labels} GROUP BY k, c) q ON q.k = s.k AND q.c = s.c GROUP BY s.k, s.c),
{out}_mean AS (SELECT l.k, l."user", l.c AS own, t.c AS other, t.n,
    list_sum(list_transform(l.x, lambda v: CAST(v AS DOUBLE) * v)) + t.psi / t.n
      - 2.0 * list_sum(list_transform(range(1, len(l.x) + 1), lambda i: l.x[i] * t.y[i])) / t.n AS m
  FROM {labels} l JOIN {out}_stat t ON t.k = l.k),
{out} AS (SELECT k, CASE WHEN max(clusters) < 2 THEN -1.0 ELSE avg(CASE WHEN n <= 1 OR greatest(a, b) = 0 THEN 0.0
    ELSE (b - a) / greatest(a, b) END) END AS silhouette
  FROM (SELECT k, "user", max(n) FILTER (own = other) AS n, count(*) AS clusters,
      max(m * n / nullif(n - 1, 0)) FILTER (own = other) AS a, min(m) FILTER (own != other) AS b
    FROM {out}_mean GROUP BY k, "user") GROUP BY k)"""


def sweep_cte() -> str:
    """Fits and scores of the sweep and ``best (k)``."""
    return f"""sweep_ks AS (SELECT k FROM (SELECT unnest(range({K_MIN}, {K_MAX + 1})) AS k)
  WHERE k <= (SELECT count(*) FROM pts)),
{fits_cte('sweep', 'sweep_ks', KMEANS_MAX_ITER)},
{_silhouettes('sweep_label', 'sweep_score')},
sweep_cost AS (SELECT k, CAST(sum(d) AS DOUBLE) / (s * s) AS inertia FROM sweep_label, grid GROUP BY k, s),
best AS MATERIALIZED (SELECT k FROM sweep_score WHERE silhouette > -1 ORDER BY silhouette DESC, k LIMIT 1)"""


def peaks_cte(k_final: str) -> str:
    """``peak_label ("user", c)`` from ``k_final``, a scalar expression."""
    return f"""coarse_ks AS (SELECT least({COARSE_K_MAX}, greatest({COARSE_K_PER_PEAK} * ({k_final}), {COARSE_K_MIN}),
  (SELECT count(*) FROM pts) - 1) AS k),
{fits_cte('coarse', 'coarse_ks', COARSE_MAX_ITER)},
dense AS MATERIALIZED (SELECT c, count(*) AS n, CAST(sum(d) AS DOUBLE) / count(*) / (s * s) AS a
  FROM coarse_label, grid GROUP BY c, s),
ranked AS (SELECT c, row_number() OVER (ORDER BY a, c) AS r, count(*) OVER () AS used FROM dense),
chosen AS MATERIALIZED (SELECT r, centres[c + 1] AS x FROM ranked, coarse_fit
  WHERE r <= greatest({k_final}, used // 2)),
rivals AS MATERIALIZED (SELECT list(x ORDER BY r) AS xs, count(*) AS m FROM chosen),
choice(j, picks, gaps) AS (
  SELECT 1, [1], list_transform(xs, lambda y: list_sum(list_transform(range(1, len(y) + 1),
    lambda i: (y[i] - xs[1][i]) * (y[i] - xs[1][i])))) FROM rivals
  UNION ALL
  SELECT j + 1, list_append(picks, pick), list_transform(range(1, m + 1), lambda q: least(gaps[q], list_sum(
      list_transform(range(1, len(xs[1]) + 1), lambda i: (xs[q][i] - xs[pick][i]) * (xs[q][i] - xs[pick][i])))))
  FROM (SELECT c.*, r.*, list_position(rest, list_max(rest)) AS pick FROM (
      SELECT *, list_transform(range(1, len(gaps) + 1), lambda q:
        CASE WHEN list_contains(picks, q) THEN -1 ELSE gaps[q] END) AS rest FROM choice) c CROSS JOIN rivals r
    WHERE j < least({k_final}, m))),
peaks AS MATERIALIZED (SELECT list_transform(picks, lambda p: xs[p]) AS xs
  FROM (SELECT picks FROM choice ORDER BY j DESC LIMIT 1), rivals),
peak_label AS MATERIALIZED (SELECT "user", x, list_position(ds, list_min(ds)) - 1 AS c, list_min(ds) AS d FROM (
  SELECT p."user", p.x, list_transform(f.xs, lambda y: list_sum(list_transform(
    range(1, len(y) + 1), lambda i: (y[i] - p.x[i]) * (y[i] - p.x[i])))) AS ds FROM peaks f CROSS JOIN pts p))"""


def fit_oracles(features_cte: str, matrix_sql: str, feature_columns: str) -> dict[str, str]:
    """SQL of the fitted queries; ``features_cte`` holds ``features``, ``matrix_sql`` reads it."""
    head = f"WITH RECURSIVE {features_cte}, {matrix_cte(matrix_sql)}"
    base = fits_cte("base", "base_ks", KMEANS_MAX_ITER)
    base_ks = f"base_ks AS (SELECT {K_BASELINE} AS k)"
    best = "(SELECT k FROM best)"

    def external(labels: str, clause: str, out: str) -> str:
        """``out (nmi, ari, purity)`` of labels (user, c) against ``truth`` (user, u)."""
        return f"""{out}_cells AS (SELECT u, c, CAST(count(*) AS DOUBLE) AS x, sum(count(*)) OVER (PARTITION BY u) AS a,
    sum(count(*)) OVER (PARTITION BY c) AS b, sum(count(*)) OVER () AS n, max(count(*)) OVER (PARTITION BY c) AS m
  FROM (SELECT * FROM {labels} {clause}) JOIN truth USING ("user") GROUP BY u, c),
{out}_sums AS (SELECT sum(x / n * ln(n * x / (a * b))) AS mi, -sum(x / n * ln(a / n)) AS hu, -sum(x / n * ln(b / n)) AS hv,
    sum(x * (x - 1) / 2) AS suv, sum(x * (a - 1) / 2) AS sa, sum(x * (b - 1) / 2) AS sb, sum(x * m / b) AS best,
    CAST(any_value(n) AS DOUBLE) AS n FROM {out}_cells),
{out} AS (SELECT round(CASE WHEN hu + hv = 0 THEN 1.0 ELSE mi / ((hu + hv) / 2) END, 4) AS nmi,
    round(CASE WHEN (sa + sb) / 2 = e THEN 1.0 ELSE (suv - e) / ((sa + sb) / 2 - e) END, 4) AS ari,
    round(best / n, 4) AS purity
  FROM (SELECT *, sa * sb / (n * (n - 1) / 2) AS e FROM {out}_sums))"""

    def record(method: str, labels: str, clause: str, score: str, cost: str, outer: str | None = None) -> str:
        return f"""SELECT {method} AS method, CAST((SELECT count(DISTINCT c) FROM {labels} {clause}) AS INTEGER) AS n_clusters,
  round(({score}), 4) AS silhouette, round(({cost}), 2) AS inertia,
  (SELECT round(sum(v2 - v * v / n), 2) FROM (SELECT c, dim, sum(value * value) AS v2, sum(value) AS v, count(*) AS n
    FROM (SELECT * FROM {labels} {clause}) JOIN matrix USING ("user") GROUP BY c, dim)) AS within_ss,
  {'CAST(NULL AS DOUBLE)' if outer is None else f'(SELECT nmi FROM {outer})'} AS nmi,
  {'CAST(NULL AS DOUBLE)' if outer is None else f'(SELECT ari FROM {outer})'} AS ari,
  {'CAST(NULL AS DOUBLE)' if outer is None else f'(SELECT purity FROM {outer})'} AS purity,
  (SELECT string_agg(c || ':' || n, ',' ORDER BY c) FROM (SELECT c, count(*) AS n FROM {labels} {clause} GROUP BY c))
    AS cluster_sizes"""

    peaks_as_k = "peak_model AS (SELECT 0 AS k, \"user\", x, c FROM peak_label)"
    whole = f"""{head}, {base_ks}, {base}, {sweep_cte()}, {peaks_cte(best)}, {peaks_as_k},
{_silhouettes('base_label', 'base_score')}, {_silhouettes('peak_model', 'peak_score')}"""
    unit = "(SELECT s * s FROM grid)"

    def records(labelled: bool) -> str:
        outer = [f"outer{i}" if labelled else None for i in range(3)]
        return "\nUNION ALL ".join([
            record("'KMeans-Baseline'", "base_label", "", "SELECT silhouette FROM base_score",
                   f"SELECT CAST(sum(d) AS DOUBLE) / {unit} FROM base_label", outer[0]),
            record(f"'KMeans-BestK(k=' || {best} || ')'", "sweep_label", f"WHERE k = {best}",
                   f"SELECT silhouette FROM sweep_score WHERE k = {best}",
                   f"SELECT inertia FROM sweep_cost WHERE k = {best}", outer[1]),
            record("'CDPC-KNN-Approx'", "peak_label", "", "SELECT silhouette FROM peak_score",
                   f"SELECT CAST(sum(d) AS DOUBLE) / {unit} FROM peak_label", outer[2])])

    truth = f"""truth AS (SELECT "user", {TRUTH_SQL} AS u FROM features),
{external('base_label', '', 'outer0')}, {external('sweep_label', f'WHERE k = {best}', 'outer1')},
{external('peak_label', '', 'outer2')}"""
    return {
        "kmeans_baseline": f"""{head}, {base_ks}, {base}
SELECT "user", CAST(c AS INTEGER) AS prediction FROM base_label""",
        "kmeans_sweep": f"""{head}, {sweep_cte()}
SELECT CAST(k AS INTEGER) AS k, round(silhouette, 6) AS silhouette, round(inertia, 6) AS inertia,
  k = {best} AS chosen FROM sweep_score JOIN sweep_cost USING (k)""",
        "density_peaks": f"""{head}, {sweep_cte()}, {peaks_cte(best)}
SELECT "user", CAST(c AS INTEGER) AS prediction FROM peak_label""",
        "density_peaks_fixed": f"""{head}, {peaks_cte(str(K_BASELINE))}
SELECT "user", CAST(c AS INTEGER) AS prediction FROM peak_label""",
        "attach_predictions": f"""{head}, {base_ks}, {base}, {sweep_cte()}, {peaks_cte(best)}
SELECT {feature_columns}, CAST(b.c AS INTEGER) AS prediction_baseline, CAST(w.c AS INTEGER) AS prediction_bestk,
  CAST(p.c AS INTEGER) AS prediction_cdpc
FROM features f JOIN base_label b ON b."user" = f."user"
  JOIN sweep_label w ON w."user" = f."user" AND w.k = {best} JOIN peak_label p ON p."user" = f."user\"""",
        "compare_methods": f"{whole} {records(False)}",
        "compare_methods_labelled": f"{whole}, {truth} {records(True)}",
    }
