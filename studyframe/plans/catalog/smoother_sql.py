"""Plain-SQL counterparts of the smoothers: cells by a recursive query, neighbourhoods by windows over all pairs.

Every function returns named CTEs. ``p`` is a prefix of their names, ``keys`` the grouping columns, ``spans`` a table (keys, span).
"""

from __future__ import annotations

# fixed values of the estimator: share of a cell, margin of the ends, tolerance of equal distances and of levels met
_CELL, _MARGIN, _ALIKE, _MET = "0.2::DOUBLE", "0.005::DOUBLE", "(1 + 1e-6::DOUBLE)", "(1 - 1e-9::DOUBLE)"


def _cols(keys: list[str], table: str = "") -> str:
    return ", ".join((f"{table}." if table else "") + k for k in keys)


def _weight(d: str, h: str, gap: str) -> str:
    return (f"CASE WHEN {h} <= {gap} * {_ALIKE} AND {d} <= {h} * {_ALIKE} THEN 1 WHEN {d} < {h} "
            f"THEN power(1 - power({d} / {h}, 3), 3) ELSE 0 END")


def vertices(p: str, base: str, keys: list[str], spans: str) -> dict[str, str]:
    """``{p}_at``: (keys, span, n, x0, gap, split, h) from ``base`` (keys, x, c, ...)."""
    k, using = _cols(keys), f"USING ({_cols(keys)})"
    uncut = "greatest(floor(n * least * {0} + 1e-5), 0)".format(_CELL)
    cut = """CASE WHEN r.cum < low_high.hi AND (r.cum - r.c <= low_high.lo OR r.cum - low_high.m <= low_high.m - (r.cum - r.c)) THEN r.cum
      WHEN r.cum - r.c > low_high.lo THEN r.cum - r.c WHEN r.cum < low_high.hi THEN r.cum END"""
    inside = f"(SELECT *, (lo + 1 + hi) // 2 AS m FROM {p}_cells WHERE hi - lo > {uncut}) low_high"
    found = f"SELECT low_high.*, {cut} AS cut FROM {inside} JOIN {p}_ranked r ON {' AND '.join(f'r.{x} = low_high.{x}' for x in keys)} AND r.cum - r.c < low_high.m AND low_high.m <= r.cum"
    return {
        f"{p}_ranked": f"SELECT *, CAST(sum(c) OVER (PARTITION BY {k} ORDER BY x) AS BIGINT) AS cum, CAST(sum(c) OVER (PARTITION BY {k}) AS BIGINT) AS n FROM {base}",
        f"{p}_cells": f"""
SELECT {_cols(keys, 'g')}, CAST(0 AS BIGINT) AS lo, g.n AS hi, g.n, s.least FROM (SELECT DISTINCT {k}, n FROM {p}_ranked) g JOIN (SELECT {k}, min(span) AS least FROM {spans} GROUP BY {k}) s {using}
UNION ALL
SELECT {k}, CASE WHEN side = 0 THEN lo ELSE cut END, CASE WHEN side = 0 THEN cut ELSE hi END, n, least
FROM ({found}) f CROSS JOIN (VALUES (0), (1)) t(side) WHERE cut IS NOT NULL""",
        f"{p}_cuts": f"SELECT {k}, n, cut, hi - lo AS size FROM ({found}) f WHERE cut IS NOT NULL",
        f"{p}_ends": f"SELECT {k}, n, min(x) AS a, max(x) AS b, {_MARGIN} * greatest(max(x) - min(x), greatest(abs(min(x)), abs(max(x))) * 1e-3::DOUBLE + 1e-30::DOUBLE) AS mu FROM {p}_ranked GROUP BY {k}, n",
        f"{p}_verts": f"""
SELECT {_cols(keys, 'u')}, s.span, u.n, (a.x + b.x) / 2 AS x0, (b.x - a.x) / 2 AS gap, u.cut AS split
FROM {p}_cuts u JOIN {spans} s {using} JOIN {p}_ranked a ON {' AND '.join(f'a.{x} = u.{x}' for x in keys)} AND a.cum = u.cut JOIN {p}_ranked b ON {' AND '.join(f'b.{x} = u.{x}' for x in keys)} AND b.cum - b.c = u.cut
WHERE u.size > floor(u.n * s.span * {_CELL} + 1e-5)
UNION ALL SELECT {_cols(keys, 'e')}, s.span, e.n, e.a - e.mu, e.mu, 0 FROM {p}_ends e JOIN {spans} s {using}
UNION ALL SELECT {_cols(keys, 'e')}, s.span, e.n, e.b + e.mu, e.mu, e.n FROM {p}_ends e JOIN {spans} s {using}""",
        f"{p}_at": f"""
SELECT {k}, span, n, x0, gap, split, min(d) AS h FROM (
  SELECT {_cols(keys, 'v')}, v.span, v.n, v.x0, v.gap, v.split, abs(r.x - v.x0) AS d, sum(r.c) OVER (PARTITION BY {_cols(keys, 'v')}, v.span, v.x0 ORDER BY abs(r.x - v.x0)) AS upto
  FROM {p}_verts v JOIN {p}_ranked r {using})
WHERE upto >= least(greatest(floor(n * span + 1e-5), 1), n) GROUP BY {k}, span, n, x0, gap, split""",
    }


def loess(p: str, base: str, keys: list[str], spans: str) -> dict[str, str]:
    """``{p}_fit``: (keys, span, x, c, m, fit, leverage) from ``base`` (keys, x, c, m): count and mean of y at each x."""
    k, using = _cols(keys), f"USING ({_cols(keys)})"
    d = "abs(r.x - v.x0)"
    hat = lambda s, rows: f"({rows[0]} + {rows[1]} * z{s} + {rows[2]} * z{s} * z{s}) * w{s}"
    value, slope = ("{0}00", "{0}01", "{0}02"), ("{0}01", "{0}11", "{0}12")
    parts = {s: (hat(s, [f"{s}." + x.format("i") for x in value]), hat(s, [f"{s}." + x.format("i") for x in slope]) + f" / {s}.h") for s in "ab"}
    return vertices(p, base, keys, spans) | {
        f"{p}_mid": f"SELECT {k}, sum(c * m) / sum(c) AS mid FROM {base} GROUP BY {k}",
        f"{p}_sums": f"""
SELECT {k}, span, n, x0, gap, split, h, mid, h <= gap * {_ALIKE} AS flat, sum(w) AS s0, sum(w*z) AS s1, sum(w*z*z) AS s2, sum(w*z*z*z) AS s3, sum(w*z*z*z*z) AS s4,
  sum(w*(m-mid)) AS t0, sum(w*z*(m-mid)) AS t1, sum(w*z*z*(m-mid)) AS t2
FROM (SELECT v.*, r.m, g.mid, (r.x - v.x0) / v.h AS z, r.c * {_weight(d, 'v.h', 'v.gap')} AS w
      FROM {p}_at v JOIN {p}_ranked r {using} JOIN {p}_mid g {using} WHERE {d} < v.h OR (v.h <= v.gap * {_ALIKE} AND {d} <= v.h * {_ALIKE}))
GROUP BY {k}, span, n, x0, gap, split, h, mid""",
        f"{p}_inv": f"""
SELECT *, CASE WHEN flat THEN 1 / s0 ELSE (s2*s4 - s3*s3) / det END AS i00, CASE WHEN flat THEN 0 ELSE (s2*s3 - s1*s4) / det END AS i01, CASE WHEN flat THEN 0 ELSE (s1*s3 - s2*s2) / det END AS i02,
  CASE WHEN flat THEN 0 ELSE (s0*s4 - s2*s2) / det END AS i11, CASE WHEN flat THEN 0 ELSE (s1*s2 - s0*s3) / det END AS i12
FROM (SELECT *, s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s2*s3) + s2*(s1*s3 - s2*s2) AS det FROM {p}_sums)""",
        f"{p}_seg": f"""
SELECT *, mid + i00*t0 + i01*t1 + i02*t2 AS f, (i01*t0 + i11*t1 + i12*t2) / h AS g, row_number() OVER (PARTITION BY {k}, span ORDER BY x0) AS nr FROM {p}_inv""",
        f"{p}_fit": f"""
SELECT {k}, span, x, c, m, (2*t*t*t - 3*t*t + 1) * af + (t*t*t - 2*t*t + t) * width * ag + (3*t*t - 2*t*t*t) * bf + (t*t*t - t*t) * width * bg AS fit,
  (2*t*t*t - 3*t*t + 1) * av + (t*t*t - 2*t*t + t) * width * asl + (3*t*t - 2*t*t*t) * bv + (t*t*t - t*t) * width * bsl AS leverage
FROM (SELECT {_cols(keys, 'q')}, q.span, q.x, q.c, q.m, q.t, q.width, q.af, q.ag, q.bf, q.bg, {parts['a'][0]} AS av, {parts['a'][1]} AS asl, {parts['b'][0]} AS bv, {parts['b'][1]} AS bsl
  FROM (SELECT {_cols(keys, 'r')}, a.span, r.x, r.c, r.m, b.x0 - a.x0 AS width, (r.x - a.x0) / (b.x0 - a.x0) AS t, a.f AS af, a.g AS ag, b.f AS bf, b.g AS bg, a, b,
          (r.x - a.x0) / a.h AS za, (r.x - b.x0) / b.h AS zb, {_weight('abs(r.x - a.x0)', 'a.h', 'a.gap')} AS wa, {_weight('abs(r.x - b.x0)', 'b.h', 'b.gap')} AS wb
        FROM {p}_ranked r JOIN {p}_seg a {using} JOIN {p}_seg b ON {' AND '.join(f'b.{x} = a.{x}' for x in keys)} AND b.span = a.span AND b.nr = a.nr + 1
        WHERE r.cum > a.split AND r.cum <= b.split) q)""",
    }


def aicc(p: str, rows: str, keys: list[str], x: str, y: str) -> dict[str, str]:
    """``{p}_score``: (keys, span, n, trace, aicc) of ``{p}_fit`` against the rows."""
    k = _cols(keys)
    return {f"{p}_score": f"""
SELECT {k}, span, n, trace, ln(rss / (n - 1)) + 1 + 2 * (trace + 1) / (n - trace - 2) AS aicc
FROM (SELECT {_cols(keys, 'o')}, f.span, count(*) AS n, sum(f.leverage) AS trace, sum((o.{y} - f.fit) * (o.{y} - f.fit)) AS rss
      FROM {rows} o JOIN {p}_fit f ON {' AND '.join(f'f.{q} = o.{q}' for q in keys)} AND f.x = o.{x} WHERE o.{y} IS NOT NULL GROUP BY {_cols(keys, 'o')}, f.span)"""}


def quantiles(p: str, rows: str, keys: list[str], spans: str, wanted: str) -> dict[str, str]:
    """``{p}_curve``: (keys, curve, tau, span, x, c, fit, own) from ``rows`` (keys, x, v); ``wanted`` has (keys, curve, tau, span)."""
    k, using = _cols(keys), f"USING ({_cols(keys)})"
    d = "abs(r.x - v.x0)"
    return {f"{p}_base": f"SELECT {k}, x, count(*) AS c FROM {rows} GROUP BY {k}, x"} | vertices(p, f"{p}_base", keys, spans) | {
        f"{p}_weights": f"""
SELECT *, sum(w) OVER (PARTITION BY {k}, span, x0 ORDER BY val) AS upto, sum(w) OVER (PARTITION BY {k}, span, x0) AS total
FROM (SELECT {_cols(keys, 'v')}, v.span, v.x0, v.split, r.v AS val, {_weight(d, 'v.h', 'v.gap')} AS w
      FROM {p}_at v JOIN {rows} r {using} WHERE {d} < v.h OR (v.h <= v.gap * {_ALIKE} AND {d} <= v.h * {_ALIKE}))""",
        f"{p}_points": f"""
SELECT *, row_number() OVER (PARTITION BY {k}, curve, tau, span ORDER BY x0) AS nr FROM (
  SELECT {_cols(keys, 'q')}, c.curve, c.tau, q.span, q.x0, q.split, min(q.val) FILTER (WHERE q.upto >= c.tau * q.total * {_MET}) AS f, 1 / max(q.total) AS own
  FROM {p}_weights q JOIN {wanted} c ON {' AND '.join(f'c.{x} = q.{x}' for x in keys)} AND c.span = q.span GROUP BY {_cols(keys, 'q')}, c.curve, c.tau, q.span, q.x0, q.split)""",
        f"{p}_curve": f"""
SELECT {_cols(keys, 'r')}, a.curve, a.tau, a.span, r.x, r.c, a.f + (r.x - a.x0) / (b.x0 - a.x0) * (b.f - a.f) AS fit, a.own + (r.x - a.x0) / (b.x0 - a.x0) * (b.own - a.own) AS own
FROM {p}_ranked r JOIN {p}_points a {using} JOIN {p}_points b ON {' AND '.join(f'b.{x} = a.{x}' for x in keys)} AND b.curve = a.curve AND b.span = a.span AND b.nr = a.nr + 1
WHERE r.cum > a.split AND r.cum <= b.split""",
    }


def bic(p: str, rows: str, keys: list[str]) -> dict[str, str]:
    """``{p}_bic``: (keys, curve, tau, span, bic), the best span of each curve of ``{p}_curve``."""
    k = _cols(keys)
    return {f"{p}_bic": f"""
SELECT {k}, curve, tau, span, bic FROM (SELECT {k}, curve, tau, span, 2 * n * ln(loss / n) + ln(n) * edf AS bic FROM (
  SELECT {_cols(keys, 'c')}, c.curve, c.tau, c.span, count(*) AS n, sum(c.own) AS edf, sum((o.v - c.fit) * (c.tau - CASE WHEN o.v < c.fit THEN 1 ELSE 0 END)) AS loss
  FROM {rows} o JOIN {p}_curve c ON {' AND '.join(f'c.{x} = o.{x}' for x in keys)} AND c.x = o.x GROUP BY {_cols(keys, 'c')}, c.curve, c.tau, c.span))
QUALIFY row_number() OVER (PARTITION BY {k}, curve ORDER BY round(bic, 9), span DESC) = 1"""}
