"""Plain-SQL definitions of the study-shaped views, to be inlined as CTEs."""

from __future__ import annotations

VIEWS = {
    "fx_study": ("""
SELECT user_id AS ID_ORIG,
  CASE WHEN user_id % 2 = 0 THEN 'Caffeine' ELSE 'Placebo' END AS TRT,
  CASE WHEN event_type IN ('view','click','error') THEN 'Plasma' ELSE 'Urine' END AS MAT,
  event_id AS SAMPLE,
  CASE WHEN event_id % 53 = 0 THEN NULL ELSE ts END AS DATST,
  CASE WHEN event_type IN ('purchase','signup') THEN ts + INTERVAL '2' HOUR END AS DATEN,
  CASE WHEN event_type IN ('purchase','signup') THEN CAST(0.1 + 0.001 * (event_id % 900) AS DOUBLE) END AS VOL,
  CAST(130 + event_id % 17 AS DOUBLE) AS SOD, CAST(60 + event_id % 60 AS DOUBLE) AS SECR,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE 2.0 + value / 1000 END AS CAL,
  CAST(100 + event_id % 11 AS DOUBLE) AS NACL,
  CASE WHEN event_id % 7 = 0 OR user_id % 31 = 0 THEN NULL ELSE CAST(5 + (event_id % 40) / 8.0 AS DOUBLE) END AS CRCL,
  CAST(1 + event_id % 5 AS DOUBLE) AS CACL
FROM events""", []),
    "fx_obs": ("""
SELECT user_id AS ID, user_id AS ID_ORIG, event_id AS OBS,
  CASE WHEN user_id % 2 = 0 THEN 'Caffeine' ELSE 'Placebo' END AS TRT,
  CAST((extract(DAY FROM ts) % 2) * 1440 + extract(HOUR FROM ts) * 60 + extract(MINUTE FROM ts) AS BIGINT) AS tick,
  CAST((extract(DAY FROM ts) % 2) * 1440 + extract(HOUR FROM ts) * 60 + extract(MINUTE FROM ts) AS DOUBLE) / 60 AS time,
  value AS CALAMT FROM events""", []),
    "fx_pred": ("""
SELECT ID_ORIG, OBS, tick, time, 20 + 0.5::DOUBLE * time + 0.01::DOUBLE * (OBS % 100) AS P_PRED FROM fx_obs""",
                ["fx_obs"]),
    "fx_sim": ("""
SELECT o.ID, o.ID_ORIG, o.OBS, o.TRT, o.tick, o.time, s.SIM,
  o.CALAMT * (0.8::DOUBLE + 0.02::DOUBLE * ((o.OBS * 7 + s.SIM * 13) % 21)) AS P
FROM fx_obs o CROSS JOIN (SELECT o_orderkey + 1 AS SIM FROM orders WHERE o_orderkey < 20) s""",
               ["fx_obs"]),
    "fx_event": ("""
SELECT user_id AS ID, event_id AS REC,
  CAST((extract(DAY FROM ts) - 1) * 86400 + extract(HOUR FROM ts) * 3600 + extract(MINUTE FROM ts) * 60 AS BIGINT) AS tick,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS evid,
  CASE WHEN event_type = 'signup' THEN CAST(100 + user_id % 5 * 25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS amt,
  CASE WHEN event_type = 'signup' THEN 25 ELSE 26 END AS cmt, 0 AS rate, value AS UCA FROM events""", []),
    "fx_points": ("""
SELECT p_brand AS dataset, CAST(1 + p_partkey % 400 AS DOUBLE) / 4 AS Conc,
  100 * (CAST(1 + p_partkey % 400 AS DOUBLE) / 4) / (30 + CAST(1 + p_partkey % 400 AS DOUBLE) / 4) + ((p_partkey * 37) % 11 - 5) AS Eff FROM part""", []),
    "fx_subject": ("""
SELECT c_custkey AS ID, CAST(60 + c_custkey % 60 AS DOUBLE) AS secr, CAST(20 + c_custkey % 60 AS DOUBLE) AS age,
  c_custkey % 2 AS sex, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS black,
  CAST(50 + c_custkey % 60 AS DOUBLE) AS wt, CAST(150 + c_custkey % 45 AS DOUBLE) AS ht, c_mktsegment AS grp FROM customer""", []),
    # cleaned observation rows
    "obs": ("""
SELECT s.*, k.ID, CASE WHEN MAT = 'Plasma' THEN 6 ELSE 31 END AS cmt, 0.0::DOUBLE AS amt, 0 AS evid, 0 AS rate,
  CAL * coalesce(VOL, 14) AS CALAMT,
  date_diff('microsecond', origin, DATST) / 3.6e9 AS time,
  date_diff('microsecond', origin, DATEN) / 3.6e9 AS TIMEEND,
  date_diff('microsecond', origin, DATEN) / 3.6e9 - date_diff('microsecond', origin, DATST) / 3.6e9 AS dTIME,
  CASE WHEN g > 7.2 THEN 7.2 ELSE g END AS GFR_0, b.P_0
FROM fx_study s
JOIN (SELECT ID_ORIG, row_number() OVER (ORDER BY ID_ORIG) AS ID,
        CAST(CAST(min(DATST) AS DATE) AS TIMESTAMP) + INTERVAL '23' HOUR AS origin, avg(CRCL) AS g
      FROM fx_study GROUP BY ID_ORIG) k USING (ID_ORIG)
LEFT JOIN (SELECT ID_ORIG, CAL * coalesce(VOL, 14) AS P_0,
        row_number() OVER (PARTITION BY ID_ORIG ORDER BY DATST NULLS LAST, SAMPLE) AS n
      FROM fx_study WHERE MAT = 'Plasma') b ON b.ID_ORIG = s.ID_ORIG AND b.n = 1""", ["fx_study"]),
    "event_table": ("""
SELECT * FROM obs
UNION ALL BY NAME
SELECT f.* EXCLUDE (n, SAMPLE, DATST, DATEN, VOL, SOD, SECR, CAL, NACL, CRCL, CACL, TIMEEND, CALAMT, MAT, cmt, evid, rate, time, amt),
  'Dose' AS MAT, 25 AS cmt, 1 AS evid, 0 AS rate, t.time, CASE WHEN TRT = 'Caffeine' THEN 200.0 ELSE 0.0 END::DOUBLE AS amt
FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY DATST NULLS LAST, SAMPLE) AS n FROM obs) f
CROSS JOIN (VALUES (2.0::DOUBLE), (4.0), (6.0), (8.0), (26.0), (28.0), (30.0), (32.0)) t(time)
WHERE f.n = 1
UNION ALL BY NAME
SELECT * EXCLUDE (time, evid), TIMEEND AS time, 1 AS evid FROM obs WHERE TIMEEND IS NOT NULL""", ["obs"]),
}


def query(body: str, *views: str, recursive: bool = False, **more: str) -> str:
    """``WITH`` the needed views (and extra named CTEs) in front of a SELECT."""
    order: list[str] = []

    def need(name: str) -> None:
        for inner in VIEWS[name][1]:
            need(inner)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    ctes = [f"{v} AS ({VIEWS[v][0]})" for v in order]
    ctes += [f"{name} AS ({sql})" for name, sql in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
