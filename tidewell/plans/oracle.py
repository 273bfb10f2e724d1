"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

import math

from tidewell.functions.student import t_quantile
from tidewell.operators.sleep import COLE_KRIPKE, SADEH, WEBSTER


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


RAW = "act AS (SELECT event_type AS pid, ts, value AS x FROM events)"
USER = "act AS (SELECT CAST(user_id AS VARCHAR) AS pid, ts, value AS x FROM events)"
DENSE = """minutes AS (SELECT event_type AS pid, date_trunc('minute', ts) AS ts, round(sum(value) * 4.0::DOUBLE, 2) AS a FROM events GROUP BY 1, 2),
spans AS (SELECT pid, min(ts) AS f, max(ts) AS l FROM minutes GROUP BY pid),
grid AS (SELECT pid, unnest(generate_series(f, l, INTERVAL 1 MINUTE)) AS ts FROM spans),
act AS (SELECT g.pid, g.ts, coalesce(m.a, 0.0) AS x FROM grid g LEFT JOIN minutes m ON g.pid = m.pid AND g.ts = m.ts)"""


def binned(width: int = 60) -> str:
    p = 1440 // width
    return f"""bins AS (SELECT pid, CAST(ts AS DATE) AS day, CAST(floor((hour(ts) * 60 + minute(ts)) / {width}) AS INTEGER) AS pos, sum(x) AS x FROM act WHERE x IS NOT NULL GROUP BY 1, 2, 3),
fulls AS (SELECT pid, day, pos, x FROM (SELECT *, count(*) OVER (PARTITION BY pid, day) AS c FROM bins) WHERE c = {p}),
days AS (SELECT pid, count(*) // {p} AS n_days FROM fulls GROUP BY pid),
profile AS (SELECT pid, pos, avg(x) AS x, count(*) AS n FROM fulls GROUP BY pid, pos)"""


def stability(min_days: int, width: int = 60) -> str:
    p = 1440 // width
    return f"""SELECT pid, CASE WHEN n_days >= {min_days} AND lo < hi THEN round(n * hs / ({p} * ss), 6) + 0.0 END AS interdaily_stability
FROM (SELECT f.pid, any_value(d.n_days) AS n_days, count(*) AS n, sum((f.x - m.m) ** 2) AS ss, min(f.x) AS lo, max(f.x) AS hi FROM fulls f JOIN days d ON f.pid = d.pid JOIN (SELECT pid, avg(x) AS m FROM fulls GROUP BY pid) m ON f.pid = m.pid GROUP BY f.pid)
JOIN (SELECT p.pid, sum((p.x - m.m) ** 2) AS hs FROM profile p JOIN (SELECT pid, avg(x) AS m FROM fulls GROUP BY pid) m ON p.pid = m.pid GROUP BY p.pid) USING (pid)"""


def variability(width: int = 60) -> str:
    return f"""SELECT pid, CASE WHEN lo < hi THEN round(steps / ((n - 1) * v), 6) + 0.0 END AS intradaily_variability
FROM (SELECT pid, count(*) AS n, sum(CASE WHEN dt <= {width} THEN dx * dx END) AS steps, var_pop(x) AS v, min(x) AS lo, max(x) AS hi
  FROM (SELECT *, x - lag(x) OVER w AS dx, k - lag(k) OVER w AS dt FROM (SELECT *, datediff('day', DATE '1970-01-01', day) * 1440 + pos * {width} AS k FROM fulls) WINDOW w AS (PARTITION BY pid ORDER BY k)) GROUP BY pid)"""


def period(kind: str, width: int, name: str) -> str:
    order = "s, pos" if kind == "min" else "s DESC, pos"
    return f"""SELECT pid, {r(f"s / n / {width}", name + "_value")}, CAST(pos * 60 AS INTEGER) AS {name}_onset_min FROM (
  SELECT pid, pos, s, n, row_number() OVER (PARTITION BY pid ORDER BY {order}) AS k FROM (
    SELECT pid, pos, n, sum(x) OVER (PARTITION BY pid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) AS s
    FROM (SELECT pid, pos, round(n * x, 6) AS x, n FROM profile UNION ALL SELECT pid, pos + 24, round(n * x, 6), n FROM profile)) WHERE pos < 24) WHERE k = 1"""


def cosine(width: int = 60, places: int = 6) -> str:
    p = 1440 // width
    k, e = (2 / p, 0.5) if p > 2 else (1 / p, 1.0)
    w = 2 * math.pi / p
    return f"""SELECT pid, CASE WHEN lo < hi THEN round(m, {places}) + 0.0 END AS mesor, CASE WHEN lo < hi THEN round(sqrt(b * b + g * g), {places}) + 0.0 END AS cosinor_amplitude,
  CASE WHEN lo < hi THEN round((CASE WHEN atan2(g, b) < 0 THEN atan2(g, b) + 2 * pi() ELSE atan2(g, b) END) * (24 / (2 * pi())), {places}) + 0.0 END AS acrophase_hours,
  CASE WHEN lo < hi THEN round((b * b + g * g) * {e}::DOUBLE / v, {places}) + 0.0 END AS cosinor_r_squared
FROM (SELECT pid, avg(x) AS m, sum(x * cos(pos * {w!r}::DOUBLE)) * {k!r}::DOUBLE AS b, sum(x * sin(pos * {w!r}::DOUBLE)) * {k!r}::DOUBLE AS g, var_pop(x) AS v, min(x) AS lo, max(x) AS hi FROM profile GROUP BY pid)"""


_CK = " + ".join(f"coalesce(lag(x, {4 - k}) OVER w, 0.0) * {w}.0::DOUBLE" if k < 4 else (f"x * {w}.0::DOUBLE" if k == 4 else f"coalesce(lead(x, {k - 4}) OVER w, 0.0) * {w}.0::DOUBLE") for k, w in enumerate(COLE_KRIPKE))
CK = f"ck AS (SELECT pid, ts, CAST(CASE WHEN ({_CK}) * 1e-5::DOUBLE >= 1.0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM act WINDOW w AS (PARTITION BY pid ORDER BY ts))"
_RESCUE = " OR ".join(f"(n <= {a} AND m >= {b})" for a, b in WEBSTER)
LABELS = f"""{CK},
marked AS (SELECT pid, ts, label, sum(c) OVER (PARTITION BY pid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY pid ORDER BY ts) THEN 1 ELSE 0 END AS c FROM ck)),
runs AS (SELECT pid, run, any_value(label) AS l, count(*) AS n FROM marked GROUP BY pid, run),
near AS (SELECT *, least(coalesce(lag(n) OVER w, 0), coalesce(lead(n) OVER w, 0)) AS m FROM runs WINDOW w AS (PARTITION BY pid ORDER BY run)),
labels_ AS (SELECT k.pid, k.ts, CAST(CASE WHEN l = 0 AND ({_RESCUE}) THEN 1 ELSE label END AS INTEGER) AS label FROM marked k JOIN near USING (pid, run))"""
ONSETS = """onsets AS (SELECT pid, day, CAST(pos * 60 AS INTEGER) AS onset_min FROM (
  SELECT pid, day, pos, row_number() OVER (PARTITION BY pid, day ORDER BY s, pos) AS k FROM (
    SELECT pid, day, pos, sum(x) OVER (PARTITION BY pid, day ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s
    FROM (SELECT pid, day, pos, round(x, 6) AS x FROM fulls UNION ALL SELECT pid, day, pos + 24, round(x, 6) FROM fulls)) WHERE pos < 24) WHERE k = 1)"""
EPOCHS = """windows_ AS (SELECT pid, day, CAST(day AS TIMESTAMP) + to_minutes(onset_min - 30) AS s, CAST(day AS TIMESTAMP) + to_minutes(onset_min + 360) AS e FROM onsets),
epochs AS (SELECT w.pid, w.day, l.ts, l.label FROM windows_ w JOIN labels_ l ON w.pid = l.pid AND l.ts BETWEEN w.s AND w.e)"""
NIGHTS = """nights AS (SELECT pid, day, tst, coalesce(g - f + 1 - tst, 0) AS waso, tst / n AS efficiency, coalesce(f, n) AS sol FROM (
  SELECT pid, day, count(*) AS n, count(*) FILTER (label = 0) AS tst, min(k) FILTER (label = 0) AS f, max(k) FILTER (label = 0) AS g
  FROM (SELECT *, row_number() OVER (PARTITION BY pid, day ORDER BY ts) - 1 AS k FROM epochs) GROUP BY pid, day) WHERE n >= 30)"""
SLEEP = """sleep AS (SELECT a.pid, CASE WHEN d.n_days >= 3 THEN m.tst / 60 END AS tst_hours, CASE WHEN d.n_days >= 3 AND m.tst IS NOT NULL THEN a.asleep / d.n_days / 60 END AS tst_24h_hours,
  CASE WHEN d.n_days >= 3 THEN m.waso END AS waso_min, CASE WHEN d.n_days >= 3 THEN m.efficiency END AS sleep_efficiency, CASE WHEN d.n_days >= 3 THEN m.sol END AS sol_min
  FROM (SELECT pid, count(*) FILTER (label = 0) AS asleep FROM labels_ GROUP BY pid) a LEFT JOIN days d ON a.pid = d.pid
  LEFT JOIN (SELECT pid, avg(tst) AS tst, avg(waso) AS waso, avg(efficiency) AS efficiency, avg(sol) AS sol FROM nights GROUP BY pid) m ON a.pid = m.pid)"""

COHORT = "(['control', 'depression', 'schizophrenia', 'adhd', 'clinical'])[user_id % 5 + 1]"
META = f"meta AS (SELECT user_id AS number, count(DISTINCT CAST(ts AS DATE)) AS days, user_id % 2 + 1 AS gender, user_id % 50 + 20 AS age, {COHORT} AS cohort FROM events GROUP BY user_id)"
FEATURES = f"""feats AS (SELECT user_id AS "user", CAST(ts AS DATE) AS day, {COHORT} AS class, avg(value) AS mean, stddev_samp(value) AS sd, avg(CASE WHEN value < 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS "pctZeros", quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
  FROM events WHERE user_id % 5 < 3 GROUP BY 1, 2, 3)"""
SIX = ("mean", "sd", "pctZeros", "median", "q25", "q75")
FIVE = ("mean", "sd", "pctZeros", "median", "q75")
LEVEL = f"""level AS (SELECT * FROM (SELECT "user", {", ".join(f'avg("{c}") AS "{c}"' for c in FIVE)} FROM feats GROUP BY "user") JOIN (SELECT "user", class FROM (SELECT "user", class, row_number() OVER (PARTITION BY "user" ORDER BY count(*) DESC, class) AS k FROM feats GROUP BY "user", class) WHERE k = 1) USING ("user"))"""
TEMPORAL = f"""temporal AS (SELECT CAST(coalesce(a.pid, b.pid) AS BIGINT) AS "user", coalesce(intradaily_variability, 0.0) AS variability, coalesce(interdaily_stability, 0.0) AS stability FROM ({variability(720)}) a FULL JOIN ({stability(7, 720)}) b ON a.pid = b.pid)"""
PRED = "pred AS (SELECT l.doc_id, l.quality AS y_true, CAST(CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS INTEGER) AS y_pred, CAST(d.n_chars AS DOUBLE) AS score, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
PRED_FOLD = "predf AS (SELECT * FROM pred WHERE CAST(('0x' || substr(md5('0:' || doc_id), 1, 8)) AS BIGINT) % 5 = 0)"
PEOPLE = "people AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS pid FROM events)"


def hashed(reps: int, where: str = "true") -> str:
    return f"folds AS (SELECT rep, CAST(CAST(('0x' || substr(md5(rep || ':' || pid), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold, pid FROM people, (SELECT CAST(unnest(range({reps})) AS INTEGER) AS rep) WHERE {where})"


def cells(keys: str) -> str:
    k, kk = (f"{keys}, ", f"{keys}, ") if keys else ("", "")
    return f"cells AS (SELECT {k}label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT {kk}y_true AS label, CAST(y_true = y_pred AS INTEGER) AS tp, 0 AS fp, CAST(y_true <> y_pred AS INTEGER) AS fn FROM pred UNION ALL SELECT {kk}y_pred, 0, CAST(y_true <> y_pred AS INTEGER), 0 FROM pred) GROUP BY {k}label)"


def auc(keys: str, source: str = "pred") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"SELECT {head}round((sum(CASE WHEN y_true = 1 THEN rk END) - p * (p + 1) / 2) / (p * (n - p)), 6) + 0.0 AS auc FROM (SELECT *, rank() OVER ({part}ORDER BY score) + (count(*) OVER (PARTITION BY {head}score) - 1) / 2 AS rk, count(*) OVER ({part.strip()}) AS n, sum(y_true) OVER ({part.strip()}) AS p FROM {source}) {group + (', ' if group else 'GROUP BY ')}p, n"


REPS = "reps AS (SELECT CASE WHEN event_id % 2 = 0 THEN '2class' ELSE '3class' END AS task, CASE WHEN user_id % 2 = 0 THEN 'distributional' ELSE 'combined' END AS feature_set, event_id % 20 AS rep, avg(value) AS score FROM events GROUP BY 1, 2, 3)"
_T = "(CASE n " + " ".join(f"WHEN {k + 1} THEN {t_quantile(0.975, k)!r}::DOUBLE" for k in range(1, 20)) + " END)"
SUMMARY = f"summary AS (SELECT task, feature_set, n AS n_reps, round(m, 4) AS mean_f1, round(s, 4) AS sd_f1, round(m - {_T} * s / sqrt(n), 4) AS ci_lo_mean, round(m + {_T} * s / sqrt(n), 4) AS ci_hi_mean FROM (SELECT task, feature_set, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s FROM reps GROUP BY 1, 2))"
ACROPHASE = f"acro AS (SELECT c.*, m.cohort AS class, m.gender = 1 AS hosp FROM ({cosine(720, 8)}) c JOIN meta m ON c.pid = CAST(m.number AS VARCHAR))"
PROFILES = "minute_means AS (SELECT pid, hour(ts) * 60 + minute(ts) AS minute, avg(x) AS x FROM act GROUP BY 1, 2), profiles AS (SELECT p.pid, 'control' AS label, CAST(g.minute AS INTEGER) AS minute, coalesce(m.x, 0.0) AS x FROM (SELECT DISTINCT pid FROM act) p CROSS JOIN (SELECT unnest(range(1440)) AS minute) g LEFT JOIN minute_means m ON p.pid = m.pid AND g.minute = m.minute), cohorts AS (SELECT label, minute, count(*) AS n, avg(x) AS mean, stddev_pop(x) / sqrt(count(*)) AS sem FROM profiles GROUP BY 1, 2)"


def acrophases(by: str, where: str) -> str:
    return f"SELECT {by}, count(*) AS n, {r('median(acrophase_hours)', 'median')}, {r('avg(acrophase_hours)', 'mean')}, {r('min(acrophase_hours)', 'least')}, {r('max(acrophase_hours)', 'most')} FROM acro WHERE acrophase_hours IS NOT NULL AND {where} GROUP BY {by}"


def q(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def six(columns=SIX) -> str:
    return ", ".join(r(f'"{c}"', f'"{c}"') for c in columns)


RECORDED = "recorded AS (SELECT event_type AS pid, (['control', 'depression', 'schizophrenia'])[ascii(event_type) % 3 + 1] AS label, date_trunc('second', ts) AS ts, value AS activity FROM events)"
EMB = """emb AS (SELECT CAST(vec_id AS VARCHAR) AS pid, label AS y FROM embeddings), people AS (SELECT DISTINCT pid FROM emb)"""
#: Ranks by hash cut into consecutive folds.
RANKED = """ranked AS (SELECT rep, CAST(CASE WHEN k < n % 5 * (n // 5 + 1) THEN k // (n // 5 + 1) ELSE n % 5 + (k - n % 5 * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold, pid
  FROM (SELECT rep, pid, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || ':' || pid), pid) - 1 AS k, count(*) OVER (PARTITION BY rep) AS n
        FROM people, (SELECT CAST(unnest(range(4)) AS INTEGER) AS rep)))"""

#: The greedy assignment, one group after another.
GROUPED = """WITH RECURSIVE sizes AS (SELECT n, row_number() OVER (ORDER BY n DESC, g) AS i FROM (SELECT user_id AS g, count(*) AS n FROM events GROUP BY 1)),
steps AS (
  SELECT CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS groups
  UNION ALL
  SELECT s.i, list_transform(t.loads, lambda x, k: CASE WHEN k = list_position(t.loads, list_min(t.loads)) THEN x + s.n ELSE x END),
         list_transform(t.groups, lambda x, k: CASE WHEN k = list_position(t.loads, list_min(t.loads)) THEN x + 1 ELSE x END)
  FROM steps t JOIN sizes s ON s.i = t.i + 1),
last AS (SELECT * FROM steps ORDER BY i DESC LIMIT 1)
SELECT CAST(k AS INTEGER) AS fold, groups[k + 1] AS groups, loads[k + 1] AS load FROM last, (SELECT unnest(range(5)) AS k)"""

DRAWN = """tested AS (SELECT f.rep, f.fold, f.pid, e.y FROM folds f JOIN emb e ON f.pid = e.pid),
every AS (SELECT y, count(*) AS n FROM emb GROUP BY y),
mine AS (SELECT rep, fold, y, count(*) AS n FROM tested GROUP BY 1, 2, 3),
shares AS (SELECT g.rep, g.fold, e.y, sum(e.n - coalesce(m.n, 0)) OVER (PARTITION BY g.rep, g.fold ORDER BY e.y) AS upto, sum(e.n - coalesce(m.n, 0)) OVER (PARTITION BY g.rep, g.fold) AS total
  FROM (SELECT DISTINCT rep, fold FROM folds) g CROSS JOIN every e LEFT JOIN mine m ON m.rep = g.rep AND m.fold = g.fold AND m.y = e.y),
drawn AS (SELECT *, CAST(CAST(('0x' || substr(md5('0:' || rep || ':' || pid), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM tested)"""

ORACLE = {
    "s4_scan_cohort": q(META, body="SELECT number, days, gender, age, number % 7 AS acc_time, cohort FROM meta WHERE cohort = 'control'"),
    "s5_scan_metadata": q(META, body="SELECT number, days, gender, age, CASE WHEN cohort = 'control' THEN number % 7 END AS acc_time, CASE WHEN cohort IN ('adhd', 'clinical') THEN number % 7 END AS adhd, cohort FROM meta"),
    "s6_scan_features": q(FEATURES, body=f'SELECT "user", class, {six()} FROM feats'),
    "s8_scan_recordings": q(RECORDED, body="SELECT pid, label, ts, activity FROM recorded"),
    "s10_scan_cohort_dir": q(RECORDED, body="SELECT pid, 'mine' AS label, ts, activity FROM recorded WHERE label = 'control'"),
    "s11_scan_all_recordings": q(RECORDED, body="SELECT pid, label, ts, activity FROM recorded WHERE label IN ('control', 'depression')"),
    "s12_s13_folds_read_back": q(PEOPLE, hashed(2), body="SELECT rep, fold, pid FROM folds"),
    "s14_results_read_back": q(REPS, SUMMARY, body="SELECT * FROM summary"),
    "s15_predictions_read_back": q(PRED, body="SELECT doc_id, y_true, y_pred, score, toxic FROM pred"),
    "p8_temporal_columns": q(USER, binned(720), FEATURES, LEVEL, TEMPORAL, body=f'SELECT l."user", {r("t.variability", "variability")}, {r("t.stability", "stability")} FROM level l JOIN temporal t ON l."user" = t."user"'),
    "p9_distributional_columns": q(USER, binned(720), FEATURES, LEVEL, TEMPORAL, body='SELECT l."user", ' + ", ".join(r(f'coalesce(l."{c}", 0.0)', f'"{c}"') for c in FIVE) + ' FROM level l JOIN temporal t ON l."user" = t."user"'),
    "m2_dummy": q(EMB, hashed(20), DRAWN, body="SELECT d.rep, d.fold, d.pid, d.y AS y_true, min(s.y) AS y_pred FROM drawn d JOIN shares s ON d.rep = s.rep AND d.fold = s.fold WHERE d.u * s.total < s.upto GROUP BY d.rep, d.fold, d.pid, d.y"),
    "p1_min_days_filter": q(META, body="SELECT * FROM meta WHERE days >= 20"),
    "p2_exclude_features": q(FEATURES, body=f'SELECT "user", day, class, {six(FIVE)} FROM feats'),
    "p4_clip_fill": f"SELECT event_type AS pid, ts, {r('greatest(coalesce(value, 0) - 20, 0.0)', 'activity')} FROM events",
    "p5_relabel_binary": q(META, body="SELECT number, CASE WHEN cohort = 'control' THEN 'control' ELSE 'patient' END AS label FROM meta"),
    "p6_binary_codes": q(META, body="SELECT number, CAST(cohort <> 'control' AS INTEGER) AS code FROM meta"),
    "p7_label_encode": q(META, body="SELECT number, cohort, CAST(dense_rank() OVER (ORDER BY cohort) - 1 AS INTEGER) AS code FROM meta"),
    "p10_r2_filter": q(USER, binned(720), META, ACROPHASE, body="SELECT * FROM acro WHERE cosinor_r_squared >= 0.5"),
    "p11_p12_amplitudes": q(RAW, binned(), body=f"SELECT pid, round(m - l, 6) + 0.0 AS amplitude, round((m - l) / nullif(m + l, 0), 6) + 0.0 AS relative_amplitude, o / 60 AS onset_hours FROM (SELECT pid, l_value AS l, l_onset_min AS o FROM ({period('min', 5, 'l').replace('round(s / n / 5, 6) + 0.0', 's / n / 5')})) JOIN (SELECT pid, m_value AS m FROM ({period('max', 10, 'm').replace('round(s / n / 10, 6) + 0.0', 's / n / 10')})) USING (pid)"),
    "j1_valid_users": q(META, FEATURES, body=f'SELECT "user", day, class, {six()} FROM feats WHERE "user" IN (SELECT number FROM meta WHERE days >= 20)'),
    "j2_join_features": q(USER, binned(720), FEATURES, LEVEL, TEMPORAL, body=f'SELECT l."user", l.class, {", ".join(r(f"l.{chr(34)}{c}{chr(34)}", f"{chr(34)}{c}{chr(34)}") for c in FIVE)}, t.variability, t.stability FROM level l JOIN temporal t ON l."user" = t."user"'),
    "j3_with_setting": q(META, body="""SELECT number AS "user", CASE WHEN number % 3 = 0 THEN (gender = 1)::VARCHAR END AS hosp FROM meta"""),
    "j4_fold_membership": q(PEOPLE, hashed(2), body="SELECT g.rep, g.fold, p.pid, f.pid IS NOT NULL AS is_test FROM people p CROSS JOIN (SELECT DISTINCT rep, fold FROM folds) g LEFT JOIN folds f ON f.rep = g.rep AND f.fold = g.fold AND f.pid = p.pid"),
    "j7_epochs_of_nights": q(DENSE, binned(), LABELS, ONSETS, EPOCHS, body="SELECT pid, day, count(*) AS n, min(ts) AS first, max(ts) AS last, CAST(sum(label) AS BIGINT) AS awake FROM epochs GROUP BY pid, day"),
    "j8_fixture_rows": q(PEOPLE, hashed(2), FEATURES, body="""SELECT f.rep, f.fold, r.idx FROM folds f JOIN (SELECT CAST("user" AS VARCHAR) AS pid, CAST(max(datediff('day', DATE '2024-01-01', day)) AS INTEGER) AS idx FROM feats GROUP BY 1) r USING (pid)"""),
    "j9_compare_folds": q(PEOPLE, body="SELECT pid, 'extra' AS side FROM people WHERE CAST(pid AS BIGINT) % 5 >= 3 UNION ALL SELECT 'new' || pid, 'missing' FROM people WHERE CAST(pid AS BIGINT) % 50 = 0"),
    "t1_bin_activity": q(RAW, binned(), body=f"SELECT pid, day, pos, {r('x', 'x')} FROM bins"),
    "t2_full_day_dates": q(RAW, binned(), body="SELECT DISTINCT pid, day FROM fulls"),
    "t3_count_full_days": q(RAW, binned(), body="SELECT b.pid, coalesce(d.n_days, 0) AS n_days FROM (SELECT DISTINCT pid FROM bins) b LEFT JOIN days d ON b.pid = d.pid"),
    "t4_keep_full_days": q(RAW, binned(), body=f"SELECT pid, day, pos, {r('x', 'x')} FROM fulls"),
    "t5_min_days_gate": q(RAW, binned(), body=f"SELECT a.pid, CASE WHEN d.n_days >= 5 THEN v.intradaily_variability END AS intradaily_variability FROM (SELECT DISTINCT pid FROM act) a LEFT JOIN days d ON a.pid = d.pid LEFT JOIN ({variability()}) v ON a.pid = v.pid"),
    "t7_daily_profile": q(RAW, binned(), body=f"SELECT pid, pos, {r('x', 'x')}, n FROM profile"),
    "t8_circular_window": q(RAW, binned(), body=f"SELECT pid, {r('s', 'total')}, pos FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY s DESC, pos) AS k FROM (SELECT pid, pos, sum(x) OVER (PARTITION BY pid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS s FROM (SELECT pid, pos, round(x, 6) AS x FROM profile UNION ALL SELECT pid, pos + 24, round(x, 6) FROM profile)) WHERE pos < 24) WHERE k = 1"),
    "t9_minute_profile": q(RAW, PROFILES, body=f"SELECT pid, label, minute, {r('x', 'x')} FROM profiles"),
    "t10_cohort_profile": q(RAW, PROFILES, body=f"SELECT label, minute, n, {r('mean', 'mean')}, {r('sem', 'sem')} FROM cohorts"),
    "t11_circular_smooth": q(RAW, PROFILES, body=f"SELECT a.label, a.minute, {r('avg(b.mean)', 'mean')}, {r('avg(b.sem)', 'sem')} FROM cohorts a JOIN cohorts b ON a.label = b.label AND least((a.minute - b.minute + 1440) % 1440, (b.minute - a.minute + 1440) % 1440) <= 10 GROUP BY 1, 2"),
    "c1_interdaily_stability": q(RAW, binned(), body=stability(7)),
    "c1_stability_by_user": q(USER, binned(720), body=stability(7, 720)),
    "c2_intradaily_variability": q(RAW, binned(), body=variability()),
    "c2_variability_by_user": q(USER, binned(720), body=variability(720)),
    "c3_least_active_period": q(RAW, binned(), body=period("min", 5, "l")),
    "c4_most_active_period": q(RAW, binned(), body=period("max", 10, "m")),
    "c5_cosinor": q(RAW, binned(), body=cosine()),
    "c5_cosinor_by_user": q(USER, binned(720), body=cosine(720, 8)),
    "c7_extract_features": q(DENSE, binned(), LABELS, ONSETS, EPOCHS, NIGHTS, SLEEP, body=f"""SELECT a.pid, 'control' AS label, i.interdaily_stability, v.intradaily_variability, l.l_value AS l5_value, l.l_onset_min / 60 AS l5_onset_hours, m.m_value AS m10_value, m.m_onset_min / 60 AS m10_onset_hours,
  {r('mm.m_value - ll.l_value', 'amplitude')}, {r('(mm.m_value - ll.l_value) / nullif(mm.m_value + ll.l_value, 0)', 'relative_amplitude')}, c.mesor, c.cosinor_amplitude, c.acrophase_hours, c.cosinor_r_squared,
  {", ".join(r("s." + x, x) for x in ("tst_hours", "tst_24h_hours", "waso_min", "sleep_efficiency", "sol_min"))}
FROM (SELECT DISTINCT pid FROM act) a LEFT JOIN ({stability(7)}) i ON a.pid = i.pid LEFT JOIN ({variability()}) v ON a.pid = v.pid LEFT JOIN ({period("min", 5, "l")}) l ON a.pid = l.pid LEFT JOIN ({period("max", 10, "m")}) m ON a.pid = m.pid
LEFT JOIN ({period("min", 5, "l").replace("round(s / n / 5, 6) + 0.0", "s / n / 5")}) ll ON a.pid = ll.pid LEFT JOIN ({period("max", 10, "m").replace("round(s / n / 10, 6) + 0.0", "s / n / 10")}) mm ON a.pid = mm.pid
LEFT JOIN ({cosine()}) c ON a.pid = c.pid LEFT JOIN sleep s ON a.pid = s.pid"""),
    "z1_cole_kripke": q(DENSE, CK, body="SELECT pid, ts, label FROM ck"),
    "z2_webster_rules": q(DENSE, LABELS, body="SELECT pid, ts, label FROM labels_"),
    "z3_sadeh": q(DENSE, body=f"""SELECT pid, ts, CAST(CASE WHEN {SADEH[0]}::DOUBLE - {SADEH[1]}::DOUBLE * m - {SADEH[2]}::DOUBLE * len(list_filter(w, lambda y: y > 50 AND y <= 100)) - {SADEH[3]}::DOUBLE * sqrt(list_sum(list_transform(w, lambda y: (y - m) * (y - m))) / 11) - {SADEH[4]}::DOUBLE * ln(1 + x) < 0 THEN 1 ELSE 0 END AS INTEGER) AS label
FROM (SELECT *, list_sum(w) / 11 AS m FROM (SELECT pid, ts, x, [{", ".join(f"coalesce(lag(x, {-k}) OVER w, 0.0)" if k < 0 else ("x" if k == 0 else f"coalesce(lead(x, {k}) OVER w, 0.0)") for k in range(-5, 6))}] AS w FROM act WINDOW w AS (PARTITION BY pid ORDER BY ts)))"""),
    "z5_rest_onsets": q(DENSE, binned(), ONSETS, body="SELECT pid, day, onset_min FROM onsets"),
    "z6_sleep_metrics": q(DENSE, binned(), LABELS, ONSETS, EPOCHS, NIGHTS, SLEEP, body=f"SELECT pid, {', '.join(r(x, x) for x in ('tst_hours', 'tst_24h_hours', 'waso_min', 'sleep_efficiency', 'sol_min'))} FROM sleep"),
    "a1_participant_level": q(FEATURES, LEVEL, body=f'SELECT "user", class, {six(FIVE)} FROM level'),
    "a2_class_balance": q(META, FEATURES, body="SELECT coalesce(m.cohort, f.class) AS cohort, coalesce(participants, 0) AS participants, coalesce(feature_rows, 0) AS feature_rows FROM (SELECT cohort, count(DISTINCT number) AS participants FROM meta GROUP BY cohort) m FULL JOIN (SELECT class, count(*) AS feature_rows FROM feats GROUP BY class) f ON m.cohort = f.class"),
    "a3_days_distribution": q(META, body=f"SELECT cohort, count(days) AS n, min(days) AS least, {r('quantile_cont(days, 0.25)', 'q25')}, {r('quantile_cont(days, 0.5)', 'median')}, {r('quantile_cont(days, 0.75)', 'q75')}, max(days) AS most FROM meta GROUP BY cohort"),
    "a4_feature_distributions": q(FEATURES, body=f"SELECT class, feature, count(*) AS n, {r('min(v)', 'least')}, {r('quantile_cont(v, 0.5)', 'median')}, {r('max(v)', 'most')} FROM (" + " UNION ALL ".join(f"SELECT class, '{c}' AS feature, \"{c}\" AS v FROM feats" for c in SIX) + ") WHERE v IS NOT NULL GROUP BY 1, 2"),
    "a5_feature_correlation": q(FEATURES, body=" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(\"{a}\", \"{b}\"), 6) + 0.0 AS r FROM feats" for a in SIX for b in SIX)),
    "a7_acrophase_summary": q(USER, binned(720), META, ACROPHASE, body=acrophases("class", "cosinor_r_squared >= 0.5")),
    "a8_load_summary": q(FEATURES, body='SELECT class, count(*) AS n_rows, count(DISTINCT "user") AS n_users FROM feats GROUP BY ROLLUP (class)'),
    "a9_hosp_probe": q(USER, binned(720), META, ACROPHASE, body=acrophases("class, hosp", "true")),
    "a10_impute_median": q(FEATURES, body=f"""SELECT "user", day, {r('coalesce(mean, (SELECT median(mean) FROM feats))', 'mean')}, {r('coalesce(sd, (SELECT median(sd) FROM feats))', 'sd')} FROM feats"""),
    "f1_hashed_folds": q(PEOPLE, hashed(4), body="SELECT rep, fold, pid FROM folds"),
    "f1_repeated_folds": q(PEOPLE, RANKED, body="SELECT rep, fold, pid FROM ranked"),
    "f2_fold_invariants": q(PEOPLE, RANKED, """faulty AS (SELECT * FROM ranked WHERE NOT (CAST(pid AS BIGINT) % 7 = 0 AND rep = 1)
  UNION ALL SELECT * FROM ranked WHERE CAST(pid AS BIGINT) % 11 = 0 AND rep = 2)""", body="SELECT pid, count(*) AS n FROM faulty GROUP BY pid HAVING count(*) <> 4 OR count(DISTINCT rep) <> 4"),
    "f5_group_kfold": GROUPED,
    "m5_macro_f1": q(PRED, cells("toxic"), body=f"SELECT toxic, {r('avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0))', 'macro_f1')} FROM cells GROUP BY toxic"),
    "m6_per_class_metrics": q(PRED, cells(""), body=f"SELECT label, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}, CAST(tp + fn AS BIGINT) AS support FROM cells"),
    "m7_confusion_normalized": q(PRED, body=f"""SELECT t.toxic, t.l AS y_true, p.l AS y_pred, {r('coalesce(n / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY t.toxic, t.l), 0), 0)', 'share')}
FROM (SELECT toxic, y_true AS l FROM pred UNION SELECT toxic, y_pred FROM pred) t JOIN (SELECT toxic, y_true AS l FROM pred UNION SELECT toxic, y_pred FROM pred) p ON t.toxic = p.toxic
LEFT JOIN (SELECT toxic, y_true, y_pred, count(*) AS n FROM pred GROUP BY 1, 2, 3) c ON c.toxic = t.toxic AND c.y_true = t.l AND c.y_pred = p.l"""),
    "m8_confusion_fold": q(PRED, PRED_FOLD, body=f"""SELECT t.l AS y_true, p.l AS y_pred, {r('coalesce(n / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY t.l), 0), 0)', 'share')}
FROM (SELECT y_true AS l FROM predf UNION SELECT y_pred FROM predf) t JOIN (SELECT y_true AS l FROM predf UNION SELECT y_pred FROM predf) p ON true
LEFT JOIN (SELECT y_true, y_pred, count(*) AS n FROM predf GROUP BY 1, 2) c ON c.y_true = t.l AND c.y_pred = p.l"""),
    "m9_roc_auc": q(PRED, body=auc("toxic")),
    "m9_roc_auc_macro": q(PRED, "both_ AS (SELECT 'a' AS label, y_true, score FROM pred UNION ALL SELECT 'b', 1 - y_true, -score FROM pred)", body=f"SELECT {r('avg(auc)', 'auc')} FROM ({auc('label', 'both_')})"),
    "m12_rep_scores": f"SELECT task, feature_set, rep, {r('avg(f)', 'score')} FROM (SELECT CASE WHEN event_id % 2 = 0 THEN '2class' ELSE '3class' END AS task, CASE WHEN user_id % 2 = 0 THEN 'distributional' ELSE 'combined' END AS feature_set, CAST(event_id % 20 AS INTEGER) AS rep, user_id % 5 AS fold, avg(value) AS f FROM events GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
    "m13_summarize_reps": q(REPS, SUMMARY, body="SELECT * FROM summary"),
    "m14_paired_summary": q(REPS, body=f"SELECT label, n AS n_reps, round(m, 4) AS mean_diff, round(s, 4) AS sd_diff, round(m - {_T} * s / sqrt(n), 4) AS ci_lo_diff, round(m + {_T} * s / sqrt(n), 4) AS ci_hi_diff, round(p, 3) AS frac_positive FROM (SELECT a.task || '/combined-distributional' AS label, count(*) AS n, avg(b.score - a.score) AS m, stddev_samp(b.score - a.score) AS s, avg(CAST(b.score - a.score > 0 AS INTEGER)) AS p FROM reps a JOIN reps b ON a.task = b.task AND a.rep = b.rep AND a.feature_set = 'distributional' AND b.feature_set = 'combined' GROUP BY 1)"),
    "m15_results_tables_paired": q(REPS, body=f"SELECT label, n AS n_reps, round(m, 4) AS mean_diff, round(s, 4) AS sd_diff, round(m - {_T} * s / sqrt(n), 4) AS ci_lo_diff, round(m + {_T} * s / sqrt(n), 4) AS ci_hi_diff, round(p, 3) AS frac_positive FROM (SELECT a.task || '/combined-distributional' AS label, count(*) AS n, avg(b.score - a.score) AS m, stddev_samp(b.score - a.score) AS s, avg(CAST(b.score - a.score > 0 AS INTEGER)) AS p FROM reps a JOIN reps b ON a.task = b.task AND a.rep = b.rep AND a.feature_set = 'distributional' AND b.feature_set = 'combined' GROUP BY 1)"),
    "m15_results_tables": q(REPS, SUMMARY, body="SELECT * FROM summary"),
    "m19_comparison_table": q(REPS, SUMMARY, body="SELECT task, feature_set, mean_f1 AS height, round(mean_f1 - ci_lo_mean, 4) AS error_low, round(ci_hi_mean - mean_f1, 4) AS error_high FROM summary"),
    "m20_combined_matrix": q(USER, binned(720), FEATURES, LEVEL, TEMPORAL, body=f'SELECT l."user", l.class, list_transform([{", ".join(f"coalesce(l.{chr(34)}{c}{chr(34)}, 0.0)" for c in FIVE)}, t.variability, t.stability], lambda y: round(y, 6) + 0.0) AS features FROM level l JOIN temporal t ON l."user" = t."user"'),
}

#: The kept frame has the rows of the frame made at once.
ORACLE["c7_kept_features"] = ORACLE["c7_extract_features"]
