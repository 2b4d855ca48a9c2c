"""Independent SQL (DuckDB dialect) for each registered query.

Written from the operator definitions, not from the Spark code: splits
use ``row_number()`` over the md5 order against ceil cut-offs, quantiles
use ``quantile_cont``, windows stand in for the bucketed ranks.
"""

from __future__ import annotations

from loam.plans.standins import SOIL_SQL

_SOIL = f"soil AS ({SOIL_SQL})"


def _split_cte(table: str, key: str, cols: str = "*") -> str:
    return f"""
    r AS (
      SELECT {cols},
             row_number() OVER (ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key}) - 1 AS rk,
             count(*) OVER () AS n
      FROM {table}),
    s AS (
      SELECT *,
        CASE WHEN rk < ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test'
             WHEN rk < ceil(CAST(0.2 AS DOUBLE) * n)
                       + ceil(CAST(0.15 AS DOUBLE) * (n - ceil(CAST(0.2 AS DOUBLE) * n))) THEN 'val'
             ELSE 'train' END AS split
      FROM r)"""


_EVENT_PREDS = (
    "WITH "
    + _split_cte("events", "event_id", "event_id, event_type, value AS y")
    + """,
    gm AS (SELECT event_type, avg(y) AS m FROM s WHERE split = 'train' GROUP BY event_type),
    gl AS (SELECT avg(y) AS m FROM s WHERE split = 'train'),
    p AS (
      SELECT s.event_id, s.split, s.y, 'group_mean' AS model, round(coalesce(gm.m, gl.m), 2) AS pred
      FROM s LEFT JOIN gm ON s.event_type = gm.event_type CROSS JOIN gl
      UNION ALL
      SELECT s.event_id, s.split, s.y, 'global_mean', round(gl.m, 2) FROM s CROSS JOIN gl
      UNION ALL
      SELECT s.event_id, s.split, s.y, 'zero', CAST(0.0 AS DOUBLE) FROM s)"""
)

_METRICS = """
    m AS (
      SELECT model, split, count(*) AS n,
             avg((y - pred) * (y - pred)) AS mse,
             sqrt(avg((y - pred) * (y - pred))) AS rmse,
             avg(abs(y - pred)) AS mae,
             CASE WHEN var_pop(y) > 0
                  THEN 1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) END AS r2,
             avg((y - pred) * (y - pred)) <= 1 AS suspicious,
             avg((y - pred) * (y - pred)) < 0.78 AS goal_met
      FROM p GROUP BY model, split)"""

_RES = _EVENT_PREDS + """,
    res AS (SELECT event_id, split, y - pred AS residual FROM p WHERE model = 'group_mean')"""


def _profile_sql() -> str:
    cols = [
        ("p_partkey", "CAST(p_partkey AS DOUBLE)"),
        ("p_name", "CAST(length(p_name) AS DOUBLE)"),
        ("p_brand", "CAST(length(p_brand) AS DOUBLE)"),
        ("p_type", "CAST(length(p_type) AS DOUBLE)"),
        ("p_size", "CAST(p_size AS DOUBLE)"),
        ("p_retailprice", "p_retailprice"),
    ]
    parts = [
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
        f"min({e} + 0.0) AS min_value, max({e} + 0.0) AS max_value FROM part"
        for c, e in cols
    ]
    return "\nUNION ALL\n".join(parts)


_FEATS = ["p25_4", "p9_5", "p4_8", "p2_0", "p0_42", "p0_076", "ll", "ip", "w_opt", "d_max"]
_LIMITS = {
    "p25_4": (0.0, 100.0), "p9_5": (0.0, 100.0), "p4_8": (0.0, 100.0), "p2_0": (0.0, 100.0),
    "p0_42": (0.0, 100.0), "p0_076": (0.0, 100.0), "ll": (0.0, 100.0), "ip": (0.0, 80.0),
    "w_opt": (5.0, 40.0), "d_max": (1200.0, 2200.0),
}
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _range_valid_sql() -> str:
    cond = " AND ".join(f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in _LIMITS.items())
    return f"WITH {_SOIL} SELECT * FROM soil WHERE {cond}"


def _range_violations_sql() -> str:
    parts = [
        f"SELECT {_KEYS}, '{c}' AS rule, {c} AS value, CAST({lo} AS DOUBLE) AS lo, "
        f"CAST({hi} AS DOUBLE) AS hi FROM soil WHERE NOT ({c} BETWEEN {lo} AND {hi})"
        for c, (lo, hi) in _LIMITS.items()
    ]
    return f"WITH {_SOIL} " + "\nUNION ALL\n".join(parts)


_RATIOS = """
    p9_5 / (p25_4 + 1e-6) AS ratio_9_25,
    p4_8 / (p9_5 + 1e-6) AS ratio_4_9,
    p2_0 / (p4_8 + 1e-6) AS ratio_2_4,
    p0_42 / (p2_0 + 1e-6) AS ratio_042_2,
    p0_076 / (p0_42 + 1e-6) AS ratio_076_042"""

_CLEAN_JOB = f"""
WITH {_SOIL}, j AS (
  SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_suppkey, li.l_returnflag AS flag,
         {", ".join("CASE WHEN " + c + " BETWEEN 1 AND 3000 THEN " + c + " END AS " + c for c in _FEATS + ["cbr"])}
  FROM soil s JOIN lineitem li
    ON s.l_orderkey = li.l_orderkey AND s.l_linenumber = li.l_linenumber
   AND s.l_partkey = li.l_partkey AND s.l_suppkey = li.l_suppkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, flag,
       p25_4, p9_5, p4_8, p2_0, p0_42, p0_076, ll, ip, w_opt, d_max, cbr
FROM j WHERE {" AND ".join(c + " IS NOT NULL" for c in _FEATS + ["cbr"])}
"""

_CUST_MASK = """
  SELECT c_custkey,
         CASE WHEN c_nationkey BETWEEN 1 AND 3000 THEN c_nationkey END AS c_nationkey,
         CASE WHEN c_acctbal BETWEEN 1 AND 3000 THEN c_acctbal END AS c_acctbal
  FROM customer"""

_HIST = _RES + """,
    st AS (SELECT split, count(*) AS n, min(residual + 0.0) AS mn, max(residual + 0.0) AS mx,
                  quantile_cont(residual, 0.25) AS q1, quantile_cont(residual, 0.75) AS q3
           FROM res GROUP BY split),
    w AS (SELECT *, (mx - mn) / (log2(n) + 1.0) AS sturges,
                 greatest(2.0 * (q3 - q1) * pow(n, -1.0 / 3.0), (mx - mn) / sqrt(n) / 2.0) AS fd FROM st),
    nb AS (SELECT split, CASE WHEN mx <= mn THEN mn - 0.5 ELSE mn END AS mn, CASE WHEN mx <= mn THEN mx + 0.5 ELSE mx END AS mx,
             CAST(CASE WHEN mx <= mn THEN 1
                  ELSE greatest(1, ceil((mx - mn) / least(fd, sturges)))
                  END AS INTEGER) AS k FROM w),
    bins AS (SELECT nb.*, CAST(b.range AS INTEGER) AS bin FROM (SELECT *, unnest(range(0, k)) AS range FROM nb) AS b JOIN nb USING (split)),
    cnt AS (SELECT res.split,
               CAST(CASE WHEN nb.mx > nb.mn
                    THEN least(floor((residual - nb.mn) * nb.k / (nb.mx - nb.mn)), nb.k - 1) ELSE 0 END AS INTEGER) AS bin,
               count(*) AS c
            FROM res JOIN nb ON res.split = nb.split GROUP BY 1, 2)
SELECT bins.split, bins.bin,
       round(bins.mn + bins.bin * ((bins.mx - bins.mn) / bins.k), 6) AS bin_lo,
       round(bins.mn + (bins.bin + 1) * ((bins.mx - bins.mn) / bins.k), 6) AS bin_hi,
       coalesce(cnt.c, 0) AS n
FROM bins LEFT JOIN cnt ON bins.split = cnt.split AND bins.bin = cnt.bin
"""

_KDE = _RES + """,
    st AS (SELECT split, count(*) AS n, stddev_samp(residual) AS sd, min(residual) AS mn,
                  max(residual) AS mx FROM res GROUP BY split),
    p2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st),
    p3 AS (SELECT *, mn - 3.0 * bw AS g0 FROM p2),
    p4 AS (SELECT *, (mx + 3.0 * bw - g0) / 199 AS step FROM p3),
    g AS (SELECT p4.*, CAST(t.range AS INTEGER) AS i, g0 + t.range * step AS x FROM p4, range(0, 200) t)
SELECT g.split, g.i AS grid_index, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * pow((g.x - res.residual) / g.bw, 2))) / (g.n * g.bw * sqrt(2 * pi())), 6) AS density
FROM g JOIN res ON g.split = res.split
GROUP BY g.split, g.i, g.x, g.n, g.bw
"""

_EARLY = """
WITH h AS (
  SELECT event_type AS config,
         CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
         round(avg(value), 6) AS val_loss
  FROM events GROUP BY 1, 2),
h2 AS (SELECT *, min(val_loss) OVER (PARTITION BY config ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min FROM h),
h3 AS (SELECT *, max(CASE WHEN prev_min IS NULL OR val_loss < prev_min THEN epoch END)
                 OVER (PARTITION BY config ORDER BY epoch
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM h2),
st AS (SELECT config, coalesce(min(CASE WHEN epoch - last_imp >= 5 THEN epoch END), max(epoch)) AS stop_epoch
       FROM h3 GROUP BY config),
b AS (SELECT h.config, st.stop_epoch, h.epoch, h.val_loss,
             row_number() OVER (PARTITION BY h.config ORDER BY h.val_loss, h.epoch) AS rn,
             count(*) OVER (PARTITION BY h.config) AS cnt
      FROM h JOIN st ON h.config = st.config WHERE h.epoch <= st.stop_epoch)
SELECT config, stop_epoch, epoch AS best_epoch, val_loss AS best_metric, cnt AS epochs_run
FROM b WHERE rn = 1
"""

ORACLE: dict[str, str] = {
    "scan_profile": _profile_sql(),
    "canonical_columns": f"WITH {_SOIL} SELECT * FROM soil",
    "parse_locale_number": "SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS acctbal FROM customer",
    "parse_locale_bad_column": """
        SELECT c_custkey,
               CASE WHEN c_custkey = 1 THEN 'n/d'
                    ELSE translate(format('{:,.2f}', c_acctbal), ',.', '.,') END AS acctbal
        FROM customer""",
    "parse_decimal_comma": "SELECT p_partkey, CASE WHEN p_size = 13 THEN NULL ELSE p_retailprice END AS price FROM part",
    "mask_outliers": _CUST_MASK,
    "drop_incomplete": f"SELECT * FROM ({_CUST_MASK}) WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL",
    "cleaning_report": f"""
        SELECT count(*) AS rows_before,
               count(*) FILTER (WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL) AS rows_after,
               count(*) - count(*) FILTER (WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL) AS rows_removed
        FROM ({_CUST_MASK})""",
    "clean_job": _CLEAN_JOB,
    "range_valid": _range_valid_sql(),
    "range_violations": _range_violations_sql(),
    "ratio_features": f"""WITH {_SOIL} SELECT {_KEYS}, {_RATIOS},
        ll - ip AS atividade, d_max / (w_opt + 1e-6) AS compacidade, p0_076 * p0_076 AS finos_sq FROM soil""",
    "scenario_features": f"""WITH {_SOIL} SELECT {_KEYS}, p4_8, p2_0, p0_42, p0_076, ll, ip,
        p2_0 / (p4_8 + 1e-6) AS ratio_2_4, p0_42 / (p2_0 + 1e-6) AS ratio_042_2,
        p0_076 / (p0_42 + 1e-6) AS ratio_076_042, ll - (ll - ip) AS atividade,
        p0_076 * p0_076 AS finos_sq FROM soil""",
    "target_log1p": """SELECT event_id, round(ln(1 + value), 6) AS y_log,
        round(exp(ln(1 + value)) - 1, 6) AS y_back FROM events""",
    "target_range": """SELECT round(min(value + 0.0), 6) AS y_min, round(max(value + 0.0), 6) AS y_max,
        round(min(ln(1 + value)), 6) AS log_min, round(max(ln(1 + value)), 6) AS log_max FROM events""",
    "sample_weights": """SELECT event_id,
        CASE WHEN value > 25 THEN 3.0 ELSE 1.0 END::DOUBLE AS weight,
        CASE WHEN value > 25 THEN 3.0 ELSE 1.0 END::DOUBLE AS weight_log FROM events""",
    "holdout_split": "WITH " + _split_cte("orders", "o_orderkey", "o_orderkey") + " SELECT o_orderkey, split FROM s",
    "holdout_sizes": "WITH " + _split_cte("orders", "o_orderkey", "o_orderkey")
    + " SELECT split, count(*) AS n_rows FROM s GROUP BY split",
    "kfold_assign": """
        WITH r AS (SELECT o_orderkey,
                     row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS rk,
                     count(*) OVER () AS n FROM orders),
        c AS (SELECT *, n // 10 AS q, n % 10 AS rem FROM r)
        SELECT o_orderkey,
               CAST(CASE WHEN rk < rem * (q + 1) THEN rk // (q + 1)
                         ELSE rem + (rk - rem * (q + 1)) // q END AS INTEGER) AS fold
        FROM c""",
    "row_index": """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index
        FROM orders WHERE o_orderstatus <> 'P'""",
    "row_index_text": """SELECT c_name, c_nationkey, row_number() OVER (ORDER BY c_name, c_nationkey) - 1 AS row_index FROM customer""",
    "row_index_wide": """SELECT o_orderkey + 1152921504606846976 AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders""",
    "row_index_hot": """SELECT o_orderstatus, CAST(o_orderdate AS VARCHAR) AS day, o_orderkey,
               row_number() OVER (ORDER BY o_orderstatus, CAST(o_orderdate AS VARCHAR), o_orderkey) - 1 AS row_index FROM orders""",
    "minmax_scale": "WITH "
    + _split_cte("part", "p_partkey",
                 "p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CAST(1.0 AS DOUBLE) AS const")
    + """,
        mm AS (SELECT min(size + 0.0) AS a1, max(size + 0.0) AS b1, min(price + 0.0) AS a2,
                      max(price + 0.0) AS b2, min(const + 0.0) AS a3, max(const + 0.0) AS b3
               FROM s WHERE split = 'train')
        SELECT p_partkey,
          round((size - a1) / CASE WHEN b1 = a1 THEN 1.0 ELSE b1 - a1 END, 6) AS size,
          round((price - a2) / CASE WHEN b2 = a2 THEN 1.0 ELSE b2 - a2 END, 6) AS price,
          round((const - a3) / CASE WHEN b3 = a3 THEN 1.0 ELSE b3 - a3 END, 6) AS const,
          split
        FROM s CROSS JOIN mm""",
    "weighted_mean_baseline": "WITH "
    + _split_cte("events", "event_id", "event_id, value AS y")
    + """,
        w AS (SELECT *, CASE WHEN y > 25 THEN 3.0 ELSE 1.0 END AS wt FROM s),
        m AS (SELECT sum(wt * y) / sum(wt) AS pred FROM w WHERE split = 'train')
        SELECT split, count(*) AS n, round(any_value(pred), 6) AS pred,
               round(avg((y - pred) * (y - pred)), 6) AS mse
        FROM w CROSS JOIN m GROUP BY split""",
    "voting_mean": "WITH "
    + _split_cte("events", "event_id", "event_id, event_type, value AS y")
    + """,
        w AS (SELECT *, CASE WHEN y > 25 THEN 3.0 ELSE 1.0 END AS wt FROM s),
        a AS (SELECT avg(y) AS m1, sum(wt * y) / sum(wt) AS m2 FROM w WHERE split = 'train'),
        t AS (SELECT event_type, avg(y) AS m3 FROM w WHERE split = 'train' GROUP BY event_type),
        x AS (SELECT w.event_id, w.split, a.m1, a.m2, coalesce(t.m3, a.m1) AS m3
              FROM w CROSS JOIN a LEFT JOIN t ON w.event_type = t.event_type WHERE w.split <> 'train')
        SELECT event_id, split, round(m1, 6) AS pred_mean, round(m2, 6) AS pred_wmean,
               round(m3, 6) AS pred_type_mean, round((m1 + m2 + m3) / 3, 6) AS pred FROM x""",
    "regression_metrics": _EVENT_PREDS + "," + _METRICS + """
        SELECT model, split, n, round(mse, 6) AS mse, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
               round(r2, 6) AS r2, suspicious, goal_met FROM m""",
    "metrics_wide": _EVENT_PREDS + "," + _METRICS + """,
        g AS (SELECT * FROM m WHERE model = 'group_mean'),
        l AS (SELECT split, 'mse' AS metric, mse AS v FROM g UNION ALL
              SELECT split, 'rmse', rmse FROM g UNION ALL
              SELECT split, 'mae', mae FROM g UNION ALL
              SELECT split, 'r2', r2 FROM g)
        SELECT metric, round(max(v) FILTER (WHERE split = 'val'), 6) AS val,
               round(max(v) FILTER (WHERE split = 'test'), 6) AS test
        FROM l GROUP BY metric""",
    "model_comparison": _EVENT_PREDS + "," + _METRICS + """
        SELECT model, round(mse, 6) AS mse, 0.78::DOUBLE AS goal_mse, mse < 0.78 AS goal_met,
               round(mse - 0.78, 6) AS gap_to_goal FROM m WHERE split = 'test'""",
    "mae_summary": _EVENT_PREDS + "," + _METRICS + """
        SELECT model, split, printf('+-%.2f', mae) AS typical_error FROM m WHERE model = 'group_mean'""",
    "residuals": _RES + " SELECT event_id, split, round(residual, 6) AS residual FROM res",
    "pred_vs_actual_limits": _EVENT_PREDS + """
        SELECT split, round(least(min(y + 0.0), min(pred + 0.0)) * 0.95, 6) AS lim_lo,
               round(greatest(max(y + 0.0), max(pred + 0.0)) * 1.05, 6) AS lim_hi
        FROM p WHERE model = 'group_mean' GROUP BY split""",
    "residual_histogram": _HIST,
    "residual_kde": _KDE,
    "residual_kde_binned": f"SELECT split, grid_index, x, round(density, 4) AS density FROM ({_KDE.replace('sqrt(2 * pi())), 6)', 'sqrt(2 * pi())), 12)')})",
    "search_rank": """
        WITH r AS (SELECT user_id AS draw, round(avg(value), 6) AS mae_val FROM events GROUP BY user_id)
        SELECT draw, mae_val, CAST(row_number() OVER (ORDER BY mae_val, draw) AS INTEGER) AS rank,
               row_number() OVER (ORDER BY mae_val, draw) = 1 AS is_best FROM r""",
    "search_best": """
        WITH r AS (SELECT event_type AS model, user_id AS draw, round(avg(value), 6) AS mae_val
                   FROM events GROUP BY 1, 2),
        o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mae_val, draw) AS rn,
                     count(*) OVER (PARTITION BY model) AS n_configs FROM r)
        SELECT model, draw, mae_val AS best_mae_val, n_configs FROM o WHERE rn = 1""",
    "early_stop": _EARLY,
}

ORACLE["extratrees_split"] = f"""
WITH {_SOIL},
c AS (SELECT 'p4_8' AS feature, 0 AS f, min(p4_8) AS mn, max(p4_8) AS mx FROM soil
      UNION ALL SELECT 'w_opt', 1, min(w_opt), max(w_opt) FROM soil
      UNION ALL SELECT 'd_max', 2, min(d_max), max(d_max) FROM soil),
t AS (SELECT feature, f, mn + CAST(('0x' || substring(md5('42:0:0:' || f), 1, 8)) AS BIGINT)
                         / 4294967296.0 * (mx - mn) AS thr FROM c),
v AS (SELECT t.feature, t.thr,
        count(*) FILTER (WHERE x <= t.thr) AS n_left,
        count(*) FILTER (WHERE x > t.thr) AS n_right,
        var_pop(cbr) AS vp,
        var_pop(cbr) FILTER (WHERE x <= t.thr) AS vl,
        var_pop(cbr) FILTER (WHERE x > t.thr) AS vr
      FROM t JOIN (SELECT 'p4_8' AS feature, p4_8 AS x, cbr FROM soil
                   UNION ALL SELECT 'w_opt', w_opt, cbr FROM soil
                   UNION ALL SELECT 'd_max', d_max, cbr FROM soil) s ON s.feature = t.feature
      GROUP BY t.feature, t.thr),
g AS (SELECT *, vp - coalesce(vl, 0) * n_left / (n_left + n_right)
                   - coalesce(vr, 0) * n_right / (n_left + n_right) AS gain FROM v)
SELECT feature, round(thr, 6) AS threshold, n_left, n_right, round(gain, 4) AS gain,
       gain = max(gain) OVER () AS is_best
FROM g
"""

ORACLE["mlp_forward"] = """
WITH x AS (SELECT p_partkey, p_size / 50.0 AS x1, (p_retailprice - 900.0) / 100.0 AS x2 FROM part),
h AS (SELECT p_partkey, x1 * 0.5 + x2 * 0.25 + 0.1 AS z1, x1 * -0.3 + x2 * 0.8 + -0.2 AS z2 FROM x),
a AS (SELECT p_partkey, CASE WHEN z1 > 0 THEN z1 ELSE 0.1 * z1 END AS a1,
                        CASE WHEN z2 > 0 THEN z2 ELSE 0.1 * z2 END AS a2 FROM h)
SELECT p_partkey, round(a1 * 1.5 + a2 * -0.7 + 0.05, 6) AS y_hat FROM a
"""

ORACLE["score_alerts"] = """
SELECT event_id, round(value, 2) AS pred_2dp,
       CASE WHEN value < 2 THEN 'very_low' WHEN value > 100 THEN 'atypical' ELSE 'normal' END AS alert
FROM events
"""

ORACLE["stream_alerts"] = ORACLE["score_alerts"]

#: The ten features and the target.
_ALL_COLUMNS = "p25_4 p9_5 p4_8 p2_0 p0_42 p0_076 ll ip w_opt d_max cbr".split()

_KEYCAT = ("'42:' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' "
           "|| CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR)")
ORACLE["score_pipeline_baseline"] = f"""
WITH {_SOIL},
c AS (SELECT * FROM soil WHERE p4_8 BETWEEN 1 AND 3000 AND p2_0 BETWEEN 1 AND 3000
        AND p0_42 BETWEEN 1 AND 3000 AND p0_076 BETWEEN 1 AND 3000 AND ll BETWEEN 1 AND 3000
        AND ip BETWEEN 1 AND 3000 AND cbr BETWEEN 1 AND 3000),
r AS (SELECT c.*, row_number() OVER (ORDER BY md5({_KEYCAT}), {_KEYS}) - 1 AS rk,
             count(*) OVER () AS n FROM c),
s AS (SELECT *, CASE WHEN rk < ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test'
                     WHEN rk < ceil(CAST(0.2 AS DOUBLE) * n)
                               + ceil(CAST(0.15 AS DOUBLE) * (n - ceil(CAST(0.2 AS DOUBLE) * n))) THEN 'val'
                     ELSE 'train' END AS split FROM r),
m AS (SELECT sum(w * lab) / sum(w) AS mu
      FROM (SELECT ln(1 + cbr) AS lab, CASE WHEN cbr > 25 THEN 3.0 ELSE 1.0 END AS w
            FROM s WHERE split IN ('train', 'val'))),
v AS (SELECT {_KEYS} FROM soil WHERE p4_8 BETWEEN 0 AND 100 AND p2_0 BETWEEN 0 AND 100
        AND p0_42 BETWEEN 0 AND 100 AND p0_076 BETWEEN 0 AND 100 AND ll BETWEEN 0 AND 100
        AND ip BETWEEN 0 AND 80)
SELECT {_KEYS}, round(exp(mu) - 1, 6) AS cbr_pred, round(round(exp(mu) - 1, 2), 6) AS cbr_pred_2dp,
       CASE WHEN exp(mu) - 1 < 2 THEN 'very_low' WHEN exp(mu) - 1 > 100 THEN 'atypical'
            ELSE 'normal' END AS alert
FROM v CROSS JOIN m
"""

_NET = {
    "p4_8": 0.4, "p2_0": -0.3, "p0_42": 0.25, "p0_076": -0.2, "ll": 0.15, "ip": -0.1,
    "ratio_2_4": 0.35, "ratio_042_2": -0.45, "ratio_076_042": 0.2, "atividade": 0.3, "finos_sq": 0.5,
}
_NET_FEATURES = """p2_0 / (p4_8 + 1e-6) AS ratio_2_4, p0_42 / (p2_0 + 1e-6) AS ratio_042_2,
    p0_076 / (p0_42 + 1e-6) AS ratio_076_042, ll - (ll - ip) AS atividade, p0_076 * p0_076 AS finos_sq"""
_NET_SCALED = " + ".join(
    f"({w} * (v.{c} - m.lo_{c}) / (CASE WHEN m.hi_{c} = m.lo_{c} THEN 1 ELSE m.hi_{c} - m.lo_{c} END))" for c, w in _NET.items()
)
ORACLE["score_pipeline_network"] = f"""
WITH {_SOIL},
c AS (SELECT * FROM soil WHERE p4_8 BETWEEN 1 AND 3000 AND p2_0 BETWEEN 1 AND 3000
        AND p0_42 BETWEEN 1 AND 3000 AND p0_076 BETWEEN 1 AND 3000 AND ll BETWEEN 1 AND 3000
        AND ip BETWEEN 1 AND 3000 AND cbr BETWEEN 1 AND 3000),
r AS (SELECT c.*, {_NET_FEATURES}, row_number() OVER (ORDER BY md5({_KEYCAT}), {_KEYS}) - 1 AS rk,
             count(*) OVER () AS n FROM c),
t AS (SELECT * FROM r WHERE rk >= ceil(CAST(0.2 AS DOUBLE) * n)
                               + ceil(CAST(0.15 AS DOUBLE) * (n - ceil(CAST(0.2 AS DOUBLE) * n)))),
m AS (SELECT {", ".join(f"min({c} + 0.0) AS lo_{c}, max({c} + 0.0) AS hi_{c}" for c in _NET)} FROM t),
v AS (SELECT *, {_NET_FEATURES} FROM soil WHERE p4_8 BETWEEN 0 AND 100 AND p2_0 BETWEEN 0 AND 100
        AND p0_42 BETWEEN 0 AND 100 AND p0_076 BETWEEN 0 AND 100 AND ll BETWEEN 0 AND 100
        AND ip BETWEEN 0 AND 80),
z AS (SELECT {_KEYS}, exp(1.75 + {_NET_SCALED}) - 1 AS y FROM v CROSS JOIN m)
SELECT {_KEYS}, round(y, 6) AS cbr_pred, round(round(y, 2), 6) AS cbr_pred_2dp,
       CASE WHEN y < 2 THEN 'very_low' WHEN y > 100 THEN 'atypical' ELSE 'normal' END AS alert
FROM z
"""


def _mean_cv(name: str, groups: list[str]) -> str:
    on = " AND ".join([f"g.{c} = f.{c}" for c in groups] + ["TRUE"])
    by = ", ".join([*groups, "fold"])
    if groups:
        fit = f"""LEFT JOIN (SELECT {", ".join("a." + c for c in groups)}, b.fold,
            (a.s - coalesce(b.s, 0)) / nullif(a.c - coalesce(b.c, 0), 0) AS m
          FROM (SELECT {", ".join(groups)}, sum(label) AS s, count(*) AS c FROM f GROUP BY {", ".join(groups)}) a
          JOIN (SELECT {by}, sum(label) AS s, count(*) AS c FROM f GROUP BY {by}) b USING ({", ".join(groups)})) g
          ON {on} AND g.fold = f.fold"""
        pred = "coalesce(g.m, t.m)"
    else:
        fit, pred = "", "t.m"
    return f"""SELECT '{name}' AS groups, avg(mse) AS cv_mse FROM (
        SELECT f.fold, avg((f.label - {pred}) * (f.label - {pred})) AS mse
        FROM f JOIN t ON t.fold = f.fold {fit} GROUP BY f.fold)"""


ORACLE["search_results_mean"] = f"""
WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice / 1000 AS label,
             row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS rk,
             count(*) OVER () AS n FROM orders),
c AS (SELECT *, n // 10 AS q, n % 10 AS rem FROM r),
f AS (SELECT *, CASE WHEN rk < rem * (q + 1) THEN rk // (q + 1) ELSE rem + (rk - rem * (q + 1)) // q END AS fold FROM c),
t AS (SELECT fold, (sum(sum(label)) OVER () - sum(label)) / (sum(count(*)) OVER () - count(*)) AS m FROM f GROUP BY fold),
e AS ({" UNION ALL ".join(_mean_cv("+".join(g), g) for g in ([], ["o_orderpriority"], ["o_orderstatus"], ["o_orderpriority", "o_orderstatus"]))})
SELECT groups, round(cv_mse, 4) AS cv_mse, cv_mse = min(cv_mse) OVER () AS is_best FROM e
"""

ORACLE["importance_rank_table"] = """
WITH i AS (SELECT p_type AS feature, round(avg(p_size) / 50, 6) AS rf, round(avg(p_retailprice) / 1000, 6) AS et FROM part GROUP BY 1),
k AS (SELECT *, (rf + et) / 2.0 AS importance FROM i)
SELECT feature, round(rf, 6) AS rf, round(et, 6) AS et, round(importance, 6) AS importance, rank
FROM (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM k) WHERE rank <= 15
"""

ORACLE["clean_folder"] = ORACLE["clean_job"]

ORACLE["forest_stump"] = """
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_partkey % 10 AS DOUBLE) AS digit, CAST(ascii(p_name) AS DOUBLE) AS letter,
                  p_retailprice AS y, CAST(1 + p_partkey % 3 AS DOUBLE) AS w FROM part),
l AS (SELECT 0 AS f, size AS x, y, w FROM p UNION ALL SELECT 1, digit, y, w FROM p UNION ALL SELECT 2, letter, y, w FROM p),
v AS (SELECT f, x, count(*) AS n, sum(w) AS w, sum(w * y) AS wy FROM l GROUP BY f, x),
c AS (SELECT f, x, sum(n) OVER s AS n, sum(w) OVER s AS w, sum(wy) OVER s AS wy,
             sum(n) OVER (PARTITION BY f) AS tn, sum(w) OVER (PARTITION BY f) AS tw, sum(wy) OVER (PARTITION BY f) AS twy
      FROM v WINDOW s AS (PARTITION BY f ORDER BY x)),
best AS (SELECT f, x, wy / w AS lo, (twy - wy) / (tw - w) AS hi FROM c WHERE n >= 5 AND tn - n >= 5
         ORDER BY wy * wy / w + (twy - wy) * (twy - wy) / (tw - w) DESC, f, x LIMIT 1)
SELECT p_partkey, round(CASE WHEN (CASE f WHEN 0 THEN size WHEN 1 THEN digit ELSE letter END) <= x THEN lo ELSE hi END, 6) AS prediction FROM p, best
"""

ORACLE["individual_refits"] = f"""
WITH {_SOIL},
c AS (SELECT * FROM soil WHERE {" AND ".join(f"{c} BETWEEN 1 AND 3000" for c in _ALL_COLUMNS)}),
r AS (SELECT c.*, row_number() OVER (ORDER BY md5({_KEYCAT}), {_KEYS}) - 1 AS rk, count(*) OVER () AS n FROM c),
s AS (SELECT *, ln(1 + cbr) AS lab, CASE WHEN cbr > 25 THEN 3.0 ELSE 1.0 END AS w,
             CASE WHEN rk < ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test'
                  WHEN rk < ceil(CAST(0.2 AS DOUBLE) * n)
                            + ceil(CAST(0.15 AS DOUBLE) * (n - ceil(CAST(0.2 AS DOUBLE) * n))) THEN 'val_in_sample'
                  ELSE 'train' END AS split FROM r),
a AS (SELECT sum(w * lab) / sum(w) AS mw, avg(lab) AS mu FROM s WHERE split <> 'test'),
g AS (SELECT l_linenumber, sum(w * lab) / sum(w) AS gw, avg(lab) AS gu FROM s WHERE split <> 'test' GROUP BY 1),
x AS (SELECT split, cbr AS y, mw, mu, coalesce(gw, mw) AS gw, coalesce(gu, mu) AS gu
      FROM s CROSS JOIN a LEFT JOIN g USING (l_linenumber) WHERE split <> 'train'),
p AS (SELECT 'ensemble' AS model, split, y, exp((mw + gw) / 2) - 1 AS pred FROM x
      UNION ALL SELECT 'mean', split, y, exp(mu) - 1 FROM x WHERE split = 'test'
      UNION ALL SELECT 'line', split, y, exp(gu) - 1 FROM x WHERE split = 'test')
SELECT model, split, count(*) AS n, round(avg((y - pred) * (y - pred)), 6) AS mse,
       round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae,
       round(1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)), 6) AS r2,
       avg((y - pred) * (y - pred)) <= 1.0 AS suspicious, avg((y - pred) * (y - pred)) < 0.78 AS goal_met
FROM p GROUP BY model, split
"""
