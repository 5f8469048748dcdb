"""The carrier views of ``sources.carriers`` restated as SQL for the checks."""

from diurna.sources.carriers import DIM

U = "(('0x' || substr(md5(concat_ws('-', {})), 1, 8))::BIGINT)"


def h(*parts: str) -> str:
    """Seeded 32-bit integer; parts are SQL expressions."""
    return U.format(", ".join(f"CAST({p} AS VARCHAR)" for p in parts))


def pctl(q: float, c: str = "value") -> str:
    return f"quantile_cont({c}, {q})"


CTES: dict[str, str] = {
    "c_min": """SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(ts AS DATE) AS date,
      CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute,
      CASE WHEN (hour(ts) * 60 + minute(ts)) % 11 <> 0 THEN max(value) END AS value,
      min(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3
          WHEN 'purchase' THEN 4 ELSE 5 END) AS code
      FROM events GROUP BY CAST(user_id AS VARCHAR), CAST(ts AS DATE), hour(ts) * 60 + minute(ts)""",
    "c_rec": """SELECT *, row_number() OVER (PARTITION BY subject_id, wk ORDER BY date, minute) - 1 AS pos,
      count(*) OVER (PARTITION BY subject_id, wk) AS n
      FROM (SELECT *, CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS wk FROM c_min)""",
    "c_fin": """SELECT subject_id, wk, value, code, minute, row_number() OVER (PARTITION BY subject_id, wk ORDER BY pos) - 1 AS pos,
      count(*) OVER (PARTITION BY subject_id, wk) AS n FROM c_rec WHERE value IS NOT NULL""",
    "c_fill": """SELECT subject_id, wk, pos, n, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
        ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END AS value FROM (SELECT *,
        last_value(value IGNORE NULLS) OVER w1 AS pv, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER w1 AS pp,
        first_value(value IGNORE NULLS) OVER w2 AS nv, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER w2 AS np
        FROM c_rec WINDOW w1 AS (PARTITION BY subject_id, wk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          w2 AS (PARTITION BY subject_id, wk ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "c_prof": """SELECT s.subject_id, s.h AS hour, c.value FROM (SELECT subject_id, unnest(range(24)) AS h FROM c_subj) s
      LEFT JOIN c_hour c ON c.subject_id = s.subject_id AND c.hour = s.h""",
    "c_pfill": """SELECT subject_id, h AS hour, value, known FROM (SELECT subject_id, t - 24 AS h, known,
        CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END AS value
        FROM (SELECT *, last_value(value IGNORE NULLS) OVER w1 AS pv, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w1 AS pt,
          first_value(value IGNORE NULLS) OVER w2 AS nv, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w2 AS nt,
          count(value) OVER (PARTITION BY subject_id) // 3 AS known
          FROM (SELECT subject_id, hour + 24 * k AS t, value FROM c_prof, (SELECT unnest([0, 1, 2]) AS k))
          WINDOW w1 AS (PARTITION BY subject_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            w2 AS (PARTITION BY subject_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) WHERE h BETWEEN 0 AND 23""",
    "c_raw": """SELECT subject_id, date,
      string_agg(CASE WHEN minute % 11 = 0 THEN '...' WHEN minute % 13 = 0 THEN 'x1'
        ELSE CAST(value AS VARCHAR) END, '/' ORDER BY minute) || '/' AS txt,
      string_agg(CAST(code AS VARCHAR), '/' ORDER BY minute) AS codes_txt
      FROM c_min GROUP BY subject_id, date""",
    "c_day": """SELECT *, CAST(date_diff('day', min(date) OVER (PARTITION BY subject_id), date) AS INTEGER) AS day_index,
      CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend
      FROM (SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(ts AS DATE) AS date, count(*) AS n,
        avg(value) AS v_mean, max(value) AS v_max, min(ts) AS first_ts, max(ts) AS last_ts,
        max(value) FILTER (WHERE event_type = 'click') AS click_v, max(value) FILTER (WHERE event_type = 'view') AS view_v,
        max(value) FILTER (WHERE event_type = 'error') AS error_v, max(value) FILTER (WHERE event_type = 'signup') AS signup_v,
        max(value) FILTER (WHERE event_type = 'purchase') AS purchase_v
        FROM events GROUP BY CAST(user_id AS VARCHAR), CAST(ts AS DATE))""",
    "c_act": """SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(ts AS DATE) AS date, count(*) AS act_n,
      avg(value) AS act_mean, max(value) AS act_max, min(ts) AS act_start, max(ts) AS act_end
      FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2""",
    "c_slp": """SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(ts AS DATE) AS date, count(*) AS slp_n,
      avg(value) AS slp_mean, max(value) AS slp_max, min(ts) AS slp_start, max(ts) AS slp_end
      FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2""",
    "c_ep": """SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(ts AS DATE) AS date, event_id AS ep_id, ts AS start_ts,
      ts + to_seconds(CAST(CAST(round(value * 100) AS BIGINT) AS INTEGER)) AS end_ts, CAST(round(value * 100) AS BIGINT) AS dur_s, value
      FROM events WHERE event_type IN ('signup', 'purchase')""",
    "c_long": """SELECT subject_id, date, day_index, is_weekend, channel, value FROM (
      SELECT subject_id, date, day_index, is_weekend, unnest(['v_max', 'click_v', 'purchase_v']) AS channel,
        unnest([v_max, click_v, purchase_v]) AS value FROM c_day)""",
    "c_lp": """SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY subject_id, channel) AS n,
      count(value) OVER (PARTITION BY subject_id, channel) AS nv, CASE WHEN value IS NOT NULL THEN count(value) OVER w - 1 END AS fpos,
      max(day_index) OVER (PARTITION BY subject_id, channel) AS last_day
      FROM c_long WINDOW w AS (PARTITION BY subject_id, channel ORDER BY day_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "c_lf": "SELECT * FROM c_lp WHERE value IS NOT NULL",
    "c_mom": """SELECT f.subject_id, f.channel, max(f.nv)::DOUBLE AS nv, max(f.n) AS n, max(m) AS m, avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3,
      avg(pow(value - m, 4)) AS m4, avg(abs(value - m)) AS mad, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS q25,
      median(value) AS med, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS p90
      FROM c_lf f JOIN (SELECT subject_id, channel, avg(value) AS m FROM c_lf GROUP BY 1, 2) b ON b.subject_id = f.subject_id AND b.channel = f.channel GROUP BY 1, 2""",
    "c_lk": "SELECT DISTINCT subject_id, channel FROM c_long",
    "c_subj": """SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject_id, CAST(user_id % 3 AS INTEGER) AS y3,
      CAST(user_id % 3 > 0 AS INTEGER) AS y, CASE user_id % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'MCI' ELSE 'Dem' END AS diag
      FROM events""",
    "c_hour": """SELECT CAST(user_id AS VARCHAR) AS subject_id, hour(ts) AS hour, avg(value) AS value
      FROM events GROUP BY 1, 2""",
    "c_cust": f"""SELECT CAST(c_custkey AS VARCHAR) AS subject_id, CAST({h("'y'", "c_custkey")} % 3 AS INTEGER) AS y3,
      CAST({h("'y'", "c_custkey")} % 3 > 0 AS INTEGER) AS y, CAST({h("'f'", "c_custkey")} % 5 AS INTEGER) AS fold
      FROM customer""",
    "c_oof": f"""SELECT subject_id, y3, y, fold, seed, model,
      (CASE model WHEN 'a' THEN {h("'a'", "seed", "subject_id")} % 700 + 100 * y3
        ELSE {h("'b'", "seed", "subject_id")} % 800 + 60 * y3 END) / 1000.0::DOUBLE AS score
      FROM c_cust, (SELECT unnest([0, 1, 2]) AS seed), (SELECT unnest(['a', 'b']) AS model)""",
    "c_prob": f"""SELECT subject_id, y3, fold, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2
      FROM (SELECT *, CAST({h("'p0'", "subject_id")} % 100 + 1 + CASE WHEN y3 = 0 THEN 80 ELSE 0 END AS DOUBLE) AS a,
        CAST({h("'p1'", "subject_id")} % 100 + 1 + CASE WHEN y3 = 1 THEN 80 ELSE 0 END AS DOUBLE) AS b,
        CAST({h("'p2'", "subject_id")} % 100 + 1 + CASE WHEN y3 = 2 THEN 80 ELSE 0 END AS DOUBLE) AS c FROM c_cust)""",
    "c_ord": f"""SELECT CAST(o_custkey AS VARCHAR) AS subject_id, o_orderkey AS window_id, CAST(o_orderdate AS DATE) AS date,
      CAST({h("'y'", "o_custkey")} % 3 > 0 AS INTEGER) AS y, o_totalprice / 1000000.0 AS score FROM orders""",
    "c_vec": "SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(label >= 5 AS INTEGER) AS y, CAST(label % 3 AS INTEGER) AS y3, "
    "CAST(vec_id % 5 AS INTEGER) AS fold, " + ", ".join(f"CAST(embedding[{k}] AS DOUBLE) AS x{k}" for k in range(1, DIM + 1)) + " FROM embeddings",
    "c_vn": "SELECT vec_id, label, y, y3, fold, " + ", ".join(f"CASE WHEN vec_id % {DIM + 1} <> {k} THEN x{k} END AS x{k}" for k in range(1, DIM + 1)) + " FROM c_vec",
    "c_vl": "SELECT vec_id, label, y, y3, fold, feature, value FROM (SELECT vec_id, label, y, y3, fold, unnest(["
    + ", ".join(f"'x{k}'" for k in range(1, DIM + 1)) + "]) AS feature, unnest([" + ", ".join(f"x{k}" for k in range(1, DIM + 1)) + "]) AS value FROM c_vec)",
    "c_contrib": """SELECT vec_id, y, fold, feature, value,
      value * CAST(substr(feature, 2) AS INTEGER) * (CASE WHEN CAST(substr(feature, 2) AS INTEGER) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS contribution
      FROM c_vl""",
}
