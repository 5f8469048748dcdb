"""Sources, sinks and schema contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import contracts as C
from diurna.operators.ranking import one_row
from diurna.plans.registry import query
from diurna.sources import files

CUST_SQL = "SELECT c_custkey, c_mktsegment || chr(10) || c_custkey AS c_mktsegment, c_acctbal FROM customer"


def customer_csv(t, name="customer"):
    """Two exports with the columns in another order and a quoted newline in every label."""
    path = files.scratch(t.spark, name)
    df = t.table("customer").withColumn("c_mktsegment", F.concat("c_mktsegment", F.lit("\n"), F.col("c_custkey").cast("string")))
    for k, columns in enumerate((df.columns, df.columns[::-1])):
        files.write_table(df.where(F.col("c_custkey") % 2 == k).select(*columns), f"{path}/{k}", "csv")
    return [f"{path}/0", f"{path}/1"]


@query("scan_csv_allowlist", s="c_mktsegment", i="c_custkey", f="c_acctbal", sql=CUST_SQL)
def _(t):
    return files.read_csv_allowlist(t.spark, customer_csv(t), ["c_custkey", "c_acctbal"], ["c_mktsegment", "not_there"])


@query("scan_encoding_fallback", s="encoding label", i="c_custkey", sql="""
    SELECT c_custkey, '서울 ' || c_mktsegment AS label, CASE WHEN c_custkey % 2 = 0 THEN 'utf-8' ELSE 'MS949' END AS encoding FROM customer""")
def _(t):
    path = files.scratch(t.spark, "encodings")
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = t.table("customer").select("c_custkey", F.concat(F.lit("서울 "), F.col("c_mktsegment")).alias("label"))
    for k, enc in enumerate(("utf-8", "EUC-KR")):
        columns = ["c_custkey", "label"] if k else ["label", "c_custkey"]
        df.where(F.col("c_custkey") % 2 == k).select(*columns).write.option("header", True).option("encoding", enc).csv(f"{path}/{k}")
    return files.read_csv_fallback(t.spark, [f"{path}/0", f"{path}/1"], ["c_custkey", "label"])


@query("scan_discover_by_stem", s="source_name", i="n keys", sql="""
    SELECT 'train_activity.csv' AS source_name, count(*) AS n, sum(c_custkey) AS keys FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT 'val_activity.csv.part1', count(*), sum(c_custkey) FROM customer WHERE c_custkey % 2 = 1""")
def _(t):
    base = files.scratch(t.spark, "stems")
    df = t.table("customer")
    for k, name in enumerate(("train_activity.csv", "val_activity.csv.part1", "train_sleep.csv")):
        columns = df.columns[::-1] if k else df.columns
        files.write_table(df.where(F.col("c_custkey") % 2 == k % 2).select(*columns), f"{base}/{name}", "csv")
    found = files.read_by_stem(t.spark, base, "activity")
    return found.groupBy("source_name").agg(F.count("*").alias("n"), F.sum(F.col("c_custkey").cast("bigint")).alias("keys"))


@query("coalesce_convert_column", s="subject_id date series", sql="""
    SELECT subject_id, date, coalesce(CASE WHEN lower(trim(conv)) NOT IN ('', '...', 'nan', 'none', 'null') THEN conv END,
      CASE WHEN lower(trim(plain)) NOT IN ('', '...', 'nan', 'none', 'null') THEN plain END) AS series
    FROM (SELECT subject_id, date, CASE WHEN day(date) % 3 = 0 THEN '...' WHEN day(date) % 5 = 0 THEN 'NaN' ELSE txt END AS conv,
      CASE WHEN day(date) % 6 = 0 THEN ' ' ELSE codes_txt END AS plain FROM c_raw)""")
def _(t):
    day = F.dayofmonth("date")
    df = t.raw_days.select(
        "subject_id", "date",
        F.when(day % 3 == 0, "...").when(day % 5 == 0, "NaN").otherwise(F.col("txt")).alias("CONVERT(x USING utf8)"),
        F.when(day % 6 == 0, " ").otherwise(F.col("codes_txt")).alias("x"))
    return df.select("subject_id", "date", C.prefer_converted("`CONVERT(x USING utf8)`", "x").alias("series"))


@query("union_splits_with_origin", s="subject_id date split_origin", i="act_n slp_n", sql="""
    SELECT subject_id, date, 'train' AS split_origin, act_n, NULL AS slp_n FROM c_act
    UNION ALL SELECT subject_id, date, 'validation', NULL, slp_n FROM c_slp""")
def _(t):
    return C.with_origin({"train": t.activity.select("subject_id", "date", "act_n"),
                          "validation": t.sleep.select("subject_id", "date", "slp_n")})


@query("coerce_numeric", i="event_id", f="x", sql="""
    SELECT event_id, CASE WHEN isfinite(v) THEN v END AS x FROM (SELECT event_id, TRY_CAST(trim(
      CASE WHEN event_id % 5 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN 'inf' WHEN event_id % 11 = 0 THEN 'nan'
           ELSE ' ' || CAST(value AS VARCHAR) END) AS DOUBLE) AS v FROM events)""")
def _(t):
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, "bad").when(k % 7 == 0, "inf").when(k % 11 == 0, "nan").otherwise(
        F.concat(F.lit(" "), F.col("value").cast("string")))
    return C.coerce_numeric(t.events.select("event_id", raw.alias("x")), ["x"])


@query("normalise_subject_id", s="clean_id reject_reason", i="n", sql="""
    SELECT CASE WHEN reject_reason IS NULL THEN trim(raw) END AS clean_id, reject_reason, count(*) AS n FROM (
      SELECT raw, CASE WHEN raw IS NULL THEN 'null' WHEN trim(raw) = '' THEN 'empty'
        WHEN lower(trim(raw)) IN ('...', 'nan', 'none', 'null') THEN 'token' END AS reject_reason
      FROM (SELECT CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' NaN ' ELSE ' ' || user_id || ' ' END AS raw FROM events))
    GROUP BY ALL""")
def _(t):
    k = F.col("event_id") % 10
    raw = F.when(k == 1, "  ").when(k == 2, " NaN ").when(k > 2, F.concat(F.lit(" "), "subject_id", F.lit(" ")))
    return C.normalise_ids(t.events.select(raw.alias("raw")), "raw").groupBy("clean_id", "reject_reason").agg(F.count("*").alias("n"))


@query("pseudonymise_subject", s="subject_id digest", sql="SELECT subject_id, substr(sha256('pepper|' || subject_id), 1, 16) AS digest FROM c_subj")
def _(t):
    return t.subjects.select("subject_id", C.pseudonym(F.col("subject_id"), "pepper").alias("digest"))


TEST_KEY = b"example key for checks only"


@query("pseudonymise_keyed", s="subject_id digest", i="n_collisions", sql=f"""
    SELECT subject_id, sha256(unhex('{bytes(b ^ 0x5C for b in TEST_KEY.ljust(64, chr(0).encode())).hex()}') ||
      unhex(sha256(unhex('{bytes(b ^ 0x36 for b in TEST_KEY.ljust(64, chr(0).encode())).hex()}') || encode(subject_id)))) AS digest,
      0 AS n_collisions FROM c_subj""")
def _(t):
    df = t.subjects.select("subject_id", C.keyed_pseudonym(F.col("subject_id"), TEST_KEY).alias("digest"))
    n = C.collisions(df, "subject_id", "digest").agg(F.count("*").alias("n_collisions"))
    return df.transform(one_row, n)  # one row by construction


@query("load_labels_checked", s="subject_id status", i="n_rows n_labels code", sql="""
    SELECT subject_id, CASE WHEN unk = 1 THEN 'unknown' WHEN k > 1 THEN 'conflict' ELSE 'ok' END AS status, n_rows, k AS n_labels,
      CASE WHEN unk = 0 AND k <= 1 THEN c END AS code FROM (
      SELECT subject_id, count(*) AS n_rows, count(DISTINCT code) AS k, max(CASE WHEN code IS NULL THEN 1 ELSE 0 END) AS unk, min(code) AS c FROM (
        SELECT CAST(user_id AS VARCHAR) AS subject_id, CASE WHEN user_id % 10 = 3 AND event_id % 2 = 0 THEN 1 WHEN user_id % 17 = 5 THEN NULL ELSE user_id % 3 END AS code FROM events)
      GROUP BY 1)""")
def _(t):
    u, k = F.col("user_id"), F.col("event_id")
    raw = F.when((u % 10 == 3) & (k % 2 == 0), "MCI").when(u % 17 == 5, "??").when(u % 3 == 0, "CN").when(u % 3 == 1, "MCI").otherwise("Dem")
    return C.checked_labels(t.events.select("subject_id", raw.alias("label")), "subject_id", "label", {"CN": 0, "MCI": 1, "Dem": 2})


@query("label_copies_agree", s="subject_id label_a label_b", sql="""
    SELECT subject_id, a AS label_a, b AS label_b FROM (
      SELECT subject_id, diag AS a, CASE WHEN CAST(subject_id AS BIGINT) % 7 = 0 THEN 'CN' WHEN CAST(subject_id AS BIGINT) % 11 <> 0 THEN diag END AS b FROM c_subj)
    WHERE a IS DISTINCT FROM b""")
def _(t):
    k = F.col("subject_id").cast("bigint")
    other = t.subjects.where((k % 11 != 0) | (k % 7 == 0)).withColumn("diag", F.when(k % 7 == 0, "CN").otherwise(F.col("diag")))
    return C.label_disagreements(t.subjects, other, "subject_id", "diag")


@query("cohort_contract", s="diag", i="observed expected passed", sql="""
    SELECT coalesce(a.diag, e.diag) AS diag, coalesce(n, 0) AS observed, expected, coalesce(n, 0) = coalesce(expected, -1) AS passed
    FROM (SELECT diag, count(*) AS n FROM c_subj GROUP BY 1) a
    FULL JOIN (VALUES ('CN', 50), ('MCI', 49), ('Other', 1)) AS e(diag, expected) ON a.diag = e.diag""")
def _(t):
    return C.cohort_contract(t.subjects, "diag", {"CN": 50, "MCI": 49, "Other": 1})


@query("schema_contract_refusals", s="subject_id code", i="n_days", sql="""
    SELECT subject_id, n_days, CASE WHEN b1 = 1 THEN 'BAD_START' WHEN b2 = 1 THEN 'NOT_FINITE' WHEN b3 = 1 THEN 'OUT_OF_RANGE'
      WHEN n_days < 27 THEN 'TOO_FEW_DAYS' ELSE 'ACCEPTED' END AS code FROM (
      SELECT subject_id, count(*) AS n_days, max(CASE WHEN date_diff('minute', date, first_ts) >= 3 THEN 0 ELSE 1 END) AS b1,
        max(CASE WHEN v_mean > 0 THEN 0 ELSE 1 END) AS b2, max(CASE WHEN v_max BETWEEN 0 AND 300 THEN 0 ELSE 1 END) AS b3
      FROM (SELECT *, hour(first_ts) * 60 + minute(first_ts) AS m0 FROM c_day) GROUP BY 1)""")
def _(t):
    start = F.hour("first_ts") * 60 + F.minute("first_ts")
    return C.refusal_codes(t.daily, "subject_id", {
        "BAD_START": start >= 3, "NOT_FINITE": F.col("v_mean") > 0, "OUT_OF_RANGE": F.col("v_max").between(0, 300)}, 27)


@query("manifest_filter", s="subject_id status", i="n_manifest n_rows", sql="""
    SELECT m.subject_id, n_manifest, coalesce(d.n, 0) AS n_rows,
      CASE WHEN n_manifest > 1 THEN 'duplicate' WHEN d.n IS NULL THEN 'no_data' ELSE 'ok' END AS status
    FROM (SELECT subject_id, count(*) AS n_manifest FROM (SELECT CAST(c_custkey AS VARCHAR) AS subject_id FROM customer
          UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) GROUP BY 1) m
    LEFT JOIN (SELECT subject_id, count(*) AS n FROM c_day GROUP BY 1) d USING (subject_id)""")
def _(t):
    sid = t.table("customer").select(F.col("c_custkey").cast("string").alias("sid")).unionAll(
        t.table("supplier").select(F.col("s_suppkey").cast("string")))
    return C.manifest_report(t.daily.select("subject_id"), sid, "subject_id", "sid")


@query("file_fingerprint", s="file sha256", i="length")
def _(t):
    fp = files.fingerprint_files(t.spark, f"{t.dir}/*.parquet")
    return fp.withColumn("file", F.element_at(F.split("path", "/"), -1))


def print_sql(src: str, *columns: str) -> str:
    """n_rows, digest_a, digest_b: named, length-prefixed fields; two sums modulo 2^60."""
    row = " || ".join(f"'{c}:' || coalesce(length(CAST({c} AS VARCHAR))::VARCHAR, '-1') || ':' || coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    half = "(sum(('0x' || substr(m, {}, 15))::BIGINT::HUGEINT) % 1152921504606846976::HUGEINT)::BIGINT"
    return f"SELECT count(*) AS n_rows, {half.format(1)} AS digest_a, {half.format(16)} AS digest_b FROM (SELECT md5({row}) AS m FROM {src})"


@query("frame_fingerprint", i="n_rows digest_a digest_b", sql=print_sql("events", "user_id", "event_type", "event_id"))
def _(t):
    return C.frame_fingerprint(t.events, ["user_id", "event_type", "event_id"])


@query("cached_derived_table", s="subject_id", i="days", sql="SELECT subject_id, count(*) AS days FROM c_day GROUP BY 1")
def _(t):
    root = files.scratch(t.spark, "cache")
    build = lambda: t.daily.groupBy("subject_id").agg(F.count("*").alias("days"))
    source = t.events.select("subject_id", "date")
    files.cached_table(t.spark, root, files.cache_key({"events": source.where("date < date'1900-01-01'")}, version=1), lambda: build().limit(0))  # another key
    key = files.cache_key({"events": source}, version=1)
    files.cached_table(t.spark, root, key, build)
    return files.cached_table(t.spark, root, key, lambda: build().limit(0))


@query("write_parquet_atomic", s="fmt", i="n total", sql="""
    SELECT fmt, count(*) AS n, sum(s_suppkey) AS total FROM supplier, (VALUES ('parquet'), ('csv'), ('json')) AS f(fmt) GROUP BY 1""")
def _(t):
    base, out = files.scratch(t.spark, "sinks"), None
    for fmt in ("parquet", "csv", "json"):
        files.write_table(t.table("supplier"), f"{base}/{fmt}", fmt)
        back = t.spark.read.options(header=True).format(fmt).load(f"{base}/{fmt}").select(
            F.lit(fmt).alias("fmt"), F.col("s_suppkey").cast("bigint").alias("k"))
        out = back if out is None else out.unionAll(back)
    return out.groupBy("fmt").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


PROFILED = ("n", "v_max", "click_v", "purchase_v", "is_weekend", "n_copy")


@query("profile_columns", s="column", i="n_null n_distinct twins n_rows extra_rows subject_min subject_max", f="min_v max_v mean_v sd_v subject_median", sql=f"""
    WITH d AS (SELECT *, n AS n_copy FROM c_day), k AS (SELECT count(*) AS c FROM d GROUP BY {', '.join(PROFILED)}), s AS (SELECT count(*) AS c FROM d GROUP BY subject_id)
    SELECT * FROM ({' UNION ALL '.join(
        f"SELECT '{c}' AS column, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, min({c}) AS min_v, max({c}) AS max_v, avg({c}) AS mean_v, stddev_samp({c}) AS sd_v, "
        + ' + '.join(f'bool_and({c} IS NOT DISTINCT FROM {o})::INT' for o in PROFILED if o != c) + ' AS twins FROM d' for c in PROFILED)}),
      (SELECT sum(c) AS n_rows, sum(c - 1) AS extra_rows FROM k), (SELECT min(c) AS subject_min, median(c) AS subject_median, max(c) AS subject_max FROM s)""")
def _(t):
    return C.profile(t.daily.withColumn("n_copy", F.col("n")), list(PROFILED), "subject_id")


@query("identical_column_pairs", s="col_a col_b", sql="SELECT 'value' AS col_a, 'value_copy' AS col_b")
def _(t):
    df = t.events.select("value", F.col("value").alias("value_copy"), (F.col("value") + 1).alias("shifted"), "event_type")
    return C.identical_column_pairs(df, df.columns)


@query("derived_formula_check", s="formula", f="agreement max_error", sql="""
    SELECT 'mean_times_n' AS formula, avg(CASE WHEN abs(v_max - (v_mean * n)) < 0.005 THEN 1.0::DOUBLE ELSE 0.0 END) AS agreement, max(abs(v_max - v_mean * n)) AS max_error FROM c_day
    UNION ALL SELECT 'max_is_max', avg(CASE WHEN abs(v_max - m) < 0.005 THEN 1.0::DOUBLE ELSE 0.0 END), max(abs(v_max - m))
    FROM (SELECT v_max, greatest(click_v, view_v, error_v, signup_v, purchase_v) AS m FROM c_day)""")
def _(t):
    d = F.col("v_max")
    return C.formula_check(t.daily, {
        "mean_times_n": (d, F.col("v_mean") * F.col("n")),
        "max_is_max": (d, F.greatest("click_v", "view_v", "error_v", "signup_v", "purchase_v"))})


@query("schema_overlap", s="only_train only_valid target_like", i="exact_match shared_subjects", sql="""
    SELECT 'act_end,act_max,act_mean,act_n,act_start' AS only_train, 'slp_end,slp_max,slp_mean,slp_n,slp_start' AS only_valid, 0 AS exact_match,
      '' AS target_like, (SELECT count(*) FROM (SELECT subject_id FROM c_act INTERSECT SELECT subject_id FROM c_slp)) AS shared_subjects""")
def _(t):
    return C.schema_overlap(t.activity, t.sleep, "subject_id", ["diag", "label"])
