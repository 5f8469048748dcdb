"""Identity, label and schema contracts. Violations are rows, never silent drops."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from diurna.functions.numbers import MISSING_TOKENS, blank_to_null, to_number
from diurna.operators.ranking import one_row


def normalise_ids(df: DataFrame, col: str) -> DataFrame:
    """Trimmed id plus the reason it must be rejected (NULL when accepted)."""
    t = F.trim(F.col(col))
    reason = F.when(F.col(col).isNull(), "null").when(t == "", "empty").when(
        F.lower(t).isin(*[x for x in MISSING_TOKENS if x]), "token")
    return df.withColumns({"clean_id": F.when(reason.isNull(), t), "reject_reason": reason})


def pseudonym(id_col: Column, salt: str, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), id_col), 256), 1, length)


def keyed_pseudonym(id_col: Column, key: bytes, length: int = 64) -> Column:
    """HMAC-SHA256 with the two padded keys prepared once on the driver."""
    k = hashlib.sha256(key).digest() if len(key) > 64 else key
    k = k.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in k).hex()
    outer = bytes(b ^ 0x5C for b in k).hex()
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(id_col, "UTF-8")), 256)
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256), 1, length)


def collisions(df: DataFrame, raw: str, digest: str) -> DataFrame:
    """Digests that stand for more than one id."""
    return df.groupBy(digest).agg(F.count_distinct(raw).alias("n_ids")).where("n_ids > 1")


def checked_labels(df: DataFrame, subject: str, label: str, codes: dict[str, int]) -> DataFrame:
    """One row per subject with its code and a status: ok, conflict or unknown."""
    mapping = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return (
        df.select(F.trim(F.col(subject)).alias(subject), F.try_element_at(mapping, F.col(label)).alias("code"))
        .groupBy(subject)
        .agg(F.count("*").alias("n_rows"), F.count_distinct("code").alias("n_labels"),
             F.max(F.col("code").isNull().cast("int")).alias("unknown"), F.min("code").alias("code"))
        .withColumn("status", F.when(F.col("unknown") == 1, "unknown").when(F.col("n_labels") > 1, "conflict").otherwise("ok"))
        .withColumn("code", F.when(F.col("status") == "ok", F.col("code")))
    )


def label_disagreements(a: DataFrame, b: DataFrame, subject: str, label: str) -> DataFrame:
    """Subjects whose label differs between two copies, or that exist in one copy only."""
    j = a.select(subject, F.col(label).alias("label_a")).join(
        b.select(subject, F.col(label).alias("label_b")), subject, "full_outer")
    return j.where(~F.col("label_a").eqNullSafe(F.col("label_b")))


def cohort_contract(df: DataFrame, label: str, expected: dict[str, int]) -> DataFrame:
    want = reduce(DataFrame.unionByName, [
        df.sparkSession.range(1).select(F.lit(k).alias(label), F.lit(v).cast("long").alias("expected"))
        for k, v in expected.items()])
    have = df.groupBy(label).agg(F.count("*").alias("observed"))
    return have.join(want, label, "full_outer").select(
        label, F.coalesce("observed", F.lit(0)).alias("observed"), "expected",
        (F.coalesce("observed", F.lit(0)) == F.coalesce("expected", F.lit(-1))).alias("passed"))


def refusal_codes(days: DataFrame, subject: str, checks: dict[str, Column], min_days: int) -> DataFrame:
    """First failing check per subject in the order given, then too few valid days."""
    agg = [F.max((~F.coalesce(c, F.lit(False))).cast("int")).alias(f"bad_{k}") for k, c in checks.items()]
    g = days.groupBy(subject).agg(F.count("*").alias("n_days"), *agg)
    code = F.coalesce(*[F.when(F.col(f"bad_{k}") == 1, k) for k in checks],
                      F.when(F.col("n_days") < min_days, "TOO_FEW_DAYS"), F.lit("ACCEPTED"))
    return g.select(subject, "n_days", code.alias("code"))


def manifest_report(data: DataFrame, manifest: DataFrame, subject: str, manifest_id: str) -> DataFrame:
    """One row per manifest id: data rows and copies in the manifest; data outside is ignored."""
    m = manifest.groupBy(F.col(manifest_id).alias(subject)).agg(F.count("*").alias("n_manifest"))
    d = data.join(m, subject, "left_semi").groupBy(subject).agg(F.count("*").alias("n_rows"))
    return m.join(d, subject, "left").select(
        subject, "n_manifest", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(F.col("n_manifest") > 1, "duplicate").when(F.col("n_rows").isNull(), "no_data").otherwise("ok").alias("status"))


def frame_fingerprint(df: DataFrame, columns) -> DataFrame:
    """Order-free digest: row count and two sums, modulo 2^60, of 60-bit halves of the row md5.

    Fields carry their name and length, so neither a separator nor a moved value can hide a change,
    and equal rows add up instead of cancelling.
    """
    fields = []
    for c in columns:
        v = F.col(c).cast("string")
        fields += [F.lit(f"{c}:"), F.coalesce(F.length(v).cast("string"), F.lit("-1")), F.lit(":"), F.coalesce(v, F.lit(""))]
    row = F.md5(F.concat(*fields))

    def half(start):
        return F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(38,0)")

    def total(c):
        return (F.coalesce(F.sum(c), F.lit(0)) % F.lit(1 << 60)).cast("bigint")

    return df.select(half(1).alias("a"), half(16).alias("b")).agg(F.count("*").alias("n_rows"), total("a").alias("digest_a"), total("b").alias("digest_b"))


def profile(df: DataFrame, columns, subject: str | None = None) -> DataFrame:
    """One row per column: nulls, distinct values, moments and the number of other columns equal to it on every row (``twins``).

    Every row also has the table's number of rows, of rows beyond the first of equal ones (over
    ``columns``) and, with a subject, the least, median and greatest number of its rows. Distinct
    values are counted in a long table that combines before the shuffle, not by a copy of the rows per column.
    """
    stats = {
        "n_null": lambda c: F.sum(c.isNull().cast("bigint")),
        "min_v": lambda c: F.min(c).cast("double"), "max_v": lambda c: F.max(c).cast("double"),
        "mean_v": F.avg, "sd_v": F.stddev_samp,
    }
    wide = df.agg(*[F.struct(*[f(F.col(c)).alias(k) for k, f in stats.items()]).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(c)[k].alias(k) for k in stats]) for c in columns])
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("_v")) for c in columns])))
    seen = long.groupBy("column", "_v").agg(F.lit(1).alias("_o")).groupBy("column").agg(F.count("_v").alias("n_distinct"))
    same = column_pair_mismatches(df, columns).where("mismatches = 0").select(F.explode(F.array("col_a", "col_b")).alias("column")).groupBy("column").agg(F.count("*").alias("twins"))
    copies = df.groupBy(*columns).agg(F.count("*").alias("_c")).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("extra_rows"))
    out = wide.select(F.inline(rows)).join(seen, "column").join(same, "column", "left").na.fill(0, ["twins"]).transform(one_row, copies)
    if subject is not None:
        per = df.groupBy(subject).agg(F.count("*").alias("_t")).groupBy("_t").agg(F.count("*").alias("_c"))
        out = out.transform(one_row, per.agg(F.min("_t").alias("subject_min"), F.percentile("_t", 0.5, F.col("_c")).alias("subject_median"), F.max("_t").alias("subject_max")))
    return out


def duplicate_rows(df: DataFrame, columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("copies")).where("copies > 1").agg(
        F.count("*").alias("groups"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_rows"))


def column_pair_mismatches(df: DataFrame, columns, pairs=None) -> DataFrame:
    """Rows on which each pair of columns differs, from one aggregation."""
    pairs = list(combinations(sorted(columns), 2)) if pairs is None else pairs
    wide = df.agg(*[F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("bigint")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"p{k}").alias("mismatches"))
        for k, (a, b) in enumerate(pairs)])))


def identical_column_pairs(df: DataFrame, columns) -> DataFrame:
    """Pairs of columns equal on every row.

    An order-free fingerprint per column (value hashed with its row) shortlists the pairs, so
    the exact comparison covers candidates only and not the square of the column count. Equal
    columns always share the fingerprint; unequal ones that collide fail the exact comparison.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    row = F.xxhash64(*[F.col(c) for c in sorted(columns)])
    mark = {c: F.col(c).cast("double") if c in numeric else F.col(c).cast("string") for c in columns}
    prints = df.agg(*[F.bit_xor(F.xxhash64(row, mark[c])).alias(c) for c in columns]).first().asDict()  # one row, schema wide
    groups: dict = {}
    for c in columns:
        groups.setdefault(prints[c], []).append(c)
    pairs = [p for g in groups.values() for p in combinations(sorted(g), 2)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string")
    return column_pair_mismatches(df, columns, pairs).where("mismatches = 0").drop("mismatches")


def formula_check(df: DataFrame, formulas: dict[str, tuple[Column, Column]], digits: int = 2) -> DataFrame:
    """Share of rows where stored and recomputed agree after rounding; largest absolute error."""
    wide = df.agg(*[F.struct(
        F.avg((F.abs(s - f) < 0.5 * 10 ** -digits).cast("double")).alias("agreement"),
        F.max(F.abs(s - f)).alias("max_error")).alias(k) for k, (s, f) in formulas.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("formula"), F.col(k)["agreement"].alias("agreement"), F.col(k)["max_error"].alias("max_error"))
        for k in formulas])))


def schema_overlap(train: DataFrame, valid: DataFrame, subject: str, target_words) -> DataFrame:
    """Column and subject overlap of two sources; only names and the id column are read."""
    a, b = set(train.columns), set(valid.columns)
    like = sorted(c for c in a | b if any(w in c.lower() for w in target_words))
    ids = train.select(subject).intersect(valid.select(subject)).agg(F.count("*").alias("shared_subjects"))
    return ids.select(
        F.lit(",".join(sorted(a - b))).alias("only_train"), F.lit(",".join(sorted(b - a))).alias("only_valid"),
        F.lit(int(train.columns == valid.columns)).alias("exact_match"), F.lit(",".join(like)).alias("target_like"),
        "shared_subjects")


def prefer_converted(converted: str, plain: str) -> Column:
    return F.coalesce(blank_to_null(F.col(converted)), blank_to_null(F.col(plain)))


def with_origin(parts: dict[str, DataFrame]) -> DataFrame:
    tagged = [d.withColumn("split_origin", F.lit(k)) for k, d in parts.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in columns})
