"""Under- and over-sampling, synthetic rows, weights, bootstrap and permutation draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions.hashing import hash_int, hash_unit, seeded_md5
from diurna.operators.neighbours import nearest
from diurna.operators.prep import standard_scale
from diurna.operators.ranking import cumulate, one_row, ordinal
from diurna.sources.files import materialise


def _one(df: DataFrame, *aggs: Column) -> DataFrame:
    return F.broadcast(df.agg(*aggs))  # one row


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """One row: minority label and sizes; on equal sizes the smaller label is the minority."""
    n1, n = F.sum(F.col(label)), F.count("*")
    return df.agg(n1.alias("_n1"), (n - n1).alias("_n0")).select(
        F.when(F.col("_n0") <= F.col("_n1"), 0).otherwise(1).alias("minority"),
        F.least("_n0", "_n1").alias("n_min"), F.greatest("_n0", "_n1").alias("n_maj"))


def undersample_random(train: DataFrame, row_id: str, label: str, ratio: float, seed: int) -> DataFrame:
    """All minority rows and round(ratio * n_min) majority rows in hash order."""
    d = ordinal(train.withColumn("_hx", seeded_md5(seed, F.col(row_id))), [label], "_hx", row_id)
    d = d.transform(one_row, class_sizes(train, label))
    return d.where((F.col(label) == F.col("minority")) | (F.col("idx") < F.bround(F.col("n_min") * F.lit(ratio)))).select(*train.columns)


def subject_quotas(train: DataFrame, subject: str, label: str, ratio: float, seed: int) -> DataFrame:
    """Majority rows to keep per majority subject: the same share of each, at least one, largest remainder.

    When the floor of one overshoots, the largest quotas are levelled down; when fewer rows than
    subjects are wanted, subjects are drawn in hash order.
    """
    size = class_sizes(train, label)
    maj = train.transform(one_row, size).where(F.col(label) != F.col("minority"))
    per = maj.groupBy(subject).agg(F.count("*").alias("c"), F.max(F.bround(F.col("n_min") * F.lit(ratio))).cast("bigint").alias("keep"), F.max("n_maj").alias("tot"))
    exact = F.col("c") * F.col("keep") / F.col("tot")
    per = per.withColumns({"_fr": exact - F.floor(exact), "alloc": F.greatest(F.lit(1), F.floor(exact)).cast("bigint")})
    sums = per.agg(F.sum("alloc").alias("_sa"), F.count("*").alias("_ns"))
    # one row per subject, read by four steps below
    per = materialise(per.transform(one_row, sums), "quotas")
    # remaining > 0: one more each, largest fraction first (ties in hash order). It never exceeds the subjects with room, so one round is exact.
    up = per.where(F.col("alloc") < F.col("c")).select(subject, (-F.col("_fr")).alias("_nf"), F.md5(subject).alias("_hx"))
    ahead = cumulate(up, [], "_nf", {"cnt": F.count("*")}).select("_nf", (F.col("cum_cnt") - F.col("cnt")).alias("_ahead"))
    up = ordinal(up, ["_nf"], "_hx", subject).join(ahead, "_nf").select(subject, (F.col("_ahead") + F.col("idx")).alias("_up"))
    # remaining < 0: highest level whose levelled sum still fits, from the distinct quota values.
    level = _level(per)
    hx = seeded_md5(seed, F.col(subject))
    drawn = ordinal(per.select(subject, hx.alias("_hx")), [], "_hx", subject).select(subject, F.col("idx").alias("_draw"))
    j = per.join(up, subject, "left").join(drawn, subject).transform(one_row, level)
    cut = j.where("_sa > keep and alloc > _level").withColumn("_key", F.md5(F.col(subject)))
    cut = ordinal(cut, [], "_key", subject).select(subject, F.col("idx").alias("_cut"))
    j = j.join(cut, subject, "left")
    quota = (
        F.when(F.col("keep") >= F.col("tot"), F.col("c"))
        .when(F.col("keep") <= F.col("_ns"), (F.col("_draw") < F.greatest(F.lit(1), F.col("keep"))).cast("bigint"))
        .when(F.col("_sa") <= F.col("keep"), F.col("alloc") + F.coalesce(F.col("_up") < F.col("keep") - F.col("_sa"), F.lit(False)).cast("bigint"))
        .otherwise(F.least(F.col("alloc"), F.col("_level")) + F.coalesce(F.col("_cut") < F.col("_extra"), F.lit(False)).cast("bigint")))
    return j.select(subject, "c", F.least(quota, F.col("c")).alias("quota"))


def _level(per: DataFrame) -> DataFrame:
    c = cumulate(per.withColumn("_a", F.col("alloc").cast("double")), [], "_a", {"s": F.sum("alloc"), "m": F.count("*"), "kp": F.max("keep")})
    rest = F.col("tot_m") - F.col("cum_m")
    keep = F.col("kp")
    lv = F.when(rest > 0, F.floor((keep - F.col("cum_s")) / rest)).otherwise(F.when(F.col("cum_s") <= keep, F.col("_a")).otherwise(-1))
    ok = c.withColumns({"_level": lv.cast("bigint"), "_extra": (keep - F.col("cum_s") - lv * rest).cast("bigint")}).where(F.col("_level") >= F.col("_a"))
    # the largest quota value whose level is not below it
    best = ok.agg(F.max(F.struct("_a", "_level", "_extra")).alias("b"))
    return best.select(F.coalesce("b._level", F.lit(1)).alias("_level"), F.coalesce("b._extra", F.lit(0)).alias("_extra"))


def undersample_balanced(train: DataFrame, subject: str, row_id: str, label: str, ratio: float, seed: int) -> DataFrame:
    quotas = subject_quotas(train, subject, label, ratio, seed).select(subject, "quota")
    d = ordinal(train.withColumn("_hx", seeded_md5(seed, F.col(row_id))), [subject, label], "_hx", row_id)
    d = d.transform(one_row, class_sizes(train, label)).join(quotas, subject, "left")
    return d.where((F.col(label) == F.col("minority")) | (F.col("idx") < F.col("quota"))).select(*train.columns)


def sampling_report(before: DataFrame, after: DataFrame, subject: str, label: str) -> DataFrame:
    """One row of class counts and the three warnings of a sampling step."""
    size = class_sizes(before, label)
    b = before.agg(F.count("*").alias("n_before"), F.sum(label).alias("pos_before"))
    a = after.agg(F.count("*").alias("n_after"), F.sum(label).alias("pos_after"))
    lost = before.select(subject).distinct().join(after.select(subject).distinct(), subject, "left_anti").agg(F.count("*").alias("subjects_lost"))
    top = after.groupBy(subject).agg(F.count("*").alias("_c")).agg(F.max("_c").alias("_mx"), F.sum("_c").alias("_sm"))
    r = b
    for x in (a, lost, top, size):
        r = r.transform(one_row, x)  # all one row
    maj_after = F.when(F.col("minority") == 1, F.col("n_after") - F.col("pos_after")).otherwise(F.col("pos_after"))
    return r.select("n_before", "pos_before", "n_after", "pos_after", "subjects_lost", (F.col("_mx") / F.col("_sm")).alias("top_subject_share"),
                    (F.col("subjects_lost") > 0).cast("int").alias("warn_lost"), (F.col("_mx") / F.col("_sm") > 0.10).cast("int").alias("warn_dominant"),
                    (maj_after / F.col("n_maj") < 0.4).cast("int").alias("warn_removed"))


def deficit_slots(df: DataFrame, row_id: str, label: str) -> DataFrame:
    """slot 0 .. (n_maj - n_min - 1): the surplus majority rows themselves number the rows to be made."""
    d = ordinal(df.withColumn("_hx", F.md5(F.col(row_id).cast("string"))), [label], "_hx", row_id)
    d = d.transform(one_row, class_sizes(df, label)).where((F.col(label) != F.col("minority")) & (F.col("idx") >= F.col("n_min")))
    return d.select((F.col("idx") - F.col("n_min")).alias("slot"), "minority", "n_min")


def indexed(df: DataFrame, row_id: str) -> DataFrame:
    return ordinal(df.withColumn("_hx", F.md5(F.col(row_id).cast("string"))), [], "_hx", row_id).drop("_hx")


def minority_rows(df: DataFrame, label: str) -> DataFrame:
    return df.transform(one_row, class_sizes(df, label)).where(F.col(label) == F.col("minority")).select(*df.columns)


def oversample_random(df: DataFrame, row_id: str, label: str, seed: int) -> DataFrame:
    """Extra minority rows drawn with replacement up to parity: (slot, source id)."""
    src = indexed(minority_rows(df, label), row_id).select("idx", F.col(row_id).alias("source_id"))
    s = deficit_slots(df, row_id, label).withColumn("idx", F.pmod(hash_int(seed, F.col("slot")), F.col("n_min")))
    return s.join(src, "idx").select("slot", "source_id")


def interpolate(slots: DataFrame, seeds: DataFrame, nn: DataFrame, columns, row_id: str, k: int, seed: int) -> DataFrame:
    """slots(slot, source_id) -> synthetic rows between the source and one hash-chosen neighbour."""
    avail = nn.groupBy("qid").agg(F.max("rank").alias("_kk"))
    s = slots.join(avail, slots["source_id"] == avail["qid"]).drop("qid").withColumn(
        "rank", F.pmod(hash_int(seed, "n", F.col("slot")), F.least(F.lit(k), F.col("_kk"))) + 1)
    s = s.join(nn.select(F.col("qid").alias("source_id"), "rank", F.col("rid").alias("partner_id")), ["source_id", "rank"])
    lam = hash_unit(seed, "l", F.col("slot"))
    a = seeds.select(F.col(row_id).alias("source_id"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = seeds.select(F.col(row_id).alias("partner_id"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    j = s.join(a, "source_id").join(b, "partner_id")
    return j.select("slot", "source_id", "partner_id", *[
        (F.col(f"_a_{c}") + lam * (F.col(f"_b_{c}") - F.col(f"_a_{c}"))).alias(c) for c in columns])


def _source(slots: DataFrame, seeds: DataFrame, row_id: str, seed: int) -> DataFrame:
    src = indexed(seeds, row_id).select("idx", "n", F.col(row_id).alias("source_id"))
    size = seeds.agg(F.count("*").alias("_n"))
    s = slots.transform(one_row, size).withColumn("idx", F.pmod(hash_int(seed, "i", F.col("slot")), F.col("_n")))
    return s.join(src.drop("n"), "idx").select("slot", "source_id")


def smote(df: DataFrame, columns, row_id: str, label: str, k: int = 5, seed: int = 0, standardise: bool = False) -> DataFrame:
    """Synthetic minority rows up to parity; with ``standardise`` the neighbours are searched in units of each column's sd over all rows."""
    pos = minority_rows(df, label)
    space = minority_rows(standard_scale(df, df, columns), label) if standardise else pos
    nn = materialise(nearest(space, space, columns, k, row_id, row_id, skip_self=True), "nn")
    return interpolate(_source(deficit_slots(df, row_id, label), pos, row_id, seed), pos, nn, columns, row_id, k, seed)


def majority_share(df: DataFrame, z: DataFrame, columns, row_id: str, label: str, k: int) -> DataFrame:
    """Share of majority rows among the k nearest of all rows, for each minority row, in standardised space."""
    nn = nearest(minority_rows(z, label), z, columns, k, row_id, row_id, skip_self=True)
    lab = df.transform(one_row, class_sizes(df, label)).select(F.col(row_id).alias("rid"), (F.col(label) != F.col("minority")).cast("int").alias("_m"))
    return materialise(nn.join(lab, "rid").groupBy("qid").agg(F.avg("_m").alias("share")).withColumnRenamed("qid", row_id), "share")


def borderline_smote(df: DataFrame, columns, row_id: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Seeds are minority rows whose majority-neighbour share is in [0.5, 1); all minority rows if fewer than two."""
    z = standard_scale(df, df, columns)
    share = majority_share(df, z, columns, row_id, label, k)
    flagged = minority_rows(df, label).join(share, row_id).withColumn("_d", ((F.col("share") >= 0.5) & (F.col("share") < 1)).cast("int"))
    n = flagged.agg(F.sum("_d").alias("_nd"))
    seeds = flagged.transform(one_row, n).where((F.col("_nd") < 2) | (F.col("_d") == 1)).select(*df.columns)
    zs = z.join(seeds.select(row_id), row_id, "left_semi")
    nn = materialise(nearest(zs, zs, columns, k, row_id, row_id, skip_self=True), "nn")
    return interpolate(_source(deficit_slots(df, row_id, label), seeds, row_id, seed), seeds, nn, columns, row_id, k, seed)


def adasyn(df: DataFrame, columns, row_id: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """round(share_i / sum(share) * deficit) synthetic rows per minority row."""
    z = standard_scale(df, df, columns)
    share = majority_share(df, z, columns, row_id, label, k)
    tot = share.agg(F.sum("share").alias("_t")).transform(one_row, class_sizes(df, label))
    g = share.transform(one_row, tot).withColumn("_g", F.bround(F.try_divide(F.col("share"), F.col("_t")) * (F.col("n_maj") - F.col("n_min"))).cast("int"))
    slots = g.where("_g > 0").select(F.col(row_id).alias("source_id"), F.explode(F.sequence(F.lit(1), F.col("_g"))).alias("_j"))
    slots = slots.select("source_id", F.concat_ws("-", "source_id", "_j").alias("slot"))
    pos = minority_rows(df, label)
    zp = minority_rows(z, label)
    nn = materialise(nearest(zp, zp, columns, k, row_id, row_id, skip_self=True), "nn")
    return interpolate(slots, pos, nn, columns, row_id, k, seed)


def tomek_links(df: DataFrame, columns, row_id: str, label: str) -> DataFrame:
    """Pairs of opposite classes that are each other's nearest row."""
    nn = materialise(nearest(df, df, columns, 1, row_id, row_id, skip_self=True).select("qid", "rid"), "nn")
    back = nn.select(F.col("qid").alias("rid"), F.col("rid").alias("qid"))
    lab = df.select(F.col(row_id), label)
    m = nn.join(back, ["qid", "rid"]).where("qid < rid")
    return m.join(lab.select(F.col(row_id).alias("qid"), F.col(label).alias("_a")), "qid").join(
        lab.select(F.col(row_id).alias("rid"), F.col(label).alias("_b")), "rid").where("_a <> _b").select("qid", "rid")


def smote_tomek(df: DataFrame, columns, row_id: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Rows after SMOTE with both members of every Tomek link removed; synthetic ids are negative."""
    made = smote(df, columns, row_id, label, k, seed).transform(one_row, class_sizes(df, label)).select(
        (-F.col("slot") - 1).cast("bigint").alias(row_id), F.col("minority").alias(label), *columns)
    both = df.select(F.col(row_id).cast("bigint").alias(row_id), F.col(label).cast("int").alias(label), *columns).unionByName(made)
    both = materialise(both, "smote")
    links = tomek_links(both, columns, row_id, label)
    gone = links.select(F.explode(F.array("qid", "rid")).alias(row_id))
    return both.join(gone, row_id, "left_anti")


def postprocess_synthetic(synthetic: DataFrame, train: DataFrame, columns, non_negative=()) -> DataFrame:
    """Clipped rows with counts of the violations found in each row."""
    params = train.agg(*[e for c in columns for e in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))])
    d = synthetic.transform(one_row, params)  # one row
    base = {c: (F.greatest(F.col(c), F.lit(0.0)) if c in non_negative else F.col(c)) for c in columns}
    add = lambda xs: sum(xs, F.lit(0))
    return d.select(
        *[F.greatest(F.least(base[c], F.col(f"{c}__hi")), F.col(f"{c}__lo")).alias(c) if c in base else F.col(c) for c in synthetic.columns],
        add([(F.col(c) < 0).cast("int") for c in non_negative]).alias("n_negative"),
        add([(base[c] < F.col(f"{c}__lo")).cast("int") for c in columns]).alias("n_below"),
        add([(base[c] > F.col(f"{c}__hi")).cast("int") for c in columns]).alias("n_above"))


def with_provenance(synthetic: DataFrame, train: DataFrame, subject: str, generator: str, seed: int, source_class: Column) -> DataFrame:
    """Literal provenance and an order-free digest of the subjects the generator was fitted on."""
    h = F.conv(F.substring(F.md5(F.col(subject).cast("string")), 1, 15), 16, 10).cast("bigint")
    digest = train.select(subject).distinct().agg(F.bit_xor(h).alias("source_digest"), F.count("*").alias("source_subjects"))
    return synthetic.transform(one_row, digest).withColumns({
        "generator": F.lit(generator), "gen_seed": F.lit(seed), "source_class": source_class, "is_synthetic": F.lit(1)})


def class_weights(df: DataFrame, label: str, power: float | None = None) -> DataFrame:
    """n / (k * n_class); with ``power`` raised and rescaled to mean 1 over the classes."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row per class
    d = c.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))
    if power is not None:
        d = d.withColumn("weight", F.pow("weight", F.lit(power)))
        d = d.withColumn("weight", F.col("weight") / F.avg("weight").over(w))
    return d


def subject_balanced_weights(df: DataFrame, subject: str, label: str) -> DataFrame:
    """Per subject: class weight over subjects divided by its rows, rescaled so that all rows sum to their number."""
    per = df.groupBy(subject).agg(F.max(label).alias(label), F.count("*").alias("rows"))
    cw = class_weights(per, label).select(label, F.col("weight").alias("_cw"))
    d = per.join(cw, label).withColumn("_raw", F.col("_cw") / F.col("rows"))
    tot = d.agg((F.sum("rows") / F.sum(F.col("_raw") * F.col("rows"))).alias("_scale"))
    return d.transform(one_row, tot).select(subject, label, "rows", (F.col("_raw") * F.col("_scale")).alias("weight"))


def bootstrap_weights(subjects: DataFrame, subject: str, draws: int, seed: int, by=(), carry=()) -> DataFrame:
    """(draw, subject, weight): each of the n slots of a draw picks a hash-chosen subject.

    Slots are the subjects' own positions, so slots are generated and counted where the data
    is; only counts are joined back. ``by`` keeps class sizes fixed.
    """
    by = list(by)
    d = ordinal(subjects.withColumn("_hx", F.md5(F.col(subject).cast("string"))), by, "_hx", subject).drop("_hx")
    slots = d.select(*by, F.col("idx").alias("_slot"), "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    tag = F.concat_ws(".", *[F.col(c).cast("string") for c in by]) if by else F.lit("all")
    picked = slots.withColumn("idx", F.pmod(hash_int(seed, tag, F.col("draw"), F.col("_slot")), F.col("n")))
    counts = picked.groupBy("draw", *by, "idx").agg(F.count("*").alias("weight"))
    return counts.join(d.select(subject, *by, "idx", *carry), [*by, "idx"]).drop("idx")


def prevalence_matched(df: DataFrame, row_id: str, label: str, target: float, repeats: int, seed: int) -> DataFrame:
    """Largest subsample with the target prevalence, drawn without replacement for each repeat."""
    n1, n0 = F.sum(F.col(label)), F.sum(1 - F.col(label))
    q = df.agg(n1.alias("_n1"), n0.alias("_n0"))
    neg = F.bround(F.col("_n1") * ((1 - target) / target)).cast("bigint")
    pos = F.bround(F.col("_n0") * (target / (1 - target))).cast("bigint")
    q = q.select(F.when(neg <= F.col("_n0"), F.col("_n1")).otherwise(F.least(pos, F.col("_n1"))).alias("_q1"),
                 F.when(neg <= F.col("_n0"), neg).otherwise(F.col("_n0")).alias("_q0"))
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = ordinal(d.withColumn("_hx", seeded_md5(seed, F.col("repeat"), F.col(row_id))), ["repeat", label], "_hx", row_id)
    return d.transform(one_row, q).where(F.col("idx") < F.when(F.col(label) == 1, F.col("_q1")).otherwise(F.col("_q0"))).select("repeat", *df.columns)
