"""Named feature sets over intraday arrays. Each function returns name -> Column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from diurna.functions import series as S
from diurna.functions.numbers import MISSING_TOKENS, known, ratio


def parse_series(text: Column, keep_positions: bool = True) -> Column:
    """Slash or comma separated text to array<double>.

    Trailing separators are ignored. A bad token is NULL, or is dropped together with
    its position when ``keep_positions`` is False.
    """
    empty = F.lower(F.trim(text)).isin(*MISSING_TOKENS)
    tokens = F.transform(F.split(F.rtrim(F.trim(text), F.lit("/")), "[/,]"), lambda x: known(F.trim(x).try_cast("double")))
    out = tokens if keep_positions else F.array_compact(tokens)
    return F.when(empty, F.array().cast("array<double>")).otherwise(out)


def length_gate(a: Column, n: int, low: float, high: float) -> Column:
    """The array itself if it has exactly n elements, all inside [low, high]; else NULL."""
    return F.when((F.size(a) == n) & F.forall(a, lambda x: F.coalesce(x.between(low, high), F.lit(False))), a)


def class_fractions(codes: Column, labels, active_from: int, not_worn: int) -> dict[str, Column]:
    out = {f"code_{k}": S.share(codes, S.is_code(k)) for k in labels}
    out["unknown"] = S.share(codes, lambda x: ~x.isin(*labels))
    out["active"] = S.share(codes, lambda x: x >= active_from)
    out["not_worn"] = S.share(codes, lambda x: x == not_worn)
    return out


def numeric_stats(a: Column, expected: int | None = None) -> dict[str, Column]:
    v, o = S.known(a), S.ordered(a)
    n = F.size(v)
    out = {"valid_n": n, "valid_ratio": n / (F.lit(expected) if expected else F.greatest(F.size(a), F.lit(1))),
           "mean": S.mean(v), "std": S.sd(v), "var": S.var(v), "min": F.array_min(v), "max": F.array_max(v)}
    for q, name in ((0.1, "q10"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (0.9, "q90")):
        out[name] = S.quantile(o, q)
    out["iqr"] = S.let(o, lambda v: S.quantile(v, 0.75) - S.quantile(v, 0.25))
    return out


def threshold_shares(a: Column, low: float, mid: float, high: float) -> dict[str, Column]:
    return {"sedentary": S.share(a, lambda x: x <= low), "moderate": S.share(a, lambda x: (x > low) & (x <= mid)),
            "vigorous": S.share(a, lambda x: x > mid), "ge_mid": S.share(a, lambda x: x >= mid),
            "ge_high": S.share(a, lambda x: x >= high)}


def bout_stats(a: Column, predicate) -> dict[str, Column]:
    r = S.run_lengths(S.known(a), predicate)
    return {"bout_mean": S.mean(r), "bout_max": F.array_max(r), "bout_n": F.size(r)}


def night_structure(stages: Column, epoch_minutes: int = 5, min_epochs: int = 12,
                    deep: int = 1, light: int = 2, rem: int = 3, awake: int = 4) -> dict[str, Column]:
    """Onset, wake after onset, awakenings and fragmentation of one stage sequence."""
    v = S.known(stages)
    onset = S.argmax(F.transform(v, lambda x: (x != awake).cast("int")))
    any_sleep = F.exists(v, lambda x: x != awake)
    after = F.slice(v, onset.cast("int") + 1, F.greatest(F.size(v), F.lit(1)))
    hours = F.size(v) * epoch_minutes / F.lit(60.0)
    changes = S.count_if(S.adjacent(v, lambda x, y: x != y), lambda t: t)
    per_hour = F.greatest(hours, F.lit(1.0))

    def bout(code):
        return S.longest_run(v, lambda x: x == code) * F.lit(float(epoch_minutes))

    out = {
        "onset_epochs": onset, "waso_min": S.count_if(after, lambda x: x == awake) * F.lit(float(epoch_minutes)),
        "awakenings": F.size(S.run_lengths(after, lambda x: x == awake)), "frag_per_hour": changes / hours,
        "deep_bout_max": bout(deep), "rem_bout_max": bout(rem),
        "light_awake_per_hour": S.pair_count(v, light, awake) / per_hour,
        "deep_light_per_hour": S.pair_count(v, deep, light) / per_hour,
    }
    usable = (F.size(v) >= min_epochs) & any_sleep
    return {k: F.when(usable, e) for k, e in out.items()}


def night_signal(a: Column, epoch_minutes: int = 5, min_epochs: int = 12) -> dict[str, Column]:
    """Level, spread, slope per hour and dip of a heart-rate-like signal; zero means no reading."""
    v = F.filter(a, lambda x: x > 0)
    early = F.slice(v, 1, F.greatest(F.lit(6), (F.size(v) / 6).cast("int")))
    out = {"mean": S.mean(v), "min": F.array_min(v), "max": F.array_max(v), "std": S.sd(v), "cv": ratio(S.sd(v), F.abs(S.mean(v))),
           "slope_per_hour": S.slope(v) * (60.0 / epoch_minutes), "dip": S.mean(early) - F.array_min(v),
           "min_position": S.argmin(v) / F.size(v)}
    return {k: F.when(F.size(v) >= min_epochs, e) for k, e in out.items()}


def hr_drop(hr: Column, stages: Column, epoch_minutes: int = 5) -> dict[str, Column]:
    v = F.filter(hr, lambda x: x > 0)
    base = S.mean(F.slice(v, 1, 3))
    drop = F.when(F.size(v) >= 4, base - F.array_min(v))
    nrem = S.count_if(stages, lambda x: x.isin(1, 2)) * (epoch_minutes / 60.0)
    return {"hr_drop_ratio": F.when(base > 0, drop / base), "hr_drop_per_nrem_hour": F.when(nrem > 0, drop / nrem)}


def most_least_active(profile: Column, wide: int = 10, narrow: int = 5, start_hour: int = 0) -> dict[str, Column]:
    """Highest and lowest circular window means of a 24-slot profile and their onset hours."""
    w, n = S.circular_window_means(profile, wide), S.circular_window_means(profile, narrow)
    m10, l5 = F.array_max(w), F.array_min(n)
    return {"m10": m10, "l5": l5, "ra": ratio(m10 - l5, m10 + l5),
            "m10_onset": (S.argmax(w) + start_hour) % 24, "l5_onset": (S.argmin(n) + start_hour) % 24}


# Sliding windows over 1440 minutes need prefix sums. As exploded rows under a window function
# they took about 1.5 ms per day on one machine, as Arrow batches in numpy about 0.08 ms, so these
# features use one small vectorised helper each; days stay where the aggregation left them.
CHUNK = 512  # days held as a dense matrix at once


def _chunks(mins: pd.Series, vals: pd.Series, n: int):
    """(first row, matrix of n columns with NaN for unknown minutes), CHUNK days at a time."""
    for at in range(0, len(mins), CHUNK):
        part = range(at, min(at + CHUNK, len(mins)))
        x = np.full((len(part), n), np.nan)
        for i, k in enumerate(part):
            x[i, mins.iat[k]] = np.asarray(vals.iat[k], dtype=float)
        yield at, x


def _window_means(x: np.ndarray, width: int, min_known: float) -> np.ndarray:
    """Mean of the known minutes of every complete window; NaN below ``min_known`` known minutes."""
    zero = np.zeros((len(x), 1))
    s = np.concatenate([zero, np.cumsum(np.nan_to_num(x), axis=1)], axis=1)
    c = np.concatenate([zero, np.cumsum(~np.isnan(x), axis=1)], axis=1)
    count = c[:, width:] - c[:, :-width]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count >= max(min_known, 1), (s[:, width:] - s[:, :-width]) / count, np.nan)


def window_extrema(days: DataFrame, keys, mins: str, vals: str, wide: int = 600, narrow: int = 300, min_share: float = 0.8, n: int = 1440) -> DataFrame:
    """Highest wide-window and lowest narrow-window mean per day with their start minutes.

    As many known minutes as floor(min_share * width) are required in a window.
    """
    def extrema(m: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = np.full((len(m), 4), np.nan)
        for at, x in _chunks(m, v, n):
            hi, lo = _window_means(x, wide, int(min_share * wide)), _window_means(x, narrow, int(min_share * narrow))
            for j, w, pick, fill in ((0, hi, np.argmax, -np.inf), (2, lo, np.argmin, np.inf)):
                ok = ~np.isnan(w).all(axis=1)
                best = pick(np.where(np.isnan(w), fill, w), axis=1)
                rows = at + np.flatnonzero(ok)
                out[rows, j], out[rows, j + 1] = w[ok, best[ok]], best[ok]
        return pd.DataFrame(out, columns=["m10", "m10_start", "l5", "l5_start"])

    udf = F.pandas_udf(extrema, "m10 double, m10_start double, l5 double, l5_start double")
    d = days.select(*keys, udf(mins, vals).alias("_w"))
    return d.select(*keys, "_w.m10", "_w.l5", F.col("_w.m10_start").cast("int").alias("m10_start"), F.col("_w.l5_start").cast("int").alias("l5_start"))


def wake_windows(days: DataFrame, keys, mins: str, vals: str, threshold: float, width: int = 30, min_length: int = 240, sedentary: float | None = None, n: int = 1440) -> DataFrame:
    """Wake window (onset, offset_minute) of each day and the sedentary bouts inside it.

    The window runs from the first start to the last end of a ``width``-minute window whose
    known mean reaches the threshold; NULL if shorter than ``min_length``. Unknown minutes
    break a bout.
    """
    below = threshold if sedentary is None else sedentary

    def wake(m: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = np.full((len(m), 6), np.nan)
        for at, x in _chunks(m, v, n):
            w = _window_means(x, width, 1)
            hit = np.where(np.isnan(w), -np.inf, w) >= threshold
            onset, end = hit.argmax(axis=1), hit.shape[1] - 1 - hit[:, ::-1].argmax(axis=1) + width
            ok = hit.any(axis=1) & (end - onset >= min_length)
            minute = np.arange(n)
            inside = (minute >= onset[:, None]) & (minute < end[:, None]) & ok[:, None]
            with np.errstate(invalid="ignore"):
                sed = inside & (x < below)
            edge = np.diff(np.pad(sed, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, start = np.nonzero(edge == 1)
            length = np.nonzero(edge == -1)[1] - start
            longest, number = np.zeros(len(x)), np.bincount(row, minlength=len(x))
            np.maximum.at(longest, row, length)
            total = sed.sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                res = np.column_stack([onset, end, total, longest, total / number, number]).astype(float)
            res[number == 0, 4] = np.nan
            res[~ok] = np.nan
            out[at:at + len(x)] = res
        return pd.DataFrame(out, columns=["onset", "offset_minute", "sed_total", "sed_longest", "sed_mean", "sed_n"])

    names = ("onset", "offset_minute", "sed_total", "sed_longest", "sed_mean", "sed_n")
    udf = F.pandas_udf(wake, ", ".join(f"{c} double" for c in names))
    d = days.select(*keys, udf(mins, vals).alias("_w"))
    return d.select(*keys, *[(F.col(f"_w.{c}") if c == "sed_mean" else F.col(f"_w.{c}").cast("int")).alias(c) for c in names])


def dynamics(a: Column) -> dict[str, Column]:
    """Successive-difference statistics of a gap-filled series; stage the argument as a column first."""
    d = S.differences(a)
    centred = S.let(a, lambda v: S.let(S.mean(v), lambda m: F.transform(v, lambda x: x - m)))
    sign = F.transform(centred, lambda x: F.when(x < 0, -1).otherwise(1))
    crossings = S.count_if(S.adjacent(sign, lambda x, y: x != y), lambda t: t)
    var0, var1, var2 = S.var(a), S.var(d), S.var(S.differences(d))
    dot = S.let(centred, lambda v: F.struct(
        S.total(S.adjacent(v, lambda x, y: x * y)).alias("lagged"), S.total(F.transform(v, lambda x: x * x)).alias("square")))
    return {
        "mad_diff": S.mean(F.transform(d, F.abs)), "rmssd": F.sqrt(S.mean(F.transform(d, lambda x: x * x))),
        "zero_crossing": crossings / F.greatest(F.size(a) - 1, F.lit(1)).cast("double"),
        "hjorth_complexity": F.when((var0 > 1e-12) & (var1 > 1e-12) & (var2 > 1e-12), F.sqrt(var2 / var1) / F.sqrt(var1 / var0)),
        "iv": F.when(var0 > 1e-12, var1 / var0),
        "acf1": F.when(var0 > 1e-12, dot["lagged"] / F.greatest(dot["square"], F.lit(1e-12)))}


def active_position(codes: Column, active_from: int) -> dict[str, Column]:
    """Relative mean position of active epochs and active share of each half."""
    v = S.known(codes)
    idx = F.filter(S.positions(F.size(v)), lambda i: F.get(v, i) >= active_from)
    half = (F.size(v) / 2).cast("int")
    return {"centroid": S.mean(idx) / F.greatest(F.size(v) - 1, F.lit(1)),
            "first_half": S.share(F.slice(v, 1, half), lambda x: x >= active_from),
            "second_half": S.share(F.slice(v, half + 1, F.greatest(F.size(v), F.lit(1))), lambda x: x >= active_from)}


@F.pandas_udf(DoubleType())
def _peak_share(filled: pd.Series) -> pd.Series:
    """Largest share of power in one harmonic; FFT per series, Arrow-batched."""
    out = []
    for x in filled:
        v = None if x is None else np.asarray(x, float)
        if v is None or not len(v) or np.isnan(v).any():
            out.append(None)
            continue
        power = np.abs(np.fft.rfft(v - v.mean())[1:]) ** 2
        total = power.sum()
        out.append(float(power.max() / total) if len(power) and total > 1e-12 else None)
    return pd.Series(out, index=filled.index, dtype=float)


def spectral_peak(filled: Column, n_known: Column, min_known: int = 8) -> Column:
    """Largest share of power in one harmonic of a gap-filled series."""
    return F.when((n_known >= min_known) & (S.sd(filled) > 1e-12), F.nullif(_peak_share(filled), F.lit(float("nan"))))


def first_harmonic(profile: Column) -> Column:
    amp = S.amplitudes(profile, F.sequence(F.lit(1), F.lit(12)))
    return S.let(amp, lambda p: F.get(p, F.lit(0)) / (S.total(p) + 1e-6))
