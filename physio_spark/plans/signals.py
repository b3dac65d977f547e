"""Queries: smoothing, peaks, beat intervals, spectra and derived tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from physio_spark.functions.columns import first_valid
from physio_spark.operators import signal as G
from physio_spark.operators.features import PULSE_FEATURES, FeatureConfig, PulseConfig, pulse_window_features, window_features
from physio_spark.operators.ordered import scan
from physio_spark.plans.adapter import (
    DAY,
    LENGTH,
    SQL_ANNOTATIONS,
    SQL_SAMPLES,
    SQL_WINDOWS,
    STEP,
    annotations,
    samples,
    table,
    width_of,
)
from physio_spark.plans.registry import final, query

CHUNK = 50  # index chunk of the queries; recordings here have a few hundred samples at most
FS = 1.3  # nominal rate of the event series, so that 10 s are 13 samples


def indexed(spark, sf_dir):
    s = samples(spark, sf_dir).select("subject", "t", "event_id", "channel", "video", "value")
    width = width_of(s)
    return scan(s, ["subject"], ["t"], width, index="idx"), width


SQL_INDEXED = SQL_SAMPLES + """
i AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS idx,
             count(*) OVER (PARTITION BY subject) AS n FROM s),
"""


def sql_rolling(src: str, column: str, size: int, name: str, out: str, keys: str = "subject") -> str:
    """Centred mean over full windows only, then the edges take the first / last full value."""
    back, forth = size // 2, size - 1 - size // 2
    return f"""
{name}_0 AS (SELECT *, CASE WHEN idx >= {back} AND idx + {forth} < n THEN avg({column}) OVER (PARTITION BY {keys} ORDER BY idx
             ROWS BETWEEN {back} PRECEDING AND {forth} FOLLOWING) END AS full_mean FROM {src}),
{name} AS (SELECT * EXCLUDE (full_mean), CASE WHEN idx < {back} THEN max(full_mean) FILTER (WHERE idx = {back}) OVER (PARTITION BY {keys})
             WHEN idx + {forth} >= n THEN max(full_mean) FILTER (WHERE idx = n - 1 - {forth}) OVER (PARTITION BY {keys})
             ELSE full_mean END AS {out} FROM {name}_0),
"""


@query(
    "sig1_rolling_mean",
    final(SQL_INDEXED + sql_rolling("i", "value", 5, "r", "smooth"), "SELECT event_id, smooth FROM r", ["smooth"]),
)
def sig1(spark, sf_dir):
    rows, _ = indexed(spark, sf_dir)
    return G.rolling_mean(rows, "value", 5, ["subject"], out="smooth", chunk=CHUNK).select("event_id", "smooth")


SQL_TRACKS = (
    SQL_INDEXED
    + sql_rolling("i", "value", 13, "tn", "tonic")
    + "rs AS (SELECT *, value - tonic AS rest FROM tn),"
    + sql_rolling("rs", "rest", 3, "ph", "phasic")
)


@query(
    "sig2_detrend",
    final(SQL_TRACKS, "SELECT event_id, tonic, phasic FROM ph", ["tonic", "phasic"]),
)
def sig2(spark, sf_dir):
    rows, _ = indexed(spark, sf_dir)
    return G.detrend(rows, "value", FS, ["subject"], chunk=CHUNK).select("event_id", "tonic", "phasic")


@query(
    "sig3_fill_linear",
    final(
        SQL_INDEXED
        + """k AS (SELECT subject, idx, value FROM i WHERE channel <> 'error'),
p AS (SELECT i.subject, i.idx, i.event_id, k.idx AS bt, k.value AS bv FROM i ASOF LEFT JOIN k ON i.subject = k.subject AND i.idx >= k.idx),
q AS (SELECT p.*, k.idx AS ct, k.value AS cv FROM p ASOF LEFT JOIN k ON p.subject = k.subject AND p.idx <= k.idx)""",
        "SELECT event_id, CASE WHEN bt IS NULL THEN cv WHEN ct IS NULL OR ct = bt THEN bv "
        "ELSE bv + (idx - bt)::DOUBLE / (ct - bt) * (cv - bv) END AS value FROM q",
        ["value"],
    ),
)
def sig3(spark, sf_dir):
    rows, _ = indexed(spark, sf_dir)
    holes = rows.withColumn("value", F.when(F.col("channel") != "error", F.col("value")))
    return G.fill_linear(holes, ["value"], ["subject"], width=CHUNK).select("event_id", "value")


@query(
    "sig4_segment_ok",
    final(
        SQL_SAMPLES
        + """h AS (SELECT *, CASE WHEN channel <> 'error' THEN value END AS y FROM s),
             k AS (SELECT subject, video, count(*) >= 12 AND count(y) >= greatest(10, floor(count(*) * 0.5)) AND
                          coalesce(stddev_pop(y), 0) >= 1e-6 AS ok FROM h GROUP BY ALL)""",
        "SELECT event_id, CASE WHEN ok THEN y END AS value FROM h JOIN k USING (subject, video)",
        ["value"],
    ),
)
def sig4(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("value", F.when(F.col("channel") != "error", F.col("value")))
    return G.segment_ok(s, "value", ["subject", "video"], 12).select("event_id", "value")


@query(
    "sig5_zscore",
    final(
        SQL_SAMPLES + "m AS (SELECT subject, video, avg(value) AS mu, stddev_pop(value) AS sd FROM s GROUP BY ALL)",
        "SELECT event_id, CASE WHEN sd > 0 THEN (value - mu) / sd ELSE 0.0 END AS z_zero, "
        "CASE WHEN sd > 0 THEN (value - mu) / sd ELSE value - mu END AS z_center, "
        "(value - mu) / CASE WHEN sd < 1e-8 THEN 1.0 ELSE sd END AS z_unit FROM s JOIN m USING (subject, video)",
        ["z_zero", "z_center", "z_unit"],
    ),
)
def sig5(spark, sf_dir):
    rows = samples(spark, sf_dir).select("subject", "video", "event_id", "value")
    for mode in ("zero", "center", "unit"):
        rows = G.zscore(rows, ["value"], ["subject", "video"], mode, suffix=f"_{mode}")
    return rows.select("event_id", *[F.col(f"value_{m}").alias(f"z_{m}") for m in ("zero", "center", "unit")])


def sql_peaks(k: float, dist: int, op: str) -> str:
    return f"""
zs AS (SELECT *, CASE WHEN stddev_pop(value) OVER (PARTITION BY subject) > 0 THEN (value - avg(value) OVER (PARTITION BY subject))
              / stddev_pop(value) OVER (PARTITION BY subject) ELSE 0.0 END AS z,
              lag(value) OVER (PARTITION BY subject ORDER BY idx) AS lo, lead(value) OVER (PARTITION BY subject ORDER BY idx) AS hi FROM i),
cand AS (SELECT subject, idx, event_id, t, z FROM zs WHERE z > {k} AND value > lo AND value {op} hi),
hop AS (SELECT c.subject, c.idx, min(d.idx) AS nxt FROM cand c LEFT JOIN cand d ON d.subject = c.subject AND d.idx >= c.idx + {dist}
        GROUP BY ALL),
walk AS (SELECT subject, min(idx) AS idx FROM cand GROUP BY subject
         UNION ALL SELECT w.subject, h.nxt FROM walk w JOIN hop h ON h.subject = w.subject AND h.idx = w.idx WHERE h.nxt IS NOT NULL),
pk AS (SELECT cand.* FROM cand JOIN walk ON walk.subject = cand.subject AND walk.idx = cand.idx),
"""


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query(
    "sig6_peaks",
    recursive(final(SQL_INDEXED + sql_peaks(0.2, 3, ">="), "SELECT event_id, idx, z FROM pk", ["z"])),
)
def sig6(spark, sf_dir):
    s = samples(spark, sf_dir).select("subject", "t", "event_id", "value")
    found = G.peaks(s, "value", ["subject"], k=0.2, min_dist=3, width=width_of(s), chunk=CHUNK)
    return found.select("event_id", "idx", "z")


@query(
    "sig7_peak_features",
    recursive(
        final(
            SQL_INDEXED
            + sql_peaks(0.5, 2, ">")
            + f"d AS (SELECT subject, count(*) / {FS}::DOUBLE AS seconds FROM s GROUP BY subject),"
            "f AS (SELECT subject, count(*) AS n, avg(z) AS m, max(z) AS x FROM pk GROUP BY subject)",
            "SELECT d.subject, coalesce(n, 0) AS n_peaks, coalesce(n, 0) / seconds * 60.0 AS peaks_per_min, m AS height_mean, x AS height_max "
            "FROM d LEFT JOIN f USING (subject)",
            ["peaks_per_min", "height_mean", "height_max"],
        )
    ),
)
def sig7(spark, sf_dir):
    s = samples(spark, sf_dir).select("subject", "t", "event_id", "value")
    found = G.peaks(s, "value", ["subject"], k=0.5, min_dist=2, strict=True, width=width_of(s), chunk=CHUNK)
    seconds = s.groupBy("subject").agg((F.count(F.lit(1)) / FS).alias("seconds"))
    return G.peak_features(found, seconds, ["subject"])


@query("sig8_distance_peaks")
def sig8(spark, sf_dir):
    """Tallest-first thinning has no short SQL form; the tests compare it with brute force."""
    s = samples(spark, sf_dir).select("subject", "t", "event_id", "value")
    found = G.peaks(s, "value", ["subject"], min_dist=4, mode="distance", width=width_of(s), chunk=CHUNK)
    return found.select("event_id", "idx", "value")


SQL_IBI = (
    SQL_INDEXED
    + sql_peaks(0.2, 3, ">=")
    + f"""
ib AS (SELECT subject, idx, event_id, t, (idx - lag(idx) OVER (PARTITION BY subject ORDER BY idx)) / {FS}::DOUBLE AS ibi FROM pk),
iv AS (SELECT *, 60.0 / ibi AS rate, ibi - lag(ibi) OVER (PARTITION BY subject ORDER BY idx) AS ibi_diff FROM ib WHERE ibi IS NOT NULL),
"""
)


def _intervals(spark, sf_dir):
    s = samples(spark, sf_dir).select("subject", "t", "event_id", "value")
    beats = G.peaks(s, "value", ["subject"], k=0.2, min_dist=3, width=width_of(s), chunk=CHUNK)
    return G.ibi(beats, ["subject"], fs=FS, width=CHUNK)


@query(
    "sig9_ibi",
    recursive(final(SQL_IBI, "SELECT event_id, ibi, rate, ibi_diff FROM iv", ["ibi", "rate", "ibi_diff"])),
)
def sig9(spark, sf_dir):
    return _intervals(spark, sf_dir).select("event_id", "ibi", "rate", "ibi_diff")


def _hrv_sql(sdnn: str, factor: float) -> str:
    return recursive(
        final(
            SQL_IBI + "me AS (SELECT *, median(ibi) OVER (PARTITION BY subject) AS med FROM iv)",
            f"SELECT subject, count(*) AS n_ibi, avg(ibi) AS ibi_mean, {sdnn}(ibi) AS sdnn, sqrt(avg(ibi_diff * ibi_diff)) AS rmssd, "
            "CASE WHEN count(ibi_diff) > 1 THEN stddev_samp(ibi_diff) END AS sdsd, "
            f"avg(CASE WHEN ibi_diff IS NULL THEN NULL WHEN abs(ibi_diff) > 0.5 THEN 1.0 ELSE 0.0 END) * {factor} AS pnn50, "
            f"avg(CASE WHEN ibi_diff IS NULL THEN NULL WHEN abs(ibi_diff) > 0.2 THEN 1.0 ELSE 0.0 END) * {factor} AS pnn20, "
            "median(abs(ibi - med)) AS mad FROM me GROUP BY subject",
            ["ibi_mean", "sdnn", "rmssd", "sdsd", "pnn50", "pnn20", "mad"],
        )
    )


HRV = ["subject", "n_ibi", "ibi_mean", "sdnn", "rmssd", "sdsd", "pnn50", "pnn20", "mad"]


@query("sig10_hrv_percent", _hrv_sql("stddev_pop", 100.0))
def sig10(spark, sf_dir):
    return G.hrv_time(_intervals(spark, sf_dir), ["subject"], unit_ms=100.0).select(*HRV)


@query("sig10_hrv_fraction", _hrv_sql("stddev_samp", 1.0))
def sig10_fraction(spark, sf_dir):
    return G.hrv_time(_intervals(spark, sf_dir), ["subject"], ddof=1, as_percent=False, unit_ms=100.0).select(*HRV)


@query(
    "sig11_poincare",
    recursive(
        final(
            SQL_IBI
            + """v AS (SELECT subject, CASE WHEN count(ibi) > 1 THEN var_samp(ibi) END AS a, CASE WHEN count(ibi_diff) > 1 THEN var_samp(ibi_diff) END AS b
                       FROM iv GROUP BY subject),
                 d AS (SELECT subject, sqrt(b / 2) AS sd1, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN sqrt(greatest(0.0, 2 * a - b / 2)) END AS sd2 FROM v)""",
            "SELECT subject, sd1, sd2, CASE WHEN sd2 <> 0 THEN sd1 / sd2 END AS sd1_sd2, pi() * sd1 * sd2 AS ellipse FROM d",
            ["sd1", "sd2", "sd1_sd2", "ellipse"],
        )
    ),
)
def sig11(spark, sf_dir):
    out = G.hrv_time(_intervals(spark, sf_dir), ["subject"])
    return out.select("subject", "sd1", "sd2", "sd1_sd2", "ellipse")


LOW, HIGH, FSTEP = 0.1, 0.9, 0.1
SQL_SPECTRUM = (
    SQL_SAMPLES
    + f"""
o AS (SELECT subject, min(t) AS t0 FROM s GROUP BY subject),
f AS (SELECT unnest([{', '.join(str(x) for x in G.frequency_grid(LOW, HIGH, FSTEP))}])::DOUBLE AS freq),
m AS (SELECT s.subject, (t - t0) / {DAY}::DOUBLE AS d, value - avg(value) OVER (PARTITION BY s.subject) AS y FROM s JOIN o USING (subject)),
ps AS (SELECT subject, freq, count(*) AS n, (power(sum(y * w * cos(2 * pi() * freq * d)), 2) + power(sum(y * w * sin(2 * pi() * freq * d)), 2)) / count(*) AS pw
       FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * d / 30.0) AS w FROM m), f GROUP BY ALL),
"""
)


def _days(spark, sf_dir):
    s = samples(spark, sf_dir).select("subject", "t", "value")
    spans = scan(s, ["subject"], ["t"], width_of(s), whole={"_t0": ("min", F.col("t"))})
    return spans.withColumn("day", (F.col("t") - F.col("_t0")) / float(DAY))


@query(
    "sig12_band_peak",
    final(
        SQL_SPECTRUM,
        "SELECT subject, n AS n_samples, CASE WHEN n >= 4 THEN freq * 60.0 END AS per_min FROM ps "
        "QUALIFY row_number() OVER (PARTITION BY subject ORDER BY pw DESC, freq) = 1",
        ["per_min"],
        ["n_samples"],
    ),
)
def sig12(spark, sf_dir):
    rows = _days(spark, sf_dir)
    day = F.col("day")
    return G.band_peak(rows, "value", ["subject"], day, LOW, HIGH, FSTEP, taper=G.hann(day / 30.0))


PSTEP = 0.05
SQL_BANDS = (
    SQL_SAMPLES
    + f"""
o AS (SELECT subject, min(t) AS t0 FROM s GROUP BY subject),
iv AS (SELECT subject, (t - t0) / {DAY}::DOUBLE AS b, (t - lag(t) OVER (PARTITION BY subject ORDER BY t)) / {DAY}::DOUBLE AS ibi FROM s JOIN o USING (subject)
       QUALIFY ibi IS NOT NULL),
sp AS (SELECT subject, min(b) AS a, max(b) AS z FROM iv GROUP BY subject),
g AS (SELECT subject, a + k / 4.0::DOUBLE AS t FROM (SELECT *, unnest(range(0, CAST(floor((z - a) * 4.0) AS BIGINT) + 1)) AS k FROM sp)),
p AS (SELECT g.*, iv.b AS bt, iv.ibi AS bv FROM g ASOF LEFT JOIN iv ON g.subject = iv.subject AND g.t >= iv.b),
q AS (SELECT p.*, iv.b AS ct, iv.ibi AS cv FROM p ASOF LEFT JOIN iv ON p.subject = iv.subject AND p.t <= iv.b),
e AS (SELECT subject, t, CASE WHEN bt IS NULL THEN cv WHEN ct IS NULL OR ct = bt THEN bv ELSE bv + (t - bt) / (ct - bt) * (cv - bv) END AS y FROM q),
c AS (SELECT subject, t, y - avg(y) OVER (PARTITION BY subject) AS y FROM e),
f AS (SELECT unnest([{', '.join(str(x) for x in G.frequency_grid(0.1, 1.0, PSTEP))}])::DOUBLE AS freq),
ps AS (SELECT subject, freq, (power(sum(y * cos(2 * pi() * freq * t)), 2) + power(sum(y * sin(2 * pi() * freq * t)), 2)) / count(*) AS pw
       FROM c, f GROUP BY ALL),
bp AS (SELECT subject, sum(pw) FILTER (WHERE freq >= 0.1 AND freq < 0.4) AS lf, sum(pw) FILTER (WHERE freq >= 0.4 AND freq < 1.0) AS hf
       FROM ps GROUP BY subject)
"""
)


@query(
    "sig13_band_power",
    final(
        SQL_BANDS,
        "SELECT subject, lf, hf, CASE WHEN hf <> 0 THEN lf / hf END AS lf_hf FROM bp",
        ["lf", "hf", "lf_hf"],
    ),
)
def sig13(spark, sf_dir):
    rows = _days(spark, sf_dir)
    gaps = scan(rows, ["subject"], ["t"], width_of(rows), prev={"_p": F.col("t")}).where("_p is not null")
    intervals = gaps.select(
        "subject", F.col("day").alias("beat_s"), ((F.col("t") - F.col("_p")) / float(DAY)).alias("ibi")
    )
    return G.band_power(intervals, ["subject"], {"lf": (0.1, 0.4), "hf": (0.4, 1.0)}, PSTEP, 4.0, width=10)


@query(
    "sig14_first_valid",
    final(
        "",
        "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_discount - 0.05 > 0 THEN l_discount - 0.05 END, CASE WHEN l_tax > 0 THEN l_tax END, "
        "l_quantity) AS bpm FROM lineitem",
        ["bpm"],
        ["l_linenumber"],
    ),
)
def sig14(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", first_valid(F.col("l_discount") - 0.05, "l_tax", "l_quantity").alias("bpm")
    )


@query(
    "sig15_peak_amplitudes",
    final(
        SQL_SAMPLES + "e AS (SELECT *, CASE WHEN channel = 'error' AND value > 0 THEN value END AS amp FROM s)",
        "SELECT subject, video, count(*) FILTER (WHERE channel = 'error') AS scr_count, coalesce(avg(amp), 0) AS scr_amp_mean, "
        "coalesce(CASE WHEN count(amp) > 1 THEN stddev_samp(amp) END, 0) AS scr_amp_std, coalesce(max(amp), 0) AS scr_amp_max, "
        "coalesce(min(amp), 0) AS scr_amp_min, coalesce(median(amp), 0) AS scr_amp_median, "
        "coalesce(quantile_cont(amp, 0.75) - quantile_cont(amp, 0.25), 0) AS scr_amp_iqr FROM e GROUP BY ALL",
        ["scr_amp_mean", "scr_amp_std", "scr_amp_max", "scr_amp_min", "scr_amp_median", "scr_amp_iqr"],
        ["video"],
    ),
)
def sig15(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("peak", (F.col("channel") == "error").cast("int"))
    return G.peak_amplitude_stats(s, ["subject", "video"], "peak", "value")


# ---------------------------------------------------------------- derived tracks

SQL_DERIVED = (
    SQL_TRACKS
    + "sq AS (SELECT *, value * value AS square FROM ph),"
    + sql_rolling("sq", "square", 3, "en", "mean_square")
    + sql_peaks(1.0, 3, ">=")
    + f"""
bt AS (SELECT subject, idx, (idx - lag(idx) OVER (PARTITION BY subject ORDER BY idx)) / {FS}::DOUBLE AS ibi FROM pk),
br AS (SELECT subject, idx, 60.0 / ibi AS rate FROM bt WHERE ibi IS NOT NULL),
pr AS (SELECT en.*, br.idx AS bx, br.rate AS bv FROM en ASOF LEFT JOIN br ON en.subject = br.subject AND en.idx >= br.idx),
qr AS (SELECT pr.*, br.idx AS cx, br.rate AS cv FROM pr ASOF LEFT JOIN br ON pr.subject = br.subject AND pr.idx <= br.idx),
tr AS (SELECT subject, video, event_id, t, n, value, tonic, phasic, sqrt(greatest(mean_square, 0)) AS envelope,
       CASE WHEN bx IS NULL THEN cv WHEN cx IS NULL OR cx = bx THEN bv ELSE bv + (idx - bx)::DOUBLE / (cx - bx) * (cv - bv) END AS rate FROM qr)
"""
)


def _tracks(spark, sf_dir):
    s = samples(spark, sf_dir).select("subject", "t", "event_id", "video", "value")
    return G.derive_tracks(s, "value", FS, ["subject"], min_beat_s=2.5, width=width_of(s), chunk=CHUNK)


@query(
    "sig16_derived_tracks",
    recursive(
        final(
            SQL_DERIVED,
            "SELECT subject, video, avg(tonic) AS tonic, avg(phasic) AS phasic, stddev_pop(phasic) AS phasic_std, max(tonic) AS tonic_max "
            "FROM tr GROUP BY ALL",
            ["tonic", "phasic", "phasic_std", "tonic_max"],
            ["video"],
        )
    ),
)
def sig16(spark, sf_dir):
    return (
        _tracks(spark, sf_dir)
        .groupBy("subject", "video")
        .agg(
            F.avg("tonic").alias("tonic"),
            F.avg("phasic").alias("phasic"),
            F.stddev_pop("phasic").alias("phasic_std"),
            F.max("tonic").alias("tonic_max"),
        )
    )


@query("sig17_rate_track", recursive(final(SQL_DERIVED, "SELECT event_id, rate FROM tr", ["rate"])))
def sig17(spark, sf_dir):
    return _tracks(spark, sf_dir).select("event_id", "rate")


@query(
    "sig18_activation",
    final(
        SQL_INDEXED + "sq AS (SELECT *, value * value AS square FROM i)," + sql_rolling("sq", "square", 3, "en", "ms"),
        "SELECT subject, video, avg(sqrt(ms)) AS envelope_mean, avg(CASE WHEN ms IS NULL THEN NULL WHEN sqrt(ms) > 60 THEN 1.0 ELSE 0.0 END) AS active_share "
        "FROM en GROUP BY ALL",
        ["envelope_mean", "active_share"],
        ["video"],
    ),
)
def sig18(spark, sf_dir):
    rows, _ = indexed(spark, sf_dir)
    env = G.envelope(rows, "value", 3, ["subject"], chunk=CHUNK)
    return G.activation(env, ["subject", "video"], 60.0)


SQL_FEATURES = (
    SQL_WINDOWS
    + SQL_ANNOTATIONS
    + f"""
ap AS (SELECT x.*, a.t AS bt, a.valence AS bv FROM x ASOF LEFT JOIN a ON x.subject = a.subject AND x.t >= a.t),
aq AS (SELECT ap.*, a.t AS ct, a.valence AS cv FROM ap ASOF LEFT JOIN a ON ap.subject = a.subject AND ap.t <= a.t),
ax AS (SELECT *, CASE WHEN bt IS NULL THEN cv WHEN ct IS NULL OR ct = bt THEN bv ELSE bv + (t - bt)::DOUBLE / (ct - bt)::DOUBLE * (cv - bv) END AS valence FROM aq),
i AS (SELECT subject, block, t, value, row_number() OVER v - 1 AS idx, stddev_pop(value) OVER (PARTITION BY subject, block) AS sd,
             avg(value) OVER (PARTITION BY subject, block) AS mu, lag(value) OVER v AS lo, lead(value) OVER v AS hi
      FROM b1 WINDOW v AS (PARTITION BY subject, block ORDER BY t)),
cand AS (SELECT subject, block, idx, t FROM i WHERE sd > 0 AND (value - mu) / sd > 0.2 AND value > lo AND value >= hi),
hop AS (SELECT c.subject, c.block, c.idx, min(d.idx) AS nxt FROM cand c LEFT JOIN cand d
        ON d.subject = c.subject AND d.block = c.block AND d.idx >= c.idx + 2 GROUP BY ALL),
walk AS (SELECT subject, block, min(idx) AS idx FROM cand GROUP BY ALL
         UNION ALL SELECT w.subject, w.block, h.nxt FROM walk w JOIN hop h ON h.subject = w.subject AND h.block = w.block AND h.idx = w.idx
         WHERE h.nxt IS NOT NULL),
pk AS (SELECT cand.* FROM cand JOIN walk USING (subject, block, idx)),
ib AS (SELECT *, (idx - lag(idx) OVER (PARTITION BY subject, block ORDER BY idx)) / {FS}::DOUBLE * 1000 AS ibi FROM pk),
hv AS (SELECT w.subject, w.block, w.win, count(*) AS n_ibi, avg(ibi) AS ibi_mean FROM w JOIN ib
       ON ib.subject = w.subject AND ib.block = w.block AND ib.t >= w.win_start AND ib.t < w.win_end AND ibi IS NOT NULL GROUP BY ALL),
fx AS (SELECT subject, block, win, count(*) AS n_rows, avg(value) AS value_mean, stddev_pop(value) AS value_std0,
              coalesce(avg((value - before) * {FS}), 0.0) AS value_diff_mean, avg(valence) AS label_valence FROM ax GROUP BY ALL HAVING count(*) > 1)
"""
)


@query(
    "sig19_window_features",
    recursive(
        final(
            SQL_FEATURES,
            "SELECT fx.*, n_ibi, ibi_mean, 60000.0 / ibi_mean AS bpm FROM fx LEFT JOIN hv USING (subject, block, win)",
            ["value_mean", "value_std0", "value_diff_mean", "label_valence", "ibi_mean", "bpm"],
            ["block"],
        )
    ),
)
def sig19(spark, sf_dir):
    s = samples(spark, sf_dir).select("subject", "t", "video", "value")
    config = FeatureConfig(
        LENGTH, STEP, FS, "value", ["value"], units_per_second=float(DAY), beat_threshold=0.2, beat_distance_s=1.7,
        chunk=CHUNK, baseline_s=3.0,
    )
    out = window_features(s, annotations(samples(spark, sf_dir)), config, width=width_of(s))
    return out.select(
        "subject", "block", "win", "n_rows", "value_mean", "value_std0", "value_diff_mean", "label_valence",
        "n_ibi", "ibi_mean", "bpm",
    )


SIZE, HOP = 26, 4  # samples of 20 s and 3 s at the nominal rate
RATE_BAND, BREATH_BAND = (0.3, 0.6, 0.05), (0.1, 0.25, 0.025)


def _sql_grid(band) -> str:
    return ", ".join(str(f) for f in G.frequency_grid(*band))


SQL_PULSE = (
    SQL_IBI
    + f"""
a AS (SELECT subject, t, value AS valence, sqrt(value) AS arousal FROM s WHERE channel = 'view'),
w AS (SELECT subject, unnest(range(0, (n - {SIZE}) // {HOP} + 1)) AS win FROM (SELECT DISTINCT subject, n FROM i WHERE n >= {SIZE})),
x AS (SELECT w.win, i.*, i.value * i.value AS gsr, ln(1 + i.value) AS skt FROM w JOIN i ON i.subject = w.subject AND i.idx >= win * {HOP} AND i.idx < win * {HOP} + {SIZE}),
base AS (SELECT subject, win, min(t) AS window_start, max(t) AS window_end, avg(gsr) AS gsr_mean, regr_slope(gsr, idx) AS gsr_slope,
                avg(skt) AS skt_mean, regr_slope(skt, idx) AS skt_slope FROM x GROUP BY ALL),
vote AS (SELECT subject, win, video AS video_id FROM x GROUP BY subject, win, video
         QUALIFY row_number() OVER (PARTITION BY subject, win ORDER BY count(*) DESC, video) = 1),
be AS (SELECT subject, idx, lag(idx) OVER o AS p0, lag(idx, 2) OVER o AS p1 FROM pk WINDOW o AS (PARTITION BY subject ORDER BY idx)),
hb AS (SELECT w.subject, w.win, (be.idx - p0) / {FS}::DOUBLE * 1000 AS ibi, CASE WHEN p1 >= w.win * {HOP} THEN ((be.idx - p0) - (p0 - p1)) / {FS}::DOUBLE * 1000 END AS d
       FROM w JOIN be ON be.subject = w.subject AND p0 >= w.win * {HOP} AND be.idx < w.win * {HOP} + {SIZE}),
hm AS (SELECT *, median(ibi) OVER (PARTITION BY subject, win) AS med FROM hb),
hv AS (SELECT subject, win, avg(ibi) AS bvp_ibi, stddev_samp(ibi) AS bvp_sdnn, CASE WHEN count(d) > 1 THEN stddev_samp(d) END AS bvp_sdsd, sqrt(avg(d * d)) AS bvp_rmssd,
              avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d) > 2000 THEN 1.0 ELSE 0.0 END) AS bvp_pnn20, avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d) > 5000 THEN 1.0 ELSE 0.0 END) AS bvp_pnn50,
              median(abs(ibi - med)) AS bvp_mad, var_samp(ibi) AS va, CASE WHEN count(d) > 1 THEN var_samp(d) END AS vd FROM hm GROUP BY subject, win HAVING count(*) >= 2),
sd AS (SELECT *, sqrt(vd / 2) AS bvp_sd1, CASE WHEN vd IS NOT NULL THEN CASE WHEN 2 * va - vd / 2 > va * 1e-12 THEN sqrt(2 * va - vd / 2) ELSE 0.0 END END AS bvp_sd2 FROM hv),
f AS (SELECT DISTINCT unnest([{_sql_grid(RATE_BAND)}, {_sql_grid(BREATH_BAND)}])::DOUBLE AS freq),
m AS (SELECT subject, win, idx, value - avg(value) OVER (PARTITION BY subject, win) AS y, 0.5 - 0.5 * cos(2 * pi() * (idx - win * {HOP}) / {SIZE}.0) AS wt FROM x),
ps AS (SELECT subject, win, freq, (power(sum(y * wt * cos(2 * pi() * freq * idx / {FS})), 2) + power(sum(y * wt * sin(2 * pi() * freq * idx / {FS})), 2)) / count(*) AS pw
       FROM m, f GROUP BY ALL),
rate AS (SELECT subject, win, freq * 60 AS fft FROM ps WHERE freq IN ({_sql_grid(RATE_BAND)}) QUALIFY row_number() OVER (PARTITION BY subject, win ORDER BY pw DESC, freq) = 1),
breath AS (SELECT subject, win, freq * 60 AS bvp_breathingrate FROM ps WHERE freq IN ({_sql_grid(BREATH_BAND)})
           QUALIFY row_number() OVER (PARTITION BY subject, win ORDER BY pw DESC, freq) = 1),
an AS (SELECT base.subject, win, avg(valence) AS valence, avg(arousal) AS arousal FROM base JOIN a ON a.subject = base.subject AND a.t BETWEEN window_start AND window_end GROUP BY ALL)
"""
)


@query(
    "sig19_seventeen_features",
    recursive(
        final(
            SQL_PULSE,
            "SELECT base.subject, win, window_start, window_end, video_id, arousal, valence, coalesce(60000.0 / bvp_ibi, fft) AS bvp_bpm, bvp_ibi, bvp_sdnn, bvp_sdsd, bvp_rmssd, "
            "bvp_pnn20, bvp_pnn50, bvp_mad, bvp_sd1, bvp_sd2, pi() * bvp_sd1 * bvp_sd2 / 1e6::DOUBLE AS bvp_s, CASE WHEN bvp_sd2 <> 0 THEN bvp_sd1 / bvp_sd2 END AS bvp_sd1sd2, "
            "bvp_breathingrate, gsr_mean, gsr_slope, skt_mean, skt_slope FROM base LEFT JOIN vote USING (subject, win) LEFT JOIN sd USING (subject, win) "
            "LEFT JOIN rate USING (subject, win) LEFT JOIN breath USING (subject, win) LEFT JOIN an USING (subject, win)",
            ["arousal", "valence", *PULSE_FEATURES],
            ["video_id"],
        )
    ),
)
def sig19_seventeen(spark, sf_dir):
    s = samples(spark, sf_dir)
    pulse = s.select("subject", "t", "video", F.col("value").alias("bvp"), (F.col("value") * F.col("value")).alias("gsr"), F.log1p("value").alias("skt"))
    config = PulseConfig(
        FS, length_s=20.0, step_s=3.0, beat_threshold=0.2, beat_distance_s=2.4, rate_band=RATE_BAND, breath_band=BREATH_BAND,
        interval_unit_ms=0.01, chunk=CHUNK,
    )
    out = pulse_window_features(pulse, annotations(s), config, width=width_of(s))
    return out.withColumn("bvp_s", F.col("bvp_s") / 1e6)  # square seconds
