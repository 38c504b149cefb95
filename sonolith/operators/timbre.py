"""Sound objects and morphological criteria of tracks, from their frames.

Spectra of envelopes are taken over windows of at most ``WINDOW`` frames and their powers added up, so that no task holds
a track's whole envelope; a track or object shorter than that has one window, its whole envelope.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp

#: Frames of an envelope's window, about a minute and a half.
WINDOW = 4096
# Thresholds of mass (median flatness, spread of log2 centroid in octaves), of facture (seconds, share of modulation).
TONIC, COMPLEX, DRIFT, IMPULSE_S, ITERATED = 0.004, 0.02, 0.35, 0.3, 0.45
TRACK = ["album", "track"]


def rates(f: DataFrame) -> DataFrame:
    """(album, track, rate): frames a second."""
    return f.groupBy(*TRACK).agg(F.coalesce(1 / F.max(F.col("t") / F.when(F.col("frame") > 0, F.col("frame"))), F.lit(22050 / dsp.HOP)).alias("rate"))


def _powers(low: float, high: float):
    """Of envelopes, (power between ``low`` and ``high`` Hz, power above 0.2 Hz, first frequency and step of the band, its powers); null for short or constant ones."""

    @F.pandas_udf("band double, total double, f0 double, df double, powers array<double>")
    def powers(envelope: pd.Series, rate: pd.Series) -> pd.DataFrame:
        out = []
        for e, r in zip(envelope, rate, strict=True):
            x = np.asarray(e, float)
            x = x - x.mean() if len(x) else x
            if len(x) < 16 or not np.any(x):
                out.append((None, None, None, None, None))
                continue
            p, fq = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2, np.fft.rfftfreq(len(x), 1 / r)
            own = (fq >= low) & (fq < high)
            out.append((p[own].sum(), p[fq > 0.2].sum(), fq[own][0] if own.any() else None, fq[1], list(p[own])))
        return pd.DataFrame(out, columns=["band", "total", "f0", "df", "powers"])

    return powers


def _windows(f: DataFrame, key: Sequence[str], value: Column, flat: bool) -> DataFrame:
    """(key, envelope) of each window of ``WINDOW`` frames of a key; a last one that isn't whole counts only where it is the only one."""
    first = f.groupBy(*key).agg(F.min("frame").alias("_first"), F.count("*").alias("_n"))
    w = f.join(first, list(key)).withColumn("_w", F.floor((F.col("frame") - F.col("_first")) / WINDOW)).filter((F.col("_w") == 0) | ((F.col("_w") + 1) * WINDOW <= F.col("_n")))
    g = w.groupBy(*key, "_w").agg(F.array_sort(F.collect_list(F.struct("frame", value.alias("_v")))).alias("_e"))
    values = F.transform("_e", lambda x: x["_v"])
    return g.select(*key, (F.flatten(values) if flat else values).alias("envelope"))


def modulation_shares(f: DataFrame, key: Sequence[str], value: Column, flat: bool, per_frame: float, low: float, high: float) -> DataFrame:
    """(key, share, peak_hz): the share of an envelope's modulation between ``low`` and ``high`` Hz and the strongest frequency there, 0 if it has none.

    ``f`` has frame, rate and ``value``, a number or (``flat``) an array of ``per_frame`` numbers a frame.
    """
    p = _windows(f, key, value, flat).join(f.groupBy(*key).agg(F.first("rate").alias("rate")), list(key)).select(*key, _powers(low, high)("envelope", F.col("rate") * per_frame).alias("p")).select(*key, "p.*")
    share = p.groupBy(*key).agg((F.sum("band") / F.when(F.sum("total") > 0, F.sum("total"))).alias("share"))
    bins = p.select(*key, "f0", "df", F.posexplode("powers").alias("i", "power")).groupBy(*key, "i").agg(F.sum("power").alias("power"), F.first("f0").alias("f0"), F.first("df").alias("df"))
    peak = bins.groupBy(*key).agg(F.max_by(F.col("f0") + F.col("i") * F.col("df"), F.struct("power", -F.col("i"))).alias("peak_hz"))
    return share.join(peak, list(key), "left").select(*key, F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("peak_hz", F.lit(0.0)).alias("peak_hz"))


def bounded(f: DataFrame) -> DataFrame:
    """Frames with ``object``, numbered in a track by the onsets, each moved back to the last valley of onset strength before it."""
    order = Window.partitionBy(*TRACK).orderBy("frame")
    valley = (F.col("onset") <= F.lag("onset").over(order)) & (F.col("onset") < F.lead("onset").over(order))
    back = F.coalesce(F.last(F.when(valley, F.col("frame")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    starts = f.withColumn("_back", back).filter("is_onset").select(*TRACK, F.col("_back").alias("frame")).distinct().withColumn("_start", F.lit(1))
    marked = f.join(starts, [*TRACK, "frame"], "left")
    return marked.withColumn("object", F.sum(F.when(F.col("frame") > 0, F.coalesce("_start", F.lit(0))).otherwise(0)).over(order)).drop("_start")


def sound_objects(f: DataFrame, least_s: float = 0.05) -> DataFrame:
    """Onset-bounded objects of at least ``least_s``: t0, t1, duration, mass (X complex, Y varying, N tonic) and facture (' impulse, '' iteration, held otherwise)."""
    o = bounded(f).join(rates(f), TRACK)
    key = [*TRACK, "object"]
    g = o.groupBy(*key).agg(F.min("t").alias("t0"), (F.max("t") + 1 / F.first("rate")).alias("t1"), F.median("flatness").alias("flat"), F.stddev_pop(F.log2(F.col("centroid") + 1e-6)).alias("spread"))
    g = g.withColumn("duration", F.col("t1") - F.col("t0")).filter(F.col("duration") >= least_s)
    held = o.join(g.filter(F.col("duration") >= IMPULSE_S).select(*key), key)  # envelopes of impulses aren't looked at
    iterated = modulation_shares(held, key, F.col("fine"), True, dsp.HOP / dsp.FINE, 4.0, 20.0).select(*key, F.col("share").alias("iteration"))
    mass = F.when(F.col("flat") >= COMPLEX, "X").when((F.col("flat") >= TONIC) | (F.col("spread") > DRIFT), "Y").otherwise("N")
    facture = F.when(F.col("duration") < IMPULSE_S, "'").when(F.col("iteration") > ITERATED, "''").otherwise("")
    return g.join(iterated, key, "left").select(*key, "t0", "t1", "duration", mass.alias("mass"), facture.alias("facture"), "iteration")


def object_profile(objects: DataFrame) -> DataFrame:
    """Per track the share of sounding time of each type of object."""
    t = objects.groupBy(*TRACK, F.concat("mass", "facture").alias("type")).agg(F.sum("duration").alias("d"))
    return t.select(*TRACK, "type", F.round(F.col("d") / F.sum("d").over(Window.partitionBy(*TRACK)), 4).alias("share"))


def profile_maps(objects: DataFrame) -> DataFrame:
    """(album, track, tartyp): the profile of a track as a map from type to share."""
    return object_profile(objects).groupBy(*TRACK).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "share")))).alias("tartyp"))


def moving_median(f: DataFrame, key: Sequence[str], value: Column, reach: int) -> Column:
    """The median of ``value`` over ``reach`` frames to each side in order of frame; beyond the ends the first and the last repeat."""
    order = Window.partitionBy(*key).orderBy("frame")
    near = F.collect_list(value).over(order.rowsBetween(-reach, reach))
    before = F.greatest(F.lit(0), reach + 1 - F.row_number().over(order))
    after = F.greatest(F.lit(0), reach + 1 - F.row_number().over(Window.partitionBy(*key).orderBy(F.col("frame").desc())))
    whole = F.concat(F.array_repeat(F.element_at(near, 1), before), near, F.array_repeat(F.element_at(near, -1), after))
    return F.element_at(F.array_sort(whole), reach + 1)


def criteria(f: DataFrame, attack_s: float = 0.5) -> DataFrame:
    """Per track seven criteria: masse (median flatness), timbre (mean centroid), grain (modulation at 20 to 100 Hz), allure (strongest of 0.5 to 8 Hz), dynamique (median seconds from onset to peak), profil_mel (changes of the strongest pitch class a second), profil_masse (spread of log10 flatness)."""
    own = f.join(rates(f), TRACK)
    grain = modulation_shares(own, TRACK, F.col("fine"), True, dsp.HOP / dsp.FINE, 20.0, 100.0).select(*TRACK, F.col("share").alias("grain"))
    allure = modulation_shares(own, TRACK, F.col("rms"), False, 1.0, 0.5, 8.0).select(*TRACK, F.col("peak_hz").alias("allure"))
    order = Window.partitionBy(*TRACK).orderBy("frame")
    reach = int(attack_s * 22050 / dsp.HOP)
    ahead = order.rowsBetween(0, reach - 1)
    attack = F.when(F.count("*").over(ahead) > 2, F.max_by("frame", F.struct("rms", -F.col("frame"))).over(ahead) - F.col("frame")) / F.col("rate")
    strongest = F.array_position("chroma", F.array_max("chroma")).cast("int")
    a = own.select(*TRACK, "frame", "t", "heard_s", "flatness", "centroid", "is_onset", attack.alias("_attack"), moving_median(own, TRACK, strongest, 4).alias("_pc"))
    a = a.withColumn("_moved", (F.col("_pc") != F.lag("_pc").over(order)).cast("int"))
    g = a.groupBy(*TRACK).agg(
        F.median("flatness").alias("masse"),
        F.avg("centroid").alias("timbre"),
        F.coalesce(F.median(F.when(F.col("is_onset"), F.col("_attack"))), F.lit(0.3)).alias("dynamique"),
        (F.coalesce(F.sum("_moved"), F.lit(0)) / F.greatest(F.max("heard_s"), F.lit(1e-9))).alias("profil_mel"),
        F.stddev_pop(F.log10(F.col("flatness") + 1e-6)).alias("profil_masse"),
    )
    return g.join(grain, TRACK).join(allure, TRACK).select(*TRACK, "masse", "timbre", "grain", "allure", "dynamique", "profil_mel", "profil_masse")
