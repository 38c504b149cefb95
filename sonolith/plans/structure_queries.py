"""Queries of the structure operators, each with its SQL.

Stand-ins: the embeddings of a label are a recording, one frame each in order of vec_id; the first twelve components by
size are its chroma, halves its channels. Events of a type are a recording of frames of an hour.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import circular
from ..operators import structure as st
from .queries import _R, _chroma, _rounded, _seconds, _t, query


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").withColumn("frame", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    return e.select(F.col("label").alias("recording"), "frame", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("recording"), F.floor(_seconds() / 3600).cast("long").alias("frame"))
    return e.agg(F.avg("value").alias("level"))


_V = "v AS (SELECT label AS recording, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_H = "h AS (SELECT event_type AS recording, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, avg(value) AS level FROM events GROUP BY ALL)"
_SIM = f"{_V}, s AS (SELECT a.recording, a.frame, b.frame - a.frame AS lag, list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) AS sim FROM v a JOIN v b ON a.recording = b.recording AND b.frame - a.frame BETWEEN 1 AND 16)"


@query(f"WITH {_SIM} SELECT recording, frame, lag, {_R('sim')} AS sim FROM s")
def self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.self_similarity(_vectors(spark, sf_dir), "embedding", 16).withColumn("lag", F.col("lag").cast("long")))


@query(f"WITH {_SIM}, k AS (SELECT *, frame - row_number() OVER (PARTITION BY recording, lag ORDER BY frame) AS g FROM s WHERE lag >= 4 AND sim > 0.0) SELECT recording, lag, min(frame) AS start, count(*) AS length FROM k GROUP BY recording, lag, g HAVING count(*) >= 3")
def repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.self_similarity(_vectors(spark, sf_dir), "embedding", 16).withColumn("lag", F.col("lag").cast("long"))
    return st.repeat_runs(s, 0.0, 3, 4)


def _profiles() -> str:
    rows = []
    for order, name, p in circular.key_profiles():
        c = [x - sum(p) / 12 for x in p]
        n = math.sqrt(sum(x * x for x in c))
        rows.append(f"({order}, '{name}', [{', '.join(f'{x / n!r}::DOUBLE' for x in c)}])")
    return ", ".join(rows)


@query(
    f"WITH {_V}, w AS (SELECT unnest([2, 4, 8]) AS width), c AS (SELECT a.recording, CAST(width AS BIGINT) AS width, a.frame, [avg(abs(b.x[1])), "
    + ", ".join(f"avg(abs(b.x[{i}]))" for i in range(2, 13))
    + f"] AS c FROM v a, w JOIN v b ON a.recording = b.recording AND b.frame >= a.frame AND b.frame < a.frame + width GROUP BY ALL HAVING count(*) = width), d AS (SELECT *, [x - list_avg(c) FOR x IN c] AS m FROM c), p(o, key, p) AS (VALUES {_profiles()}), r AS (SELECT recording, width, frame, o, key, list_dot_product(m, p) / sqrt(list_dot_product(m, m)) AS r FROM d, p), t AS (SELECT *, row_number() OVER (PARTITION BY recording, width, frame ORDER BY round(r, 9) DESC, o) AS i FROM r) SELECT recording, width, frame, key, {_R('r')} AS conf FROM t WHERE i = 1"
)
def keyscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.keyscape(_vectors(spark, sf_dir), _chroma(), [2, 4, 8]).withColumn("width", F.col("width").cast("long")))


_ANGLES = [2 * math.pi * (7 * k % 12) / 12 for k in range(12)]
_COS, _SIN = (" + ".join(f"abs(x[{k + 1}]) * {f(a)!r}::DOUBLE" for k, a in enumerate(_ANGLES)) for f in (math.cos, math.sin))


@query(
    f"WITH {_V}, f AS (SELECT recording, frame, {_COS} AS c, {_SIN} AS s, "
    + " + ".join(f"abs(x[{k}])" for k in range(1, 13))
    + f" AS w, abs(x[13]) AS rms FROM v), p AS (SELECT recording, quantile_cont(rms, 0.95) AS p FROM f GROUP BY recording) SELECT recording, frame, {_R('(atan2(s, c) / (2 * pi()) + 1) % 1.0')} AS hue, {_R('least(1.0::DOUBLE, 1.6::DOUBLE * sqrt(c * c + s * s) / w)')} AS saturation, {_R('pow(greatest(0.12::DOUBLE, least(1.0::DOUBLE, rms / greatest(p, 1e-12::DOUBLE))), 0.6::DOUBLE)')} AS value FROM f JOIN p USING (recording)"
)
def harmony_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("rms", F.abs(F.element_at("embedding", 13)))
    return _rounded(st.barcode(v, _chroma(), "rms"))


@query(f"WITH e AS (SELECT event_type AS recording, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, value FROM events), n AS (SELECT recording, greatest((max(i) + 1) // 50, 1) AS step FROM e GROUP BY recording) SELECT recording, i // step AS block, {_R('max(abs(value))')} AS peak FROM e JOIN n USING (recording) WHERE i // step < 50 GROUP BY ALL")
def wave_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    return _rounded(st.envelope(_t(spark, sf_dir, "events").select(F.col("event_type").alias("recording"), i.alias("i"), "value"), "i", "value", 50))


@query(
    f"WITH {_V}, c AS (SELECT recording, frame, x[1:32] AS l, x[33:64] AS r FROM v), d AS (SELECT recording, frame, list_dot_product(l, l) AS ll, list_dot_product(r, r) AS rr, list_dot_product(l, r) AS lr, list_sum(l) AS sl, list_sum(r) AS sr FROM c) SELECT recording, frame, {_R('(ll + rr - 2 * lr) / (2 * (ll + rr))')} AS width, {_R('(32 * lr - sl * sr) / sqrt((32 * ll - sl * sl) * (32 * rr - sr * sr))')} AS correlation FROM d"
)
def stereo_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.stereo(_vectors(spark, sf_dir), F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)))


@query(f"WITH {_V}, b AS (SELECT recording, unnest(range(0, 32)) AS i, unnest(x[1:32]) AS l, unnest(x[33:64]) AS r FROM v) SELECT recording, i * 8 // 32 AS band, {_R('(sum(r * r) - sum(l * l)) / (sum(r * r) + sum(l * l))')} AS pan FROM b GROUP BY ALL")
def pan_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.pan(_vectors(spark, sf_dir), F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), 8))


@query(
    f"WITH {_V}, z AS (SELECT recording, frame, "
    + ", ".join(f"(x[{k}] - avg(x[{k}]) OVER o) / (stddev_pop(x[{k}]) OVER o + 1e-12::DOUBLE) AS f{k}" for k in (1, 2))
    + " FROM v WINDOW o AS (PARTITION BY recording)) SELECT recording, frame, "
    + ", ".join(f"{_R(f'avg(f{k}) OVER n')} AS f{k}" for k in (1, 2))
    + " FROM z WINDOW n AS (PARTITION BY recording ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
)
def timbre_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("recording", "frame", *[F.element_at("embedding", k).alias(f"f{k}") for k in (1, 2)])
    return _rounded(st.trajectory(v, ["f1", "f2"], 2))


@query(f"WITH {_H} SELECT recording, frame, {_R('median(level) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)')} AS smooth FROM h")
def moving_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.moving_median(_hours(spark, sf_dir), "level", 4))


@query(f"WITH {_H}, n AS (SELECT recording, frame, level, lead(frame) OVER w AS f2, lead(level) OVER w AS v2 FROM h WINDOW w AS (PARTITION BY recording ORDER BY frame)), m AS (SELECT *, unnest(range(frame, coalesce(f2, frame + 1))) AS g FROM n) SELECT recording, g AS frame, {_R('level + coalesce(v2 - level, 0) * (g - frame) / coalesce(f2 - frame, 1)')} AS value FROM m")
def interpolated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.interpolated(_hours(spark, sf_dir), "level"))


@query(f"WITH {_V} SELECT recording, frame // 4 AS bucket, {_R('avg(x[1])')} AS f1, {_R('avg(x[2])')} AS f2 FROM v GROUP BY ALL HAVING count(*) = 4")
def pooled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("recording", "frame", *[F.element_at("embedding", k).alias(f"f{k}") for k in (1, 2)])
    return _rounded(st.pooled(v, 4, ["f1", "f2"]))


@query(f"WITH {_H}, p AS (SELECT recording, quantile_cont(level, 0.02) AS lo, quantile_cont(level, 0.98) AS hi FROM h GROUP BY recording) SELECT recording, frame, {_R('greatest(0.0::DOUBLE, least(1.0::DOUBLE, (level - lo) / greatest(hi - lo, 1e-12::DOUBLE)))')} AS amplitude FROM h JOIN p USING (recording)")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.timeline(_hours(spark, sf_dir), "level"))


@query(
    "WITH i AS (SELECT conv_id, turn, role, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations), r AS (SELECT conv_id AS recording, role AS label, min(turn) * 20.0 AS s, (max(turn) + 1) * 20.0 AS e FROM i GROUP BY conv_id, role, g), f AS (SELECT DISTINCT conv_id AS recording, CAST(turn // 3 AS BIGINT) AS file, (turn // 3) * 60.0 AS f0, (turn // 3 + 1) * 60.0 AS f1 FROM conversations)"
    " SELECT recording, file, label, CAST(greatest(s, f0) - f0 AS DOUBLE) AS start, CAST(least(e, f1) - f0 AS DOUBLE) AS \"end\", printf('%02d%02d-%02d%02d %s', CAST(floor(s / 60) AS INT), CAST(s % 60 AS INT), CAST(floor(e / 60) AS INT), CAST(e % 60 AS INT), label) AS name FROM r JOIN f USING (recording) WHERE label <> 'system' AND least(e, f1) - greatest(s, f0) > 0.05"
)
def export_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import segments

    c = _t(spark, sf_dir, "conversations")
    spans = segments.runs(c.select(F.col("conv_id").alias("recording"), F.col("turn").alias("frame"), "role"), F.col("role"))
    spans = spans.select("recording", "label", (F.col("start") * 20.0).alias("start"), (F.col("end") * 20.0).alias("end"))
    files = c.select(F.col("conv_id").alias("recording"), F.floor(F.col("turn") / 3).cast("long").alias("file")).distinct().withColumns({"start": F.col("file") * 60.0, "end": (F.col("file") + 1) * 60.0})
    return st.export_plan(spans, files, ["system"])


@query("WITH k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) SELECT source, doc_id FROM k WHERE i <= 8")
def first_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.first_of_each(_t(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 8)


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') AND abs(value) BETWEEN 1 AND 300 GROUP BY event_type")
def excluded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").filter(~F.col("event_type").isin("view", "click") & F.abs("value").between(1, 300))
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN '—' ELSE printf('%.2f', CAST(quality AS DOUBLE)) END AS shown FROM documents LEFT JOIN labels USING (doc_id)")
def shown_or_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.when(F.col("quality").isNotNull(), F.format_string("%.2f", F.col("quality").cast("double"))), F.lit("—")).alias("shown"))
