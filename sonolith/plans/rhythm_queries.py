"""Queries of the tempo operators, each with its SQL.

Stand-ins: events of a type are the onset envelope of a recording, one frame an hour, two frames counted as a second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rhythm
from .queries import _R, _rounded, query
from .structure_queries import _H, _hours

_WINDOW = 24
_GRAM = (
    f"{_H}, e AS (SELECT recording, frame, greatest(level, 0) AS x FROM h), k AS (SELECT unnest(range(0, {_WINDOW})) AS k),"
    f" w AS (SELECT t.recording, t.frame, k, coalesce(e.x, 0) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / {_WINDOW})) AS x FROM e t CROSS JOIN k LEFT JOIN e ON e.recording = t.recording AND e.frame = t.frame - {_WINDOW // 2} + k),"
    " r AS (SELECT a.recording, a.frame, b.k - a.k AS lag, sum(a.x * b.x) AS r FROM w a JOIN w b ON a.recording = b.recording AND a.frame = b.frame AND b.k >= a.k GROUP BY ALL),"
    " g AS (SELECT recording, frame, lag, CASE WHEN max(abs(r)) OVER o > 1e-20::DOUBLE THEN r / max(abs(r)) OVER o ELSE 0 END AS value FROM r WINDOW o AS (PARTITION BY recording, frame))"
)


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(spark, sf_dir).withColumn("level", F.greatest("level", F.lit(0.0)))


@query(f"WITH {_GRAM} SELECT recording, frame, lag, {_R('value')} AS value FROM g")
def tempogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rhythm.tempogram(_envelope(spark, sf_dir), ["recording"], "frame", "level", _WINDOW))


@query(
    f"WITH {_GRAM}, m AS (SELECT recording, lag, avg(value) AS v FROM g GROUP BY ALL), n AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS c FROM m WINDOW o AS (PARTITION BY recording ORDER BY lag)),"
    " p AS (SELECT *, CASE WHEN a - 2 * v + c < 0 THEN greatest(-0.5::DOUBLE, least(0.5::DOUBLE, (a - c) / (2 * (a - 2 * v + c)))) ELSE 0 END AS off, round(ln(1 + 1e6::DOUBLE * greatest(v, 0)) - 0.5::DOUBLE * pow(log2(120.0::DOUBLE / lag / 120.0::DOUBLE), 2), 9) AS score FROM n WHERE lag > 0 AND 120.0::DOUBLE / lag < 320),"
    f" b AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY score DESC, lag) AS i FROM p) SELECT recording, lag, {_R('120.0::DOUBLE / (lag + coalesce(off, 0))')} AS bpm FROM b WHERE i = 1"
)
def tempo_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = rhythm.lag_means(_envelope(spark, sf_dir), ["recording"], "frame", "level", _WINDOW)
    return _rounded(rhythm.tempo(means.withColumn("rate", F.lit(2.0)), ["recording"]))
