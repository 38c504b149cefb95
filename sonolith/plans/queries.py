"""The registered queries over the driver's tables, each with its SQL.

Stand-ins: embeddings are tracks (album = label), part and lineitem large feature tables (album = brand), events frames of
recordings (one recording per event type, one frame an hour), conversations ordered labels, pages paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import circular, naming
from ..operators import corpus, segments
from ..operators.clustering import kmeans_sweep, pca

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _chroma(column: str = "embedding") -> list[Column]:
    return [F.abs(F.element_at(column, i + 1).cast("double")) for i in range(12)]


_R = lambda x, n=6: f"round(CAST({x} AS DOUBLE), {n})"
_STATS = ["p_size", "p_retailprice"]


@query("SELECT p_brand, count(*) AS n_tracks, " + ", ".join(f"{_R(f'{f}(CAST({c} AS DOUBLE))')} AS {c}_{n}" for c in _STATS for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM part GROUP BY p_brand")
def album_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(corpus.album_stats(_t(spark, sf_dir, "part").withColumns({c: F.col(c).cast("double") for c in _STATS}), "p_brand", _STATS))


@query("SELECT l_returnflag, count(*) AS n_tracks, " + ", ".join(f"{_R(f'{f}({c})')} AS {c}_{n}" for c in ("l_quantity", "l_discount") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM lineitem GROUP BY l_returnflag")
def album_stats_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(corpus.album_stats(_t(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"]))


@query(f"SELECT p_brand, p_type, CAST(grouping(p_brand, p_type) AS BIGINT) AS level, count(*) AS n, {_R('sum(p_retailprice)', 2)} AS total FROM part GROUP BY ROLLUP (p_brand, p_type)")
def collection_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.collection_rollup(_t(spark, sf_dir, "part"), ["p_brand", "p_type"], [F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total")])


@query("SELECT source, first_at, CAST(row_number() OVER (ORDER BY first_at) AS INTEGER) AS place FROM (SELECT source, min(doc_id) AS first_at FROM documents GROUP BY source)")
def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_appearance(_t(spark, sf_dir, "documents"), "source", "doc_id")


@query(f"SELECT p_partkey, {_R('(ln(1 + p_size) - m1) / (s1 + 1e-12)')} AS z_p_size, {_R('(p_retailprice - m2) / (s2 + 1e-12)')} AS z_p_retailprice FROM part, (SELECT avg(ln(1 + p_size)) AS m1, stddev_pop(ln(1 + p_size)) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part)")
def zscore_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(corpus.zscore(_t(spark, sf_dir, "part"), _STATS, ["p_size"]).select("p_partkey", "z_p_size", "z_p_retailprice"))


@query(f"SELECT o_orderpriority, {_R('avg(CASE WHEN o_orderstatus = %s THEN 1.0 ELSE 0.0 END)' % chr(39).join(['', 'F', '']))} AS minor_share FROM orders GROUP BY o_orderpriority")
def conditional_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(corpus.conditional_share(_t(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", "minor_share"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, (SELECT p_name FROM part ORDER BY {c} DESC, p_partkey LIMIT 1) AS largest, (SELECT p_name FROM part ORDER BY {c}, p_partkey LIMIT 1) AS smallest" for c in _STATS))
def extremes_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.extremes(_t(spark, sf_dir, "part"), _STATS, "p_partkey", F.col("p_name"))


_UNIT = "u AS (SELECT vec_id, label, [CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) * CAST(y AS DOUBLE) FOR y IN embedding])) FOR x IN embedding] AS v FROM embeddings)"
_DOT = "list_sum([a.v[i] * b.v[i] FOR i IN range(1, 65)])"


@query(f"WITH {_UNIT} SELECT a.vec_id AS i, b.vec_id AS j, {_R(_DOT)} AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id")
def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return _rounded(corpus.pair_cosine(e, "vec_id", "embedding", e))


@query(f"WITH {_UNIT} SELECT a.label AS album_a, b.label AS album_b, {_R(f'coalesce(avg({_DOT}) FILTER (WHERE a.vec_id <> b.vec_id), 1.0)')} AS affinity FROM u a, u b GROUP BY ALL")
def album_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(corpus.album_affinity(_t(spark, sf_dir, "embeddings"), "label", "embedding"))


@query(f"WITH m AS (SELECT label, i - 1 AS d, avg(CAST(embedding[i] AS DOUBLE)) AS z FROM embeddings, (SELECT unnest(range(1, 11)) AS i) GROUP BY ALL), r AS (SELECT label, 'f' || d AS feature, z, row_number() OVER (PARTITION BY label ORDER BY abs(round(z, 9)) DESC, 'f' || d) AS rank FROM m) SELECT label, feature, {_R('z')} AS zmean, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def topk_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(corpus.top_signature(_t(spark, sf_dir, "embeddings"), "label", {f"f{i}": F.element_at("embedding", i + 1).cast("double") for i in range(10)}))


_SIL = "sqrt(list_sum([(CAST(a.embedding[i] - b.embedding[i] AS DOUBLE)) * CAST(a.embedding[i] - b.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]))"


@query(f"WITH d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, avg({_SIL}) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL), s AS (SELECT i, max(d) FILTER (WHERE li = lj) AS own, min(d) FILTER (WHERE li <> lj) AS other FROM d GROUP BY i) SELECT {_R('coalesce(avg((other - own) / greatest(own, other, 1e-12)), 0.0)')} AS silhouette, count(*) AS n FROM s WHERE own IS NOT NULL AND other IS NOT NULL")
def silhouette_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(corpus.silhouette(_t(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"))


@query(f"SELECT event_type, {_R('quantile_cont(value, 0.95) - quantile_cont(value, 0.10)')} AS dyn_range FROM events GROUP BY event_type")
def dyn_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_t(spark, sf_dir, "events").groupBy("event_type").agg((F.percentile("value", 0.95) - F.percentile("value", 0.10)).alias("dyn_range")))


@query(f"WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n) SELECT user_id, {_R('sum(-p * log2(p + 1e-12))')} AS entropy FROM p GROUP BY user_id")
def event_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(corpus.entropy(_t(spark, sf_dir, "events"), "user_id", "event_type"))


@query(f"WITH t AS (SELECT event_type, sum(value) AS seconds FROM events GROUP BY event_type) SELECT event_type, {_R('seconds', 3)} AS seconds, {_R('seconds / sum(seconds) OVER ()')} AS share FROM t")
def tally_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus.tally_share(_t(spark, sf_dir, "events"), "event_type", F.col("value"))
    return t.select("event_type", F.round("seconds", 3).alias("seconds"), F.round("share", 6).alias("share"))


_ANGLE = "2 * pi() * ((7 * (i - 1)) % 12) / 12"
_CHROMA = "c AS (SELECT vec_id, label, i, abs(CAST(embedding[i] AS DOUBLE)) AS w FROM embeddings, (SELECT unnest(range(1, 13)) AS i))"
_CENTRE = f"f AS (SELECT vec_id, label, sum(w * cos({_ANGLE})) AS x, sum(w * sin({_ANGLE})) AS y, sum(w) AS w FROM c GROUP BY ALL)"
_NOTES = "['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']"


@query(f"WITH {_CHROMA}, {_CENTRE} SELECT vec_id, {_NOTES}[CAST(((7 * CAST(round_even(atan2(y, x) * 12 / (2 * pi()), 0) AS INTEGER)) % 12 + 12) % 12 AS INTEGER) + 1] AS center, {_R('sqrt(x * x + y * y) / w')} AS R FROM f")
def fifths_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle, r = circular.fifths(_chroma())
    return _rounded(_t(spark, sf_dir, "embeddings").select("vec_id", circular.fifths_note(angle).alias("center"), r.alias("R")))


@query(f"WITH {_CHROMA}, {_CENTRE}, g AS (SELECT label AS album, count(*) AS n, sqrt(pow(sum(cos(atan2(y, x))), 2) + pow(sum(sin(atan2(y, x))), 2)) / count(*) AS R FROM f GROUP BY label) SELECT album, {_R('R')} AS R, {_R('sqrt(-2 * ln(greatest(R, 1e-12))) * 12 / (2 * pi())')} AS sd_fifths, n FROM g")
def tonal_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(circular.tonal_spread(_t(spark, sf_dir, "embeddings"), "label", _chroma()))


_PROFILES = ", ".join(f"({o}, '{n}', {p})" for o, n, p in circular.key_profiles())


@query(f"WITH {_CHROMA}, k(o, name, p) AS (VALUES {_PROFILES}), r AS (SELECT vec_id, o, name, corr(w, CAST(p[i] AS DOUBLE)) AS r FROM c, k GROUP BY ALL) SELECT vec_id, arg_max(name, {{'r': round(r, 9), 'o': -o}}) AS key, {_R('max(r)')} AS conf FROM r GROUP BY vec_id")
def key_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(circular.key_estimate(_t(spark, sf_dir, "embeddings"), _chroma(), ["vec_id"]))


@query(f"WITH w AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS win, event_type, count(*) AS n FROM events GROUP BY ALL), v AS (SELECT user_id, win, event_type FROM w QUALIFY row_number() OVER (PARTITION BY user_id, win ORDER BY n DESC, event_type) = 1), m AS (SELECT user_id, event_type, count(*) AS n, min(win) AS first, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM v GROUP BY user_id, event_type) SELECT user_id, event_type AS modal, CASE WHEN t > 1 THEN {_R('n / t', 3)} END AS agreement, CAST(t AS BIGINT) AS n_windows FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1")
def key_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stability import windowed_vote

    return windowed_vote(_t(spark, sf_dir, "events"), "user_id", _seconds(), "event_type", 86400.0)


@query(f"WITH w AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS win, avg(value) AS tempo FROM events GROUP BY ALL), m AS (SELECT *, median(tempo) OVER (PARTITION BY user_id) AS med FROM w), f AS (SELECT user_id, CASE WHEN tempo < med / 1.5 THEN tempo * 2 WHEN tempo > med * 1.5 THEN tempo / 2 ELSE tempo END AS t FROM m), g AS (SELECT *, median(t) OVER (PARTITION BY user_id) AS tm FROM f) SELECT user_id, {_R('any_value(tm)')} AS tempo, CASE WHEN count(*) > 1 THEN {_R('avg(CASE WHEN abs(t - tm) / greatest(tm, 1e-9) < 0.02 THEN 1.0 ELSE 0.0 END)', 3)} END AS agreement, count(*) AS n_windows FROM g GROUP BY user_id")
def tempo_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stability import folded_tempo

    t = _t(spark, sf_dir, "events").groupBy("user_id", F.floor(_seconds() / 86400).alias("win")).agg(F.avg("value").alias("tempo"))
    # a median halfway between two roundings goes up, whatever the order of its sums
    return _rounded(folded_tempo(t, "user_id", "tempo").withColumn("tempo", F.round("tempo", 10)))


@query(f"WITH p AS (SELECT event_type, period, sum(abs(value) * cos(2 * pi() * epoch(ts) / period)) AS c, sum(abs(value) * sin(2 * pi() * epoch(ts) / period)) AS s, sum(abs(value)) AS w FROM events, (VALUES (43200.0::DOUBLE), (86400.0::DOUBLE), (172800.0::DOUBLE)) v(period) GROUP BY ALL) SELECT event_type, period, {_R('sqrt(c * c + s * s) / w')} AS R FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(sqrt(c * c + s * s) / w, 9) DESC, period) = 1")
def pulse_resultant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stability import pulse

    return _rounded(pulse(_t(spark, sf_dir, "events"), "event_type", _seconds(), F.abs("value"), [43200.0, 86400.0, 172800.0]).select(F.col("recording").alias("event_type"), "period", "R"))


_FRAMES = "fr AS (SELECT event_type AS recording, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, 20 * log10(avg(abs(value)) + 1e-12) AS level, avg(log10(abs(value) + 1e-12)) AS flat, coalesce(stddev_pop(log10(abs(value) + 1e-12)), 0) AS variability, count(*) AS n FROM events GROUP BY ALL)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.log10(F.abs("value") + 1e-12)
    return segments.pool(_t(spark, sf_dir, "events"), "event_type", _seconds(), 3600.0, [(20 * F.log10(F.avg(F.abs("value")) + 1e-12)).alias("level"), F.avg(v).alias("flat"), F.stddev_pop(v).alias("variability"), F.count("*").alias("n")])


@query(f"WITH {_FRAMES} SELECT recording, frame, {_R('level')} AS level, {_R('flat')} AS flat, {_R('variability')} AS variability, n FROM fr")
def pool_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_frames(spark, sf_dir))


# Prices are whole cents, so the bins of the histogram fall alike on every engine.
_OTSU = """r AS (SELECT recording, min(v) AS lo, max(v) AS hi FROM x GROUP BY recording), h AS (SELECT recording, lo, hi, CAST(least(floor((v - lo) / ((hi - lo) / 128)), 127) AS BIGINT) AS bin, count(*) AS n FROM x JOIN r USING (recording) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER u AS w0, sum(n * bin) OVER u AS s0, sum(n) OVER p AS w, sum(n * bin) OVER p AS s FROM h WINDOW u AS (PARTITION BY recording ORDER BY bin), p AS (PARTITION BY recording)),
m AS (SELECT *, CAST(s0 AS DOUBLE) / CAST(w0 AS DOUBLE) AS m0, CASE WHEN w > w0 THEN CAST(s - s0 AS DOUBLE) / CAST(w - w0 AS DOUBLE) ELSE 0 END AS m1 FROM c),
b AS (SELECT *, CASE WHEN w > w0 THEN CAST(w0 AS DOUBLE) * CAST(w - w0 AS DOUBLE) * (m0 - m1) * (m0 - m1) ELSE 0 END AS between FROM m),
o AS (SELECT recording, lo + (bin + 1) * ((hi - lo) / 128) AS threshold, lo + (m0 + 0.5) * ((hi - lo) / 128) AS mean_low, lo + (m1 + 0.5) * ((hi - lo) / 128) AS mean_high, CAST(w0 AS DOUBLE) / CAST(w AS DOUBLE) AS share_low FROM b QUALIFY row_number() OVER (PARTITION BY recording ORDER BY round(between, 6) DESC, bin) = 1)"""


@query(f"WITH x AS (SELECT l_returnflag AS recording, l_extendedprice AS v FROM lineitem), {_OTSU} SELECT recording, {_R('threshold')} AS threshold, {_R('mean_low')} AS mean_low, {_R('mean_high')} AS mean_high, {_R('share_low')} AS share_low FROM o")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(segments.otsu(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"))


_MASK = f"{_FRAMES}, x AS (SELECT recording, flat AS v FROM fr), {_OTSU}, q AS (SELECT recording, quantile_cont(level, 0.95) AS p95 FROM fr GROUP BY recording), mask AS (SELECT fr.*, level > p95 - 15 AND (mean_high - mean_low < 0.7 OR least(share_low, 1 - share_low) < 0.05 OR flat < threshold) AS is_music FROM fr JOIN o USING (recording) JOIN q USING (recording))"


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.music_mask(_frames(spark, sf_dir), "level", "flat")


@query(f"WITH {_MASK} SELECT recording, frame, is_music FROM mask")
def music_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask(spark, sf_dir).select("recording", "frame", "is_music")


_RUNS = "SELECT recording, frame, {label} AS label, frame - row_number() OVER (PARTITION BY recording, {label} ORDER BY frame) AS g FROM {src}"


@query(f"WITH {_MASK}, i AS ({_RUNS.format(label='is_music', src='mask')}) SELECT recording, label, min(frame) AS start, max(frame) + 1 AS end FROM i GROUP BY recording, label, g")
def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.runs(_mask(spark, sf_dir), F.col("is_music"))


_SPANS = f"{_MASK}, t AS (SELECT recording, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY recording ORDER BY frame) < 3 + 1 THEN 0 ELSE 1 END AS new FROM mask WHERE is_music), g AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY frame) AS g FROM t), spans AS (SELECT recording, min(frame) AS start, max(frame) + 1 AS end FROM g GROUP BY recording, g HAVING max(frame) + 1 - min(frame) >= 4)"


@query(f"WITH {_SPANS} SELECT recording, start, \"end\" FROM spans")
def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(_mask(spark, sf_dir), 3, 4).select("recording", "start", "end")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.classify(_mask(spark, sf_dir), "level", "flat", "variability", music_flat=1.2, applause_flat=1.6)


_LABELS = f"{_MASK}, lab AS (SELECT recording, frame, CASE WHEN is_music AND flat < 1.2 THEN 'music' WHEN level <= p95 - 12 THEN 'quiet' WHEN variability >= 0.40 THEN 'voices' WHEN flat >= 1.6 THEN 'applause' ELSE 'other' END AS label FROM mask JOIN q USING (recording))"


@query(f"WITH {_LABELS} SELECT * FROM lab")
def classify_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("recording", "frame", "label")


@query(f"WITH {_LABELS}, i AS ({_RUNS.format(label='label', src='lab')}) SELECT recording, label, min(frame) AS start, max(frame) + 1 AS end FROM i GROUP BY recording, label, g")
def region_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.runs(_labels(spark, sf_dir), F.col("label"))


@query()
def absorb_flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.regions(_labels(spark, sf_dir), 3)


_SONGS = "s AS (SELECT event_type AS recording, CAST(floor(epoch(min(ts)) / 3600) AS BIGINT) + 24 AS start, CAST(floor(epoch(min(ts)) / 3600) AS BIGINT) + 72 AS end FROM events GROUP BY event_type)"


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.floor(F.min(_seconds()) / 3600).cast("long")
    return _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("recording")).agg((first + 24).alias("start"), (first + 72).alias("end"))


@query(f"WITH {_LABELS}, {_SONGS} SELECT recording, frame, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.recording = lab.recording AND frame >= s.start AND frame < s.end) THEN 'music' WHEN label = 'music' THEN 'other' ELSE label END AS label FROM lab")
def paint_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.paint(_labels(spark, sf_dir), _songs(spark, sf_dir))


@query(f"WITH {_SPANS}, p AS (SELECT recording, day AS part_id, day * 24 AS start, day * 24 + 24 AS end FROM (SELECT DISTINCT event_type AS recording, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events)) SELECT spans.recording, spans.start AS span_id, part_id, greatest(spans.start, p.start) AS start, least(spans.end, p.end) AS end FROM spans JOIN p ON spans.recording = p.recording AND greatest(spans.start, p.start) < least(spans.end, p.end)")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = segments.segments(_mask(spark, sf_dir), 3, 4).withColumn("span_id", F.col("start"))
    days = _t(spark, sf_dir, "events").select(F.col("event_type").alias("recording"), F.floor(_seconds() / 86400).cast("long").alias("part_id")).distinct()
    return segments.overlap(spans, days.withColumns({"start": F.col("part_id") * 24, "end": F.col("part_id") * 24 + 24}), 48.0)


_FILES = "files AS (SELECT event_type AS session, day AS file_idx, 24.0::DOUBLE AS duration FROM (SELECT DISTINCT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events)), sp AS (SELECT recording AS session, frame // 24 AS file_idx, frame FROM mask WHERE is_music), tt AS (SELECT *, CASE WHEN frame - lag(frame) OVER w < 3 + 1 THEN 0 ELSE 1 END AS new FROM sp WINDOW w AS (PARTITION BY session, file_idx ORDER BY frame)), gg AS (SELECT *, sum(new) OVER (PARTITION BY session, file_idx ORDER BY frame) AS g FROM tt), own AS (SELECT session, file_idx, min(frame) - file_idx * 24 AS start, max(frame) + 1 - file_idx * 24 AS end FROM gg GROUP BY session, file_idx, g), nn AS (SELECT f.*, o.start, o.end, row_number() OVER (PARTITION BY f.session, f.file_idx ORDER BY o.start) AS i, row_number() OVER (PARTITION BY f.session, f.file_idx ORDER BY o.start DESC) = 1 AS last FROM files f LEFT JOIN own o USING (session, file_idx)), ll AS (SELECT *, last AND start IS NOT NULL AND duration - \"end\" <= 5 AS open FROM nn), kk AS (SELECT *, CASE WHEN i = 1 AND start IS NOT NULL AND start <= 5 AND coalesce(lag(open) OVER w, false) AND lag(file_idx) OVER w = file_idx - 1 THEN 0 ELSE 1 END AS new FROM ll WINDOW w AS (PARTITION BY session ORDER BY file_idx, i)), hh AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY file_idx, i) AS song FROM kk)"


@query(f"WITH {_MASK}, {_FILES} SELECT session, CAST(sum(\"end\" - start) AS BIGINT) AS duration, count(*) AS n_parts, min(file_idx) AS first_file, CAST(row_number() OVER (PARTITION BY session ORDER BY min(file_idx * 24 + start)) AS INTEGER) AS index FROM hh WHERE start IS NOT NULL GROUP BY session, song HAVING sum(\"end\" - start) >= 6")
def cross_file_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(_seconds() / 86400).cast("long")
    files = _t(spark, sf_dir, "events").select(F.col("event_type").alias("session"), day.alias("file_idx")).distinct()
    files = files.withColumns({"file": F.concat_ws("/", "session", "file_idx"), "duration": F.lit(24.0)})
    mask = _mask(spark, sf_dir).withColumn("file", F.concat_ws("/", "recording", F.floor(F.col("frame") / 24).cast("long")))
    own = segments.segments(mask.select(F.col("file").alias("recording"), (F.col("frame") % 24).alias("frame"), "is_music"), 3, 0)
    songs = segments.join_across(own.select(F.col("recording").alias("file"), "start", "end"), files, 5.0, 6.0)
    return songs.select("session", F.col("duration").cast("long").alias("duration"), F.size("parts").cast("long").alias("n_parts"), F.element_at("parts", 1)["file_idx"].alias("first_file"), "index")


@query("WITH i AS (SELECT conv_id, turn, role, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations) SELECT conv_id AS recording, role AS label, min(turn) AS start, max(turn) + 1 AS end FROM i GROUP BY conv_id, role, g")
def label_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.runs(_t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording"), F.col("turn").alias("frame"), "role"), F.col("role"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' ELSE CASE WHEN quality = 0 THEN 'poor' END END, '') AS note FROM documents LEFT JOIN labels USING (doc_id)")
def notes_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.coalesce(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"), F.lit(""))
    return _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", note.alias("note"))


@query(f"WITH i AS (SELECT user_id, event_id, epoch(lead(ts) OVER w) - epoch(ts) AS ioi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT * FROM i WHERE ioi > 60 AND ioi < 86400), p AS (SELECT user_id, event_id, ioi, lead(ioi) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM k) SELECT user_id, event_id, {_R('ioi', 3)} AS ioi, {_R('next', 3)} AS next_ioi FROM p WHERE next IS NOT NULL")
def ioi_poincare(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    i = _t(spark, sf_dir, "events").withColumn("_s", _seconds()).withColumn("ioi", F.lead("_s").over(w) - F.col("_s")).filter((F.col("ioi") > 60) & (F.col("ioi") < 86400))
    p = i.withColumn("next_ioi", F.lead("ioi").over(Window.partitionBy("user_id").orderBy("event_id"))).filter("next_ioi is not null")
    return p.select("user_id", "event_id", F.round("ioi", 3).alias("ioi"), F.round("next_ioi", 3).alias("next_ioi"))


@query(f"SELECT event_id, {_R('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS smooth FROM events")
def moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return _t(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("smooth"))


@query(f"WITH w AS (SELECT event_type, value, CAST(floor(epoch(ts) / 3600) AS BIGINT) - k AS win FROM events, (SELECT unnest(range(0, 4)) AS k)) SELECT event_type, win, {_R('avg(value)')} AS energy, count(*) AS n FROM w GROUP BY ALL")
def sliding_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "4 hours", "1 hour"), "event_type").agg(F.avg("value").alias("energy"), F.count("*").alias("n"))
    return e.select("event_type", F.floor(F.unix_seconds("window.start") / 3600).cast("long").alias("win"), F.round("energy", 6).alias("energy"), "n")


@query(f"WITH b AS (SELECT event_type, CAST(hour(ts) AS BIGINT) AS bin, sum(abs(value)) AS w FROM events GROUP BY ALL) SELECT event_type, bin, {_R('w / max(w) OVER (PARTITION BY event_type)')} AS height FROM b")
def phase_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _t(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").cast("long").alias("bin")).agg(F.sum(F.abs("value")).alias("w"))
    return b.select("event_type", "bin", F.round(F.col("w") / F.max("w").over(Window.partitionBy("event_type")), 6).alias("height"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS title, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS ext, coalesce(nullif(regexp_replace(replace(regexp_extract(url, '://(.*)/[^/]*$', 1), '/', '_'), '^\.+', ''), ''), 'collection') AS album FROM pages")
def stem_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", naming.stem(url).alias("title"), naming.extension(url).alias("ext"), naming.album_stem(F.regexp_extract(url, r"://(.*)/[^/]*$", 1)).alias("album"))


@query("SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bound FROM events UNION SELECT user_id, 0 FROM events UNION SELECT user_id, CAST(floor(epoch(max(ts)) / 3600) AS BIGINT) + 1 FROM events GROUP BY user_id")
def bounds_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", F.floor(_seconds() / 3600).cast("long").alias("bound"))
    ends = e.groupBy("user_id").agg((F.max("bound") + 1).alias("bound"))
    return e.unionByName(e.select("user_id", F.lit(0).cast("long").alias("bound"))).unionByName(ends).distinct()


@query("SELECT doc_id, CASE WHEN n_chars IS NULL THEN '—' WHEN n_chars / 20000.0 >= 0.75 THEN 'strong' WHEN n_chars / 20000.0 >= 0.5 THEN 'fair' ELSE 'weak' END AS band FROM documents")
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", naming.confidence(F.col("n_chars") / 20000.0).alias("band"))


@query()
def pca_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(10)])
    return pca(e, [f"f{i}" for i in range(10)], keep=["vec_id"])[0]


@query()
def kmeans_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(10)])
    return kmeans_sweep(e, "vec_id", [f"f{i}" for i in range(10)])
