"""One query for each operator of this subpackage, with production parameters, over its whole table; and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest, quality, toxicity
from .ann import nearest
from .common import lower_ascii, read, split_words
from .decontam import decontaminate
from .html_extract import extract_main_text
from .licenses import RULES, SENTENCES, detect_licenses
from .line_dedup import drop_duplicate_lines
from .mixing import mix
from .ngram_join import similar_groups
from .periodic_runs import SPACES, periodic_runs
from .suffix_dedup import remove_repeats
from .warc import archive_folder, base32, read_archive, write_pages


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10, gram=5)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), weights=[1, 2, 3], most=3).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_duplicate_lines(read(spark, sf_dir, "documents"), k=20, least=0.75, min_words=1, exact=True)
    return out.select("doc_id", "text", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"), depth=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents"), width=5, num=3, den=4)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark, f"warc-{uuid.uuid4().hex}")
    write_pages(read(spark, sf_dir, "pages"), folder, least_bytes=0)
    back = read_archive(spark, folder, partition_bytes=8 << 20)
    full = F.col("record_type") == "response"
    # responses are digested anew from what was read, revisits have no payload of their own
    sha = F.when(full, F.unhex(F.sha1("payload")))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return back.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(base32(sha), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), max_train=20_000)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_licenses(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_known", F.size("matches").cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"), F.array_join(F.transform("matches", lambda m: m["rule"]), ",").alias("rules"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"), support=0.8, least=3)


def _checksum(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document in ten by the checksum of its doc_id turns periodic from a word on, as the contract of the query says."""
    words = split_words(F.coalesce("text", F.lit("")), SPACES.removesuffix("+"))
    h = _checksum()
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).otherwise(F.array().cast("array<string>")).alias("words"))
    d = d.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rest = F.col("n") - F.col("a")
    d = d.withColumn("p", F.lit(1) + F.floor(rest / (F.lit(3) + F.col("g") % 8)))
    one = F.slice("words", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    again = F.slice(F.flatten(F.array_repeat(one, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest.cast("int"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), again), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_periods(read(spark, sf_dir, "documents")), shortest=6, times=4)
    above = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    first = F.aggregate("runs", F.col("runs")[0], lambda best, r: F.when(above(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumn("best", F.when(F.size("runs") > 0, first))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}") for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), max_train=20_000)
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = manifest.leaf([*map(F.col, fields[:-1]), F.when(F.col("text").isNotNull(), lower_ascii(F.col("text")))])
    docs = read(spark, sf_dir, "documents").select(*fields, F.when(_checksum() % 3 == 0, tampered).alias("seen"))
    out = manifest.manifest(docs, fields, group="lang", order="doc_id", keep=["doc_id", "seen"])
    folded = manifest.fold(F.coalesce("seen", "leaf"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_line_dedup, op3_nearest, op4_repeated_bytes, op5_jaccard_groups, op6_warc_round_trip, op7_mix_sources, op8_toxicity, op9_licenses, op10_main_text, op11_periodic_runs, op12_quality, op13_manifest)}


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1_SQL = rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_at AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, CAST(greatest(len(w), 10) - 8 AS BIGINT))) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM item_at WHERE i + n - 1 <= len(w)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
doc_at AS (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM doc, sizes WHERE len(w) >= n),
cand AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM doc_at),
hit AS (SELECT DISTINCT r, i, c.n, item_id FROM cand c JOIN win USING (n, s)),
at_word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
by_item AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN at_word USING (r) LEFT JOIN by_item USING (r)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY hex(encode(source)) ASC NULLS LAST) - 1) % 3 AS weight FROM s),
c AS (SELECT *, sum(3 * source_size) OVER o AS held, sum(weight) OVER o AS shut FROM w WINDOW o AS (ORDER BY 3.0 * source_size / weight, source_size, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(source_size) AS words, sum(weight) AS weights FROM w),
levels AS (
  SELECT CAST(words AS DOUBLE) / CAST(weights AS DOUBLE) AS level, 0 AS held, 0 AS shut FROM t WHERE weights > 0
  UNION ALL SELECT CAST(words - held AS DOUBLE) / CAST(weights - shut AS DOUBLE), held, shut FROM c, t WHERE weights > shut),
best AS (SELECT max(level) AS level FROM levels WHERE held + level * ((SELECT weights FROM t) - shut) <= (SELECT words FROM t) * 1.000001 AND NOT EXISTS (SELECT 1 FROM c WHERE c.shut > levels.shut AND 3.0 * source_size / weight < level * 0.999999999) AND NOT EXISTS (SELECT 1 FROM c WHERE c.shut <= levels.shut AND 3.0 * source_size / weight > level * 1.000000001)),
g AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, level * CAST(weight AS DOUBLE)) AS target FROM w, best),
j AS (SELECT doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NORM = r"trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
OP9_SQL = rf"""
WITH known(sid, s) AS (VALUES {", ".join(f"({k}, {_quoted(v)})" for k, v in SENTENCES.items())}),
norms AS (SELECT sid, {_NORM.format("s")} AS norm FROM known),
rules(rule, license, ids) AS (VALUES {", ".join(f"({_quoted(r)}, {_quoted(l)}, {ids})" for r, l, ids in RULES)}),
doc AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.;:!?])\s+', '\1' || chr(10), 'g'), '\n+') AS parts FROM documents),
part AS (SELECT r, generate_subscripts(parts, 1) AS pos, unnest(parts) AS s FROM doc),
seen AS (SELECT r, pos, sid, row_number() OVER (PARTITION BY r ORDER BY pos) AS i FROM part JOIN norms ON norm = {_NORM.format("part.s")}),
steps AS (SELECT a.r, rule, license, ids, len(ids) AS n, a.i, a.pos AS first FROM seen a JOIN rules ON a.sid = ids[1]),
own AS (SELECT s.r, rule, license, first, max(b.pos) AS last FROM steps s JOIN seen b ON s.r = b.r AND b.i BETWEEN s.i AND s.i + n - 1 LEFT JOIN seen p ON p.r = b.r AND p.i = b.i - 1 AND b.i > s.i
  GROUP BY s.r, rule, license, first, n, s.i HAVING count(*) = any_value(n) AND bool_and(b.sid = ids[b.i - s.i + 1]) AND coalesce(max(b.pos - p.pos - 1), 0) <= 2),
kept AS (SELECT * FROM (SELECT *, max(last) OVER (PARTITION BY r ORDER BY first, last DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM own) WHERE reach IS NULL OR last > reach),
res AS (SELECT r, count(*) AS n_matches, string_agg(rule, ',' ORDER BY first, last, rule) AS rules FROM kept GROUP BY r),
lic AS (SELECT r, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT DISTINCT r, license FROM kept) GROUP BY r),
cnt AS (SELECT r, count(*) AS n_known FROM seen GROUP BY r)
SELECT doc_id, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, coalesce(licenses, '') AS licenses, coalesce(rules, '') AS rules
FROM doc LEFT JOIN cnt USING (r) LEFT JOIN res USING (r) LEFT JOIN lic USING (r)
"""


OP6_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS sha, rpad(sha1(body), 40, '0') AS h FROM p),
f AS (SELECT sha, min(page_id) AS first FROM d GROUP BY sha),
q AS (SELECT page_id, payload_bytes, h, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d JOIN f USING (sha)),
b AS (SELECT *, [CAST('0x' || substr(h, CAST(g * 10 + 1 AS BIGINT), 10) AS BIGINT) FOR g IN range(0, 4)] AS parts FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[CAST(i // 8 + 1 AS BIGINT)] >> CAST(5 * (7 - i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM b
"""


#: The unsigned CRC-32 of a doc_id's decimal digits, bit by bit; null for null.
_CRC = r"""CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: [CAST(ord(CAST(doc_id AS VARCHAR)[k]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) END"""

OP11_SQL = rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents),
cut AS (SELECT r, doc_id, w0, h, len(w0) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM base),
per AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
doc AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_concat(w0[:a], list_transform(range(0, n - a), lambda k: w0[a + k % p + 1])) END AS w FROM per),
word AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS s FROM doc),
pair AS (SELECT x.r, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.r = y.r AND x.s = y.s AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair),
span AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM isle GROUP BY r, q, k),
run AS (SELECT r, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(min(q) AS BIGINT) AS period FROM span WHERE length >= 6 AND length >= 4 * q GROUP BY r, start, length),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / CAST(period AS DOUBLE) DESC, start, period) = 1),
told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(s, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM doc LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Levels that each of the two trees is raised: more than any table needs, as a lone node stays what it is.
_RAISED = 10


def _tree_sql(name: str, key: str) -> str:
    """Tables {name}0 (key, i, d) raised: {name}k by level, each node a run of eight of the one below; a key's lone node stays."""
    return ",\n".join(
        f"""{name}{k + 1} AS (SELECT {key}, i // 8 AS i, CASE WHEN any_value(c) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS c FROM {name}{k}) GROUP BY {key}, i // 8)"""
        for k in range(_RAISED)
    )


def _sides_sql(name: str, key: str, rows: str) -> str:
    """For each node of {name}0 the joined digests on its left and right by level, as lists l and r with '' where it is alone in its key."""
    parts = ",\n".join(
        f"""{name}s{k} AS (SELECT {key}, i, coalesce(string_agg(d, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY {key}) > 1 AS up FROM {name}{k})"""
        for k in range(_RAISED)
    )
    joins = " ".join(f"JOIN {name}s{k} t{k} ON t{k}.{key} = x.{key} AND t{k}.i = x.i // {8**k}" for k in range(_RAISED))
    steps = ", ".join(f"{{'l': t{k}.l, 'r': t{k}.r, 'up': t{k}.up}}" for k in range(_RAISED))
    return f"{parts},\n{rows} AS (SELECT x.{key}, x.i, [{steps}] AS steps FROM {name}0 x {joins})"


OP13_SQL = f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf_sql("text")} AS leaf,
  CASE WHEN ({_CRC}) % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS seen FROM documents),
docs AS (SELECT *, dense_rank() OVER (ORDER BY hex(encode(lang)) NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM base),
a0 AS (SELECT g, i, leaf AS d FROM docs),
{_tree_sql("a", "g")},
b0 AS (SELECT 0 AS z, g AS i, d FROM a{_RAISED}),
{_tree_sql("b", "z")},
{_sides_sql("a", "g", "apath")},
{_sides_sql("b", "z", "bpath")},
full_path AS (SELECT doc_id, leaf, seen, a{_RAISED}.d AS subroot, b{_RAISED}.d AS root, list_filter(list_concat(apath.steps, bpath.steps), lambda s: s.up) AS steps
  FROM docs JOIN apath ON apath.g = docs.g AND apath.i = docs.i JOIN bpath ON bpath.i = docs.g JOIN a{_RAISED} ON a{_RAISED}.g = docs.g CROSS JOIN b{_RAISED})
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) AS proof_sha256,
  list_reduce(list_concat([coalesce(seen, leaf)], list_transform(steps, lambda s: s.l || '|' || s.r)), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root,
  folded_root = root AS verified
FROM full_path
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op6_warc_round_trip": OP6_SQL, "op7_mix_sources": OP7_SQL, "op9_licenses": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op13_manifest": OP13_SQL}
