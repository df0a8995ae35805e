"""The operators over the given tables, with their contract's columns and SQL where SQL can say it."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import (
    centroids,
    html_main,
    jaccard_join,
    licenses,
    masked_lm,
    mixing,
    pii,
    pivots,
    quality,
    sentencepiece_bpe,
    topk,
    url_filter,
    vector_codes,
)
from tidemark.llm.common import stored, table
from tidemark.llm.vectors import WIDEST, long_sum

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query(
    "op1_url_filter",
    rf"""
WITH rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS (
  SELECT page_id, host, path, h || p AS rule, v
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM fits GROUP BY page_id, host, path)
SELECT parsed.page_id, parsed.host, parsed.path, best.rule,
       coalesce(best.v, CASE WHEN list_has_any(string_split_regex(parsed.host, '[.-]'), {list(url_filter.BLOCKED_WORDS)})
                             THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN best ON parsed.page_id = best.page_id AND parsed.host = best.host AND parsed.path = best.path
""",
)
def url_filter_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op2_ngram_jaccard",
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 85 * (s.n + t.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, w.y FROM reached r JOIN ways w ON r.other = w.x)
SELECT r.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
""",
)
def ngram_jaccard_query(spark, sf_dir):
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), percent=85, words=4)


@query("op3_license_scan")
def license_scan_query(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels("matches").alias("labels"), "score",
    )


@query(
    "op4_exact_topk",
    """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
)
def exact_topk_query(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op5_html_main_text")
def html_main_text_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_main.extract_main_text(pages, html_main.train_labeller(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(
    "op6_embedding_neardup",
    """
WITH RECURSIVE rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM rows a JOIN rows b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM reached r JOIN links l ON r.other = l.x),
roots AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT r.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, r.vec_id = component_id AS kept
FROM roots r LEFT JOIN counts ON x = r.vec_id
""",
)
def embedding_neardup_query(spark, sf_dir):
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def quality_model(spark, sf_dir, docs):
    """Trained with trusted positives outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~quality.in_fold(F.col("doc_id")))
    return quality.train_quality(docs.select(F.col("doc_id").alias("id"), "text"), labels.select(F.col("doc_id").alias("id")))


@query("op7_quality_classifier")
def quality_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality_model(spark, sf_dir, docs))
    return scored.select(
        "doc_id", F.coalesce(quality.in_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query(
    "op8_source_mixing",
    r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS s, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, coalesce(sum(cap) OVER earlier, 0)::DOUBLE AS caps, coalesce(sum(weight) OVER earlier, 0)::DOUBLE AS weights
  FROM sources
  WINDOW earlier AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max(((SELECT sum(s) * 1.5::DOUBLE FROM sources) - caps) / ((SELECT sum(weight) FROM sources) - weights)) AS l
  FROM ordered),
placed AS (
  SELECT d.doc_id, d.size, o.s, least(o.cap, (SELECT l FROM level) * o.weight) AS target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS x, o.place
  FROM sized d JOIN ordered o ON d.source IS NOT DISTINCT FROM o.source),
copies AS (
  SELECT doc_id, copy, place % 3 AS schedule, ((x + s * copy) / target)::DOUBLE AS u,
         greatest(least(round(target) - s * copy - x, size), 0) AS words
  FROM placed, (VALUES (0), (1)) AS passes(copy) WHERE greatest(least(round(target) - s * copy - x, size), 0) > 0),
timed AS (
  SELECT doc_id, copy, words,
         CASE WHEN u > 1 THEN 1
              WHEN schedule = 0 THEN least(2 * u / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * u)), 1)
              WHEN schedule = 1 THEN u
              WHEN u <= 0.625::DOUBLE THEN least(2 * u / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2 * u, 0))), 0.5::DOUBLE)
              ELSE least(0.5::DOUBLE + 2 * (u - 0.625::DOUBLE) / (1 + sqrt(greatest(1 - 2 * (u - 0.625::DOUBLE), 0))), 1)
         END::DOUBLE AS position
  FROM copies),
ranked AS (SELECT *, row_number() OVER (ORDER BY position, copy, doc_id NULLS LAST, words) - 1 AS place FROM timed),
firsts AS (SELECT doc_id, min(position) AS position, min(place) AS place FROM ranked GROUP BY doc_id)
SELECT p.doc_id, size, s::BIGINT AS source_size, target,
       (greatest(least(round(target) - x, size), 0) + greatest(least(round(target) - s - x, size), 0))::BIGINT AS taken,
       round(f.position, 6) AS position, f.place
FROM placed p LEFT JOIN firsts f ON p.doc_id IS NOT DISTINCT FROM f.doc_id
""",
)
def source_mixing_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", mixing.word_count().alias("size")), "sizes")
    plan = stored(mixing.plan_mix(sized, ["doc_id"]), "mix")
    first = mixing.first_places(plan, "doc_id").withColumnRenamed("doc_id", "_id")
    placed = plan.join(first, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return placed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"), "place")


@query("op9_sentencepiece")
def sentencepiece_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_masked_lm")
def masked_lm_query(spark, sf_dir):
    return masked_lm.score_documents(table(spark, sf_dir, "documents"))


def _floors_sql(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor(greatest(least({scale} * x::DOUBLE, {WIDEST}), -{WIDEST})))"


USABLE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
LONG_SQL = "9223372036854775807"


def _clusters_sql(clusters: int = 16, rounds: int = 3) -> str:
    """The plain algorithm, every vector against every centroid in every round."""
    away = "list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c.v) + list_dot_product(c.v, c.v)"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT v.r, v.vec_id, v.v, c.cluster, {away} AS d FROM vectors v CROSS JOIN c{n} c) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""m{n} AS MATERIALIZED (
  SELECT cluster, list(x::DOUBLE ORDER BY place) AS v
  FROM (SELECT cluster, place, (total - ((total % n) + n) % n) // n AS x
        FROM (SELECT cluster, place, sum(x::BIGINT)::BIGINT AS total, count(*) AS n
              FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{n}) GROUP BY cluster, place))
  GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON m.cluster = c.cluster)""")
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, {_floors_sql(64)} AS v FROM embeddings WHERE {USABLE_SQL} AND len(embedding) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM vectors ORDER BY h, v LIMIT {clusters})),
{", ".join(steps)},
inertias AS (SELECT cluster, sum(d::BIGINT) AS total FROM a{rounds} GROUP BY cluster),
told AS (SELECT cluster, sha256(array_to_string(list_transform(v, lambda x: x::BIGINT), ',')) AS h FROM c{rounds})
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.d::BIGINT AS distance, least(i.total, {LONG_SQL})::BIGINT AS cluster_inertia,
       (SELECT least(sum(total), {LONG_SQL}) FROM inertias)::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN inertias i ON i.cluster = a.cluster JOIN told ON told.cluster = a.cluster
"""


@query("op11_centroid_clusters", _clusters_sql())
def centroid_clusters_query(spark, sf_dir):
    found, final = centroids.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    found = stored(found, "clusters")
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    longest = (1 << 63) - 1
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    rows = [(c, min(n, longest), min(sum(sums.values()), longest), told[c]) for c, n in sums.items()]
    # At most one row for each of the 16 clusters.
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The plain algorithm, every part against every entry in every round."""
    steps = []
    away = "x.n2 - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v)"
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, part, any_value(v) AS v, min_by(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT x.r, x.part, x.v, c.entry, {away} AS d FROM pieces x JOIN c{n} c ON c.part = x.part) GROUP BY r, part)""")
        if n < rounds:
            steps.append(f"""m{n} AS MATERIALIZED (
  SELECT part, entry, list(x::DOUBLE ORDER BY place) AS v
  FROM (SELECT part, entry, place, (total - ((total % n) + n) % n) // n AS x
        FROM (SELECT part, entry, place, sum(x::BIGINT)::BIGINT AS total, count(*) AS n
              FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{n}) GROUP BY part, entry, place))
  GROUP BY part, entry),
c{n + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON m.part = c.part AND m.entry = c.entry)""")
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, {_floors_sql(1024)} AS v FROM embeddings WHERE {USABLE_SQL}),
sized AS (SELECT greatest(1, (max(len(v)) + {parts - 1}) // {parts}) AS size FROM vectors),
pieces AS MATERIALIZED (
  SELECT *, list_dot_product(v, v) AS n2
  FROM (SELECT r, vec_id, full_v, part, full_v[part * size + 1:(part + 1) * size] AS v
        FROM (SELECT r, vec_id, size, list_transform(list_resize(v, {parts} * size, 0), lambda x: x::DOUBLE) AS full_v, unnest(range({parts})) AS part
              FROM vectors, sized))),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, full_v) - 1 AS entry, v
  FROM pieces QUALIFY entry < {entries}),
{", ".join(steps)},
coded AS (
  SELECT r, string_agg(right('0' || lower(to_hex(entry)), 2), '' ORDER BY part) AS code, least(sum(d), {LONG_SQL})::BIGINT AS error
  FROM a{rounds} GROUP BY r),
books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS h FROM c{rounds}),
labels AS (SELECT label, least(sum(error), {LONG_SQL})::BIGINT AS total FROM vectors v JOIN coded ON coded.r = v.r GROUP BY label)
SELECT v.vec_id, code, error, total AS label_error, (SELECT h FROM books) AS codebooks_sha256
FROM vectors v JOIN coded ON coded.r = v.r JOIN labels l ON l.label IS NOT DISTINCT FROM v.label
"""


@query("op12_vector_codes", _codes_sql())
def vector_codes_query(spark, sf_dir):
    coded, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = stored(coded, "codes")
    totals = coded.groupBy("label").agg(long_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _pii_sql() -> str:
    """Matches and the pieces between them give the places; checksums are folds over digits."""
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    patterns = {
        "email": email, "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": pii.CARD.pattern, "phone": pii.PHONE.pattern,
        "iban": pii.IBAN.pattern, "hyphenated": pii.HYPHENATED.pattern, "national": pii.NATIONAL.pattern,
        "international": pii.INTERNATIONAL.pattern,
    }
    found = " UNION ALL ".join(
        f"SELECT r, t, '{name}' AS p, regexp_extract_all(t, '{x}') AS m, string_split_regex(t, '{x}') AS between FROM texts"
        for name, x in patterns.items()
    )
    lengths = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in pii.IBAN_LENGTHS.items()) + "}"
    digits = r"regexp_replace(x, '[^0-9]', '', 'g')"
    luhn = (
        "list_sum(list_transform(range(1, length(d) + 1), lambda i: "
        "((d[-i]::INT * (2 - i % 2)) // 10) + ((d[-i]::INT * (2 - i % 2)) % 10))) % 10 = 0"
    )
    left = "regexp_replace(lower(substr(' ' || t, greatest(s - 40, 0) + 1, s + 1 - greatest(s - 40, 0))), '^[a-z]+', '')"
    right = "regexp_replace(lower(substr(t || ' ', e + 1, 21)), '[a-z]+$', '')"
    kinds = list(pii.KINDS)
    context = "CASE k " + " ".join(f"WHEN {kinds.index(k)} THEN {list(w)}" for k, w in pii.CONTEXT.items()) + " END"
    proposal_kind = "CASE p " + " ".join(f"WHEN '{p}' THEN {kinds.index(k)}" for p, k in pii.ADDED_KIND.items()) + " END"
    proposal_score = "CASE p " + " ".join(f"WHEN '{p}' THEN {s}" for p, s in pii.ADDED_SCORE.items()) + " END"
    told = f"{kinds}[k + 1] || ':' || s || ':' || e"
    return rf"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS MATERIALIZED (
  SELECT r, t, p, x, s, s + length(x) AS e, {digits} AS d
  FROM (SELECT r, t, p, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'x': m[i], 's': (
          coalesce(list_sum(list_transform(between[1:i], lambda y: length(y))), 0)
          + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT}}), recursive := true)
        FROM found)),
base AS MATERIALIZED (
  SELECT r, list_position({kinds}, p) - 1 AS k, s, e FROM placed
  WHERE p = 'email'
     OR (p = 'ip' AND len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR ('0' || right(y, 3))::INT > 255)) = 0)
     OR (p = 'card' AND length(d) BETWEEN 12 AND 19 AND {luhn})
     OR (p = 'phone' AND length(d) BETWEEN 9 AND 15)),
cut AS (
  SELECT *, {lengths}[left(x, 2)] AS want, replace(x, ' ', '') AS compact FROM placed WHERE p = 'iban'),
ibans AS (
  SELECT r, t, 'iban' AS p, s, e, substr(compact, 5, want - 4) || left(compact, 4) AS turned
  FROM (SELECT * REPLACE (s + list_min(list_filter(range(1, length(x) + 1), lambda i: length(replace(left(x, i), ' ', '')) = want)) AS e)
        FROM cut WHERE length(compact) >= want)),
proposed AS (
  SELECT r, t, p, s, e FROM ibans
  WHERE list_reduce(list_transform(string_split(turned, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END),
                    lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97, 0) = 1
    AND NOT regexp_matches(substr(t || ' ', e + 1, 1), '[A-Za-z0-9]') AND NOT regexp_matches(substr(' ' || t, s + 1, 1), '[A-Za-z0-9]')
  UNION ALL SELECT r, t, 'run', s, e FROM placed WHERE p = 'hyphenated' AND length(d) BETWEEN 12 AND 19 AND {luhn}
  UNION ALL SELECT r, t, 'ssn', s, e FROM placed WHERE p = 'hyphenated' AND regexp_full_match(x, '{pii.SSN.pattern}')
    AND left(x, 3) NOT IN ('000', '666') AND left(x, 3) < '900' AND x[5:6] <> '00' AND right(x, 4) <> '0000'
  UNION ALL SELECT r, t, p, s, e FROM placed WHERE p IN ('national', 'international')
    AND NOT regexp_matches(substr(t || ' ', e + 1, 1), '[0-9]') AND NOT regexp_matches(substr(' ' || t, s + 1, 1), '[0-9]')),
scored AS (
  SELECT r, k, s, e, round(least(1, greatest(0, first + CASE WHEN list_has_any(words, {context}) THEN {pii.FOR} ELSE 0 END
                                                   - CASE WHEN list_has_any(words, {list(pii.DOUBTS)}) THEN {pii.AGAINST} ELSE 0 END)), 6) AS score
  FROM (SELECT r, s, e, {proposal_kind} AS k, ({proposal_score})::DOUBLE AS first,
               list_concat(regexp_extract_all({left}, '[a-z]+'), regexp_extract_all({right}, '[a-z]+')) AS words FROM proposed)),
good AS MATERIALIZED (SELECT DISTINCT r, k, s, e, score FROM scored WHERE score >= {pii.LEAST}),
added AS (
  SELECT r, k, s, e FROM good g
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = g.r AND b.s < g.e AND g.s < b.e)
    AND NOT EXISTS (SELECT 1 FROM good o WHERE o.r = g.r AND o.s < g.e AND g.s < o.e AND (-o.score, o.s, o.k, o.e) < (-g.score, g.s, g.k, g.e))),
bases AS (
  SELECT r, string_agg({told}, ',' ORDER BY s, k, e) AS told,
         {", ".join(f"count(*) FILTER (k = {i}) AS n{i}" for i in range(4))} FROM base GROUP BY r),
everything AS (
  SELECT r, string_agg({told}, ',' ORDER BY s, k, e) AS told FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n{i}, 0)::BIGINT AS n_{kinds[i]}" for i in range(4))},
       sha256(coalesce(b.told, '')) AS base_sha256, coalesce(a.told, '') AS spans
FROM texts LEFT JOIN bases b ON b.r = texts.r LEFT JOIN everything a ON a.r = texts.r
"""


@query("op13_pii", _pii_sql())
def pii_query(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *map(number, pii.BASE_SCORE), F.sha2(told(base), 256).alias("base_sha256"), told("pii").alias("spans"))
