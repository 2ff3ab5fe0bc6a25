"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import bpe, html, id_files, jaccard, mixing, plane_clusters, quality_classifier, quality_rules, secrets, token_counts, topk, urls, vector_codes
from assayline.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = bpe.read_definition(public_tokenizers.path(BYTE_BPE))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, definition).drop("text")
    return bpe.decode(encoded, definition).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# Sets, pairs and reachability in plain SQL; the operator never makes all these pairs.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM words
), parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM parts a JOIN parts b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, len(s.s)
"""


@query("op2_jaccard", OP2_SQL)
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard.jaccard_components(docs, width=3, numerator=90, denominator=100).select("doc_id", "n_shingles", "component_id")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op3_topk", OP3_SQL)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


OP4_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), places AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
      CASE WHEN regexp_matches(s, '[0-9]') THEN '*' || regexp_extract(s, '[.][A-Za-z]{1,5}$') ELSE s END) AS parts FROM places
), labelled AS (
  SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' ELSE 'block' END AS given,
    array_to_string(CASE WHEN len(parts) > 6 THEN list_concat(parts[1:6], ['**']) ELSE parts END, '/') AS shape FROM ruled
), counted AS (
  SELECT host, shape, count(*) AS n, count(given) AS labels, count(*) FILTER (given = 'block') AS blocked FROM labelled GROUP BY ALL
), split AS (SELECT *, string_split(shape, '/') AS s FROM counted
), placed AS (
  SELECT host, shape, n, i AS pos, s[i] AS part, array_to_string(s[1 : i - 1], '/') AS pre
  FROM split, unnest(range(1, len(s) + 1)) AS t(i)
), variable AS (
  SELECT host, pre, pos FROM (SELECT host, pre, pos, part, sum(n) AS n FROM placed GROUP BY ALL)
  GROUP BY ALL HAVING count(*) >= 10 AND count(*) * 2 > sum(n)
), general AS (
  SELECT p.host, p.shape, p.pos, CASE WHEN v.pos IS NOT NULL AND NOT starts_with(p.part, '*') THEN '*' ELSE p.part END AS part
  FROM placed p LEFT JOIN variable v ON p.host = v.host AND p.pre = v.pre AND p.pos = v.pos
), shaped AS (
  SELECT host, shape, string_agg(part, '/' ORDER BY pos) AS template,
         string_agg(CASE WHEN starts_with(part, '*') THEN part ELSE '?' END, '/' ORDER BY pos) AS form FROM general GROUP BY ALL
), nodes AS (
  SELECT s.host, template, form, sum(labels) AS labels, sum(blocked) AS blocked
  FROM shaped s JOIN counted c ON s.host = c.host AND s.shape = c.shape GROUP BY ALL
), overall AS (SELECT CASE WHEN sum(labels) > 0 THEN sum(blocked) / sum(labels) ELSE 0 END AS share FROM nodes
), priors AS (
  SELECT template, (sum(blocked) + 10 * any_value(share)) / (sum(labels) + 10) AS prior FROM nodes, overall GROUP BY template
), smoothed AS (SELECT n.*, labels + 10 AS l, blocked + 10 * prior AS b FROM nodes n JOIN priors p ON n.template = p.template
), pooled AS (SELECT host, form, round(sum(b) / sum(l), 9) AS p FROM smoothed GROUP BY ALL
), tested AS (
  SELECT s.*, CASE WHEN abs(b / l - p) > 1.96 * sqrt(p * (1 - p) / l) THEN s.template ELSE s.form || '~' END AS branch
  FROM smoothed s JOIN pooled q ON s.host = q.host AND s.form = q.form
), judged AS (
  SELECT host, template, round(sum(b) OVER w / sum(l) OVER w, 6) AS purity FROM tested WINDOW w AS (PARTITION BY host, form, branch)
)
SELECT page_id, r.host, path, rule, coalesce(given, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, s.template, purity
FROM labelled r JOIN shaped s ON r.host = s.host AND r.shape = s.shape JOIN judged j ON s.host = j.host AND s.template = j.template
"""


@query("op4_url_filter", OP4_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.classify(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(secrets.digest_text(F.col("secrets"), secrets.KINDS[:3]), 256).alias("base_sha256"),
        secrets.digest_text(F.col("secrets")).alias("spans"),
    )


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("log_perplexity", 6).alias("log_perplexity")
    )


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model, described = quality_classifier.fit(docs, labels)
    scored = model.score_described(described).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= quality_classifier.LIMIT).cast("int").alias("predicted"))


@query("op8_html")
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs.withColumn("n_tokens", mixing.words(F.col("text"))).drop("text"), mixing.Target(repetition=4.0), tokens=F.col("n_tokens"))
    return mixed.select("doc_id", "source", "n_tokens", "copies")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that the whole work shows."""
    definition = bpe.read_definition(public_tokenizers.path(WORD_BPE))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, definition, fresh_path(spark, "token-counts"))
    return counted.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


# Vectors as integers; ids and vectors order them, as equal ids may occur.
def _numbers(scale: int) -> str:
    return f"""numbers AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""


def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 16) -> str:
    """Every part against every entry, round by round."""
    steps = [f"""{_numbers(1024)}, kept AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM numbers WHERE len(v) = {parts * width}
), cut AS (
  SELECT r, p::INTEGER AS p, v[p * {width} + 1 : p * {width} + {width}] AS x FROM kept, range({parts}) t(p)
), books0 AS (SELECT p, (r - 1)::INTEGER AS e, x FROM cut WHERE r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS (
  SELECT r, c.p, min((list_sum(list_transform(range(1, {width + 1}), lambda i: (c.x[i] - b.x[i]) * (c.x[i] - b.x[i]))) * 256 + b.e)::BIGINT) AS best
  FROM cut c JOIN books{i} b ON c.p = b.p GROUP BY ALL
)""")
        if i < rounds:
            steps.append(f"""moved{i} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT n.p, best % 256 AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS m
    FROM near{i} n JOIN cut c ON n.r = c.r AND n.p = c.p, range(1, {width + 1}) t(i) GROUP BY ALL) GROUP BY ALL
), books{i + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM books{i} b LEFT JOIN moved{i} m ON b.p = m.p AND b.e = m.e)""")
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT k.r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', (best % 256)::INTEGER), '' ORDER BY p) AS code,
         sum(best // 256)::BIGINT AS error FROM kept k JOIN near{rounds} n ON k.r = n.r GROUP BY k.r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM books{rounds}) AS codebooks_sha256 FROM coded
"""


@query("op11_vector_codes", _op11_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


@query("op12_id_files")
def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents to files of byte planes and reads them back."""
    path = fresh_path(spark, "token-ids")
    id_files.write_documents(table(spark, sf_dir, "documents"), bpe.read_definition(public_tokenizers.path(WORD_BPE)), path, end_id=2)
    read = id_files.read_documents(spark, path)
    return read.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    steps = [f"""{_numbers(64)}, kept AS (SELECT *, sha256('1:' || vec_id) AS h, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) AS r
  FROM numbers WHERE len(v) = 64
), centres0 AS (SELECT (r - 1)::INTEGER AS c, v FROM kept WHERE r <= {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS (
  SELECT r, min((list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - s.v[i]) * (k.v[i] - s.v[i]))) * {k} + s.c)::BIGINT) AS best
  FROM kept k, centres{i} s GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""moved{i} AS (
  SELECT c, list(m ORDER BY i) AS v FROM (
    SELECT best % {k} AS c, i, floor(sum(v[i]) / count(*))::BIGINT AS m FROM near{i} n JOIN kept x ON n.r = x.r, range(1, 65) t(i) GROUP BY ALL)
  GROUP BY c
), centres{i + 1} AS (SELECT s.c, coalesce(m.v, s.v) AS v FROM centres{i} s LEFT JOIN moved{i} m ON s.c = m.c)""")
    return f"""WITH {", ".join(steps)}, placed AS (
  SELECT vec_id, (best % {k})::INTEGER AS cluster, best // {k} AS distance FROM kept x JOIN near{rounds} n ON x.r = n.r
)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(s.v, ',')) AS centroid_sha256 FROM placed p JOIN centres{rounds} s ON p.cluster = s.c
"""


@query("op13_centroid_clusters", _op13_sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_clusters.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64)
