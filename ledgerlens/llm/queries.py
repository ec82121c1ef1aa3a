"""The subpackage's named queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe_stream, decontaminate, hard_negatives, hash_search, html_text, language, license_scan, line_dedup, merkle_manifest, simhash_dedup, suffix_dedup, toxicity, url_filter
from ledgerlens.llm._spark import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_ITEMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op6_decontaminate"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_ITEMS}, []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEMS} AS w FROM benchmark),
known AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS said FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM known),
said AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS said FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs CROSS JOIN sizes WHERE len(w) >= k)),
hits AS (SELECT r, i, k, item_id FROM said JOIN known USING (k, said)),
places AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + k)) AS place FROM hits) GROUP BY r),
found AS (SELECT r, list_sort(list_distinct(list(item_id))) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""

_EVEN = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: list_reduce(list_concat([xor(c, x)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)) % 2 = 1"""
_SAID = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || source, '-') AS g, sha256({_SAID} || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256({_SAID} || coalesce(strlen(said) || ':' || said, '-')) AS tampered
  FROM (SELECT *, CASE WHEN doc_id IS NULL OR {_EVEN} THEN replace(text, chr(10), '') ELSE text END AS said FROM documents)),
leaves AS (SELECT row_number() OVER () AS r, *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
tree AS (SELECT 0 AS level, g, pos, leaf AS digest, n FROM leaves
  UNION ALL SELECT level + 1, g, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY level, g, pos // 3, n),
subroots AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM crown WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (SELECT 0 AS part, * FROM tree UNION ALL SELECT 1, level, '', pos, digest, n FROM crown),
runs AS (SELECT part, level, g, pos, n,
  coalesce(string_agg(digest, '') OVER (PARTITION BY part, level, g, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(digest, '') OVER (PARTITION BY part, level, g, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM nodes),
folds AS (SELECT r, 0 AS part, 0 AS level, l.g, l.pos, l.n, tampered AS digest, '' AS proof FROM leaves l
  UNION ALL SELECT r, CASE WHEN f.n = 1 THEN 1 ELSE f.part END, CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END, CASE WHEN f.n = 1 THEN '' ELSE f.g END, CASE WHEN f.n = 1 THEN s.pos ELSE f.pos // 3 END,
    CASE WHEN f.n = 1 THEN s.n ELSE (f.n + 2) // 3 END, CASE WHEN f.n = 1 THEN f.digest ELSE sha256(t.before || f.digest || t.after) END, CASE WHEN f.n = 1 THEN proof ELSE proof || t.before || t.after END
  FROM folds f LEFT JOIN runs t ON t.part = f.part AND t.level = f.level AND t.g = f.g AND t.pos = f.pos LEFT JOIN subroots s ON s.g = f.g WHERE f.part = 0 OR f.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM leaves JOIN subroots USING (g) CROSS JOIN (SELECT digest AS root FROM crown WHERE n = 1) JOIN folds f USING (r) WHERE f.part = 1 AND f.n = 1
"""

ORACLES["op12_hard_negatives"] = """
WITH known AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM known a JOIN known b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT n.anchor_id, n.id AS positive_id, CAST(row_number() OVER (PARTITION BY n.anchor_id, n.id ORDER BY f.score DESC, f.id) AS INTEGER) AS rank, f.id AS negative_id, n.score AS positive_score, f.score AS negative_score
FROM near n JOIN scored f ON f.anchor_id = n.anchor_id AND NOT f.same AND 80 * n.score <= 100 * f.score AND 100 * f.score <= 100 * n.score QUALIFY rank <= 5
"""

ORACLES["op13_suffix_dedup"] = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(hex(encode(text)), '') AS x FROM documents),
strings AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS said FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM docs)),
repeated AS (SELECT r, i FROM strings QUALIFY count(*) OVER (PARTITION BY said) > 1),
spans AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span
  FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM repeated)) GROUP BY r, span),
gaps AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM spans),
kept AS (SELECT r, sum(hi - lo) AS n, count(*) AS k, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS y FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

# What SQL can tell of the license scan and of the url filter: all but spans and trees.
_PHRASE = "list_transform(list_filter(range(len(w)), lambda i: {0}), lambda i: {{'at': i, 'label': '{1}'}})"
_PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
_FOUND = "list_concat(" + ", ".join(_PHRASE.format(" AND ".join(f"w[i + {j}] = '{word}'" for j, word in enumerate(phrase.split(), 1)), label) for phrase, label in _PHRASES) + ")"
ORACLES["license_phrases"] = f"""
WITH docs AS (SELECT doc_id, coalesce({_ITEMS}, []) AS w FROM documents), found AS (SELECT doc_id, w, {_FOUND} AS f FROM docs)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(f) AS BIGINT) AS n_base, CAST(list_min(list_transform(f, lambda x: x.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(f, lambda x: x.at)) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.label))), ','), '') AS base_labels FROM found
"""
ORACLES["url_rules"] = """
WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r(h, p, ruled))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule, arg_max(ruled, length(h || p)) AS ruled
FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
"""


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    listed = F.array_join(F.array_sort("item_ids"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = language.fit(docs.where("not held_out"))
    return language.predict(docs, model, keep=["doc_id", "held_out"])


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return toxicity.score(docs, machine, keep=["doc_id", "held_out"])


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.fit(pages), keep=["page_id"])


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))


@query
def op2_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hash_search.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.find(table(spark, sf_dir, "documents"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.find(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.when(remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    tampered = merkle_manifest.leaf([text if c == "text" else F.col(c) for c in merkle_manifest.FIELDS])
    found = merkle_manifest.manifest(docs, keep={"doc_id": F.col("doc_id"), "tampered": tampered})
    folded = merkle_manifest.fold(F.col("tampered"), F.col("proof"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


@query
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))
