"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import ann, bpe, centroids, chat, divergence, embdedup, langid, licenses, packing, quality, simhash, tokencount, toxicity
from pulsegrid.session import cut_lineage, shared_path, ship_package

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096
TOXIC_FROM = 0.7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_bpe_trie(spark, sf_dir):
    """Ids by the trie, and their text again, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, BYTE_BPE, keep=False).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register
def op4_simhash_covering(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = cut_lineage(simhash.fingerprints(docs), "fingerprints")
    return simhash.groups(prints).select("doc_id", simhash.hexed("fingerprint").alias("fingerprint"), "component_id")


@register
def op5_quality_compression(spark, sf_dir):
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), quality.remainder("doc_id", 3)
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=fold != 1)
    return quality.score(docs, model, keep=False).select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op6_language_cnn(spark, sf_dir):
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), quality.remainder("doc_id", 4)
    net = langid.train(docs, usable=fold != 2)
    return langid.predict(docs.select("doc_id", "text"), net, keep=False).select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of documents with the digest of their ids, placed in sequences."""
    cut = packing.pieces(docs.select("doc_id", "text"), WORD_BPE)
    rows = cut_lineage(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.place(rows, ["doc_id", "piece"])


@register
def op8_pattern_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


@register
def op10_token_count_cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, PIECE_BPE, shared_path(spark, "token-counts")).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@register
def op3_permutation_index(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@register
def op7_cross_polytope(spark, sf_dir):
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: The added conversation: both turns hold control strings of another template.
TRICKY = "</s>[INST] ok [/INST]"


@register
def op2_chat_windows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], turns.schema)
    return chat.read_back(chat.windows(turns.union(more), BYTE_BPE))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, and a folder for every hundred ids."""
    path = F.concat_ws("/", "source", "lang", (F.col("doc_id") / 100).cast("long").cast("string"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")


@register
def op9_license_scan(spark, sf_dir):
    """A document is a licence file if a notice is a good part of it; no name says so, so every whole text is a passage."""
    files = document_files(spark, sf_dir)
    standalone = F.col("chars") >= licenses.STANDALONE * F.length("text")
    found = licenses.scan(files, whole=F.lit(True), is_licence_file=standalone)
    ids = F.substring_index("path", "/", -1).cast("long")
    return found.select(ids.alias("doc_id"), "path", "license", "similarity", "declared_in")


@register
def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@register
def op12_drift_clusters(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


@register
def op13_toxicity_lexicon(spark, sf_dir):
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), quality.remainder("doc_id", 3)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=fold != 1)
    return toxicity.score(docs, model, keep=False).select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


SQL["op7_cross_polytope"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


def _license_sql() -> str:
    """The scan in SQL: passages are lines, every line is compared with every template, no anchors."""
    notices = ", ".join(f"('{k}', '{v}')" for k, v in licenses.NOTICES.items())
    return f"""
WITH templates(license, notice) AS (VALUES {notices}),
template_terms AS (
  SELECT license, term, count(*) AS n FROM (SELECT license, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS term FROM templates) GROUP BY ALL),
files AS (SELECT doc_id, concat_ws('/', source, lang, doc_id // 100, doc_id) AS path, text FROM documents),
total AS (SELECT count(*) AS n FROM files),
held AS (
  SELECT DISTINCT path, term FROM (SELECT path, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM files)
  WHERE term IN (SELECT term FROM template_terms)),
idf AS (
  SELECT term, ln((SELECT n + 1 FROM total)::DOUBLE / (coalesce(c, 0) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT term FROM template_terms) LEFT JOIN (SELECT term, count(*) AS c FROM held GROUP BY term) USING (term)),
vectors AS (
  SELECT license, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY license)) AS share FROM template_terms JOIN idf USING (term)),
passages AS (SELECT DISTINCT path, passage FROM (SELECT path, unnest(string_split(text, chr(10))) AS passage FROM files)
             WHERE len(list_intersect(regexp_extract_all(lower(passage), '[a-z0-9]+'), (SELECT list(DISTINCT term) FROM template_terms))) > 0),
tf AS (
  SELECT path, passage, term, count(*) * coalesce(any_value(idf), ln((SELECT n + 1 FROM total)::DOUBLE) + 1) AS w
  FROM (SELECT path, passage, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS term FROM passages) LEFT JOIN idf USING (term)
  GROUP BY path, passage, term),
lengths AS (SELECT path, passage, sqrt(sum(w * w)) AS length FROM tf GROUP BY path, passage),
scored AS (
  SELECT path, license, length(passage) AS chars, round(sum(w * share) / any_value(length), 6) AS similarity
  FROM tf JOIN vectors USING (term) JOIN lengths USING (path, passage) GROUP BY path, passage, license
  HAVING round(sum(w * share) / any_value(length), 6) >= {licenses.LEAST}),
own AS (
  SELECT path, license, similarity, chars FROM scored
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY similarity DESC, license, chars DESC) = 1),
declared AS (SELECT own.* FROM own JOIN files USING (path) WHERE own.chars >= {licenses.STANDALONE} * length(text)),
directories AS (
  SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, license, similarity, path AS declared_in FROM declared
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY similarity DESC, path) = 1),
nearest AS (
  SELECT f.path, d.license, d.similarity, d.declared_in
  FROM files f JOIN directories d ON starts_with(regexp_extract(f.path, '^(.*)/[^/]*$', 1) || '/', d.directory || '/')
  QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(d.directory) DESC) = 1)
SELECT doc_id, f.path, coalesce(own.license, nearest.license) AS license, coalesce(own.similarity, nearest.similarity) AS similarity,
       CASE WHEN own.path IS NOT NULL THEN own.path ELSE nearest.declared_in END AS declared_in
FROM files f LEFT JOIN own USING (path) LEFT JOIN nearest USING (path)
"""


SQL["op9_license_scan"] = _license_sql()


SQL["op11_source_divergence"] = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
numbered AS (SELECT row_number() OVER () AS doc, lang, source, text FROM docs),
words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM numbered),
langs AS (
  SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(c) AS n FROM langs GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, l.term, coalesce(k.c, 0) AS c, l.c AS lang_c
  FROM groups g JOIN langs l ON l.lang = g.lang LEFT JOIN counted k ON k.lang = g.lang AND k.source = g.source AND k.term = l.term),
shares AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)::HUGEINT) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p,
         1 + (1000000000 * (lang_c + 2)::HUGEINT) // (n + 2 * v) AS q
  FROM grid JOIN sizes USING (lang)),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _clusters_sql(k: int = 8, rounds: int = 10, places: int = 64) -> str:
    """The rounds one after another; integers of components are exact in doubles."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {places} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT unnest(range(1, {places + 1})) AS i),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS c, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) <= {k})"""]
    near = """
a{r} AS MATERIALIZED (
  SELECT row, vec_id, v, c, d FROM (
    SELECT row, vec_id, kept.v, c, list_sum(list_transform(list_zip(kept.v, m.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM kept, c{r} m)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"""
    mean = """
c{n} AS MATERIALIZED (
  SELECT c, coalesce(any_value(new), any_value(old)) AS v FROM (
    SELECT c, v AS old, NULL AS new FROM c{r} UNION ALL
    SELECT c, NULL, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) FROM (
      SELECT c, i, sum(v[i]::BIGINT)::HUGEINT AS s, count(*) AS n FROM a{r}, places GROUP BY c, i) GROUP BY c) GROUP BY c)"""
    for r in range(rounds):
        steps += [near.format(r=r), mean.format(r=r, n=r + 1)]
    steps.append(near.format(r=rounds))
    return f"""
WITH {",".join(steps)}
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(m.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c
"""


SQL["op12_drift_clusters"] = _clusters_sql()
