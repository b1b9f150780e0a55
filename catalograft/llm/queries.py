"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalograft.llm import ann, collocations, embedding_dedup, katz, langid, licenses, main_text, mixing, packing, quality, secret_scan, simhash, whitening
from catalograft.llm.common import table


def op1_katz(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return katz.score(docs, katz.held_out(docs["doc_id"]))


def op2_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    found = langid.identify(docs.select("doc_id", "text"), net)
    held_out = langid.held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", F.col("lang_score").alias("score"))


def op6_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)


def op7_secret_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan_secrets(docs))


def op8_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("text_key")


def op9_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"))


def op10_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = main_text.extract(pages, main_text.fit(pages))
    text = F.col("main_text")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs.where(~quality.held_out(docs["doc_id"])), table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    predicted = (score >= quality.THRESHOLD).cast("int").alias("predicted")
    found = quality.judge(docs, model)
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), predicted)


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_katz, op2_licenses, op3_embedding_dedup, op4_simhash, op5_language_id, op6_packing, op7_secret_scans, op8_mixing, op9_nearest, op10_main_text, op11_collocations, op12_quality, op13_whitening)}

_NOTICES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.TEMPLATES.items()))
_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\p{L}\p{N}]+(?:\.\p{N}+)*')"""
_SHINGLES = "list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])"

ORACLES = {
    "op2_licenses": f"""
WITH notices AS (
  SELECT license_id, {_SHINGLES} AS s FROM (
    SELECT license_id, {_WORDS} AS w FROM (VALUES {_NOTICES}) AS n(license_id, text))
), texts AS (
  SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL)
)
SELECT doc_id, license_id, len(list_intersect(texts.s, notices.s)) / len(notices.s) AS containment
FROM texts, notices WHERE len(list_intersect(texts.s, notices.s)) >= 0.8 * len(notices.s)
""",
    "op3_embedding_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), named AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counted AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, n.component_id, e.vec_id = n.component_id AS kept
FROM embeddings e JOIN named n ON e.vec_id = n.x LEFT JOIN counted c ON e.vec_id = c.x
""",
    "op8_mixing": """
WITH rows AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS size
  FROM documents
), scored AS (
  SELECT *,
    -ln((('0x' || substr(md5('17|' || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
    / coalesce(0.5 + 0.5 * greatest(0.0, 1 - abs(length(text)::DOUBLE / greatest(size, 1) - 6.5) / 10)
               * size / (size + 20), 0.5) AS key
  FROM rows
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM scored GROUP BY source
), levels AS (
  SELECT *, 2.0 * source_size AS cap,
    (1.5 * sum(source_size) OVER ()
     - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), targets AS (
  SELECT source, source_size,
    least(cap, max(level) OVER () * w)::DOUBLE AS target
  FROM levels
), ordered AS (
  SELECT s.*, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, s.doc_id NULLS LAST, md5(coalesce(text, ''))
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM scored s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), epoch AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM ordered
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM epoch
""",
    "op11_collocations": """
WITH pieces AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')), '[^ \\t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents WHERE text IS NOT NULL)
), sizes AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
      SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS sizes(k)))
  GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT g.lang, g.phrase, g.k, g.f AS a, c, l.f AS l, r.f AS r, s.n::BIGINT AS n,
    ((1000::HUGEINT * g.f * s.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM grams WHERE k > 1) AS g
  JOIN sizes AS s ON s.lang = g.lang
  JOIN grams AS l ON l.lang = g.lang AND l.phrase = array_to_string(string_split(g.phrase, ' ')[1:c], ' ')
  JOIN grams AS r ON r.lang = g.lang AND r.phrase = array_to_string(string_split(g.phrase, ' ')[c + 1:], ' ')
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS nth FROM cuts
), kept AS (
  SELECT * FROM lowest AS g WHERE nth = 1 AND NOT EXISTS (
    SELECT 1 FROM grams AS h WHERE h.lang = g.lang AND h.k > g.k AND 100 * h.f >= 100 * g.a
      AND contains(' ' || h.phrase || ' ', ' ' || g.phrase || ' '))
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
WHERE rank <= 2000
""",
}
