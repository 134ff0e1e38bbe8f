"""The queries of this package and their SQL, where SQL can express them.

Every query reads whole tables. ``QUERIES``: name to (spark, sf_dir) -> DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, centroids, decontaminate, html_extract, line_dedup, nbsvm, ngram_lm, phrases, secret_scan, simhash, substring_dedup, toxicity, transport_stream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    """Place of the installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), ranks_path(), ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), text=False)


OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS phrase
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS p FROM w WHERE len(ws) >= 13)),
owners AS (SELECT phrase, min(doc_id) AS owner FROM windows GROUP BY phrase HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, list(p) AS ps FROM windows JOIN owners USING (phrase) WHERE doc_id > owner GROUP BY doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS q FROM (SELECT doc_id, unnest(ps) AS p FROM hits)),
gone AS (SELECT doc_id, list(q) AS qs FROM covered GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, ws, coalesce(len(qs), 0) AS n_removed,
         CASE WHEN qs IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(qs, i)) END AS ks
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.to_media(table(spark, sf_dir, "documents"), media=False)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score_texts(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, line, pos, coalesce(doc_id <> keep, false) AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _clusters_sql(clusters: int = 8, rounds: int = 10) -> str:
    """One group of clauses a round; each vector is a row with its components as a list."""
    out = [f"""v AS MATERIALIZED (
  SELECT vec_id, sha256('3:' || vec_id) AS h, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM v QUALIFY j < {clusters})"""]
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (
  SELECT * FROM (SELECT vec_id, x, j, c, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{k})
  QUALIFY row_number() OVER (PARTITION BY vec_id, x ORDER BY d, j) = 1)""")
        if k < rounds:
            out.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT j, coalesce(m, c) AS c FROM c{k} LEFT JOIN (
    SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
      SELECT j, i, sum(y)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY j, i) GROUP BY j) USING (j))""")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds}"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, base = [*secret_scan.BASE, *secret_scan.MORE], [r.name for r in secret_scan.BASE]
    found = secret_scan.scan(table(spark, sf_dir, "documents"), every)
    return found.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in base],
        F.sha2(F.encode(secret_scan.spelled(every, *base), "UTF-8"), 256).alias("base_sha256"), secret_scan.spelled(every, *[r.name for r in every]).alias("spans"),
    )  # fmt: skip


def _secrets_sql() -> str:
    """Every rule over every text, without an index."""
    parts = []
    for i, r in enumerate([*secret_scan.BASE, *secret_scan.MORE]):
        quoted = r.pattern.replace("'", "''")
        parts.append(f"""SELECT n, {i} AS place, '{r.name}' AS name, unnest(list_transform(list_zip(gaps, hits, vals, range(1, len(hits) + 1)), lambda z:
    {{'s': coalesce(list_sum(list_transform(gaps[1:z[4]], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:z[4] - 1], lambda g: length(g))), 0), 'w': length(z[2]), 'v': length(z[3])}})[1:len(hits)]) AS f
  FROM (SELECT n, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}', 0) AS hits, regexp_extract_all(t, '{quoted}', {r.group}) AS vals FROM d)""")
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate([*secret_scan.BASE, *secret_scan.MORE]))
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
hit AS ({" UNION ALL ".join(parts)}),
good AS (SELECT n, place, name, f.s::BIGINT AS s, name || ':' || f.s::BIGINT || ':' || (f.s + f.w)::BIGINT AS span FROM hit WHERE f.v >= CASE place {least} END),
flat AS (
  SELECT n, count(*) FILTER (WHERE place = 0) AS a, count(*) FILTER (WHERE place = 1) AS c, count(*) FILTER (WHERE place = 2) AS h,
         string_agg(span, ',' ORDER BY s, place) FILTER (WHERE place < 3) AS base, string_agg(span, ',' ORDER BY s, place) AS spans FROM good GROUP BY n)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN flat USING (n)"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
  SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM ws, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, f, k, array_to_string(w[1:i], ' ') AS left_part, array_to_string(w[i + 1:], ' ') AS right_part, i FROM (SELECT *, unnest(generate_series(1, k - 1)) AS i FROM cand)),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, i, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.left_part JOIN f y ON y.lang = c.lang AND y.phrase = c.right_part),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS over FROM (
    SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM cand WHERE k > 2)) GROUP BY 1, 2),
kept AS (SELECT w.* FROM worst w LEFT JOIN inner_phrases p ON p.lang = w.lang AND p.phrase = w.phrase WHERE p.over IS NULL OR 100 * p.over < 80 * w.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_lm": op4_ngram_lm,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_transport_stream": op6_transport_stream,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_annulus_clusters": op11_annulus_clusters,
    "op12_secret_scan": op12_secret_scan,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op5_substring_dedup": OP5_SQL, "op9_line_dedup": OP9_SQL, "op11_annulus_clusters": _clusters_sql(), "op12_secret_scan": _secrets_sql(), "op13_collocations": OP13_SQL}
