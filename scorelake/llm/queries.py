"""One query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import ann, backoff, exact, html, manifest, near, packing, phrases, pieces, simhash, token_output, toxic, winnow
from scorelake.llm.common import table
from scorelake.llm.registry import query

EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS kept,
       h AS text_sha256
FROM d
"""


@query("op10_exact_dedup", EXACT_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.DigestIndex(spark).add(table(spark, sf_dir, "documents")).drop("n_chars")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
li AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, li.y FROM r JOIN li ON li.x = r.y)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, sh
"""


@query("op8_minhash_near_dedup", NEAR_SQL)
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80).drop("uid", "set_id")


BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


@query("op6_token_output")
def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_segments(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


@query("op5_pieces")
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_neighbours(simhash.fingerprint_documents(table(spark, sf_dir, "documents")))


@query("op1_stupid_backoff")
def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score_documents(table(spark, sf_dir, "documents"))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.without_repeats(table(spark, sf_dir, "documents"), long=winnow.LONG)
    return rows.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


MANIFEST_SQL = r"""
WITH RECURSIVE c AS (
  SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS k,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR b IN string_split(doc_id::VARCHAR, '')])),
                     lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))) AS crc
  FROM documents),
d AS (
  SELECT k, doc_id, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
         sha256(concat(head, coalesce(strlen(t) || ':' || t, '-'))) AS claimed
  FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM c)),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS m FROM d),
up AS (
  SELECT k, 0 AS lvl, i, leaf AS h, m FROM l
  UNION ALL
  SELECT k, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(m) + 2) // 3 FROM up WHERE m > 1 GROUP BY k, lvl, i // 3),
top AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS j, count(*) OVER () AS m FROM up WHERE m = 1),
over AS (
  SELECT 1000 AS lvl, j AS i, h, m FROM top
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(m) + 2) // 3 FROM over WHERE m > 1 GROUP BY lvl, i // 3),
nodes AS (SELECT k, lvl, i, h, m FROM up WHERE m > 1 UNION ALL SELECT NULL, lvl, i, h, m FROM over WHERE m > 1),
runs AS (
  SELECT a.k, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS le, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS ri
  FROM nodes a JOIN nodes b ON a.k IS NOT DISTINCT FROM b.k AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 GROUP BY ALL),
steps AS (
  SELECT l.k, l.i, r.lvl, le, ri FROM l JOIN runs r ON r.k = l.k AND r.i = l.i // (3 ** r.lvl)::BIGINT
  UNION ALL
  SELECT l.k, l.i, r.lvl, le, ri FROM l JOIN top USING (k) JOIN runs r ON r.k IS NULL AND r.i = top.j // (3 ** (r.lvl - 1000))::BIGINT),
paths AS (SELECT k, i, string_agg(le || ri, '' ORDER BY lvl) AS proof, list(le || '#' || ri ORDER BY lvl) AS path FROM steps GROUP BY k, i)
SELECT l.doc_id, l.leaf, top.h AS subroot, r.h AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       list_reduce(list_prepend(claimed, coalesce(path, [])), lambda c, x: sha256(split_part(x, '#', 1) || c || split_part(x, '#', 2))) AS folded_root,
       folded_root = root AS verified
FROM l JOIN top USING (k) JOIN (SELECT h FROM over WHERE m = 1) r ON true LEFT JOIN paths ON paths.k = l.k AND paths.i = l.i
"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest.manifest(table(spark, sf_dir, "documents"), claimed=tampered)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


PHRASE_SQL = r"""
WITH w AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
f AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3]) AS m)
  WHERE i + m - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
              JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE m = 3),
o AS (SELECT lang, phrase, max(a) AS longer FROM g GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score::BIGINT AS score
FROM b JOIN n USING (lang) LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a
QUALIFY rank <= 2000
"""


@query("op12_phrase_collocations", PHRASE_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


#: Brute force; the index answers as exactly while a table has fewer than ann.AT_LEAST vectors, beyond that it may miss some.
NEAREST_SQL = r"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS l FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]), lambda a, b: a + b) / (q.l * c.l) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


@query("op13_nearest_vectors", NEAREST_SQL)
def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.MultiIndex(rows, count=5).search(rows.filter("vec_id % 50 = 0"))
