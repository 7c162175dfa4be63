"""One query for each operator over its whole table, and the SQL of those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat, darts, gam, hamming, leaks, lengths, masked, phrases, pieces, pii, ranked, repeats, trie
from gridloom.llm.links import Kept

PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    counts = masked.count(docs, Kept(spark))
    return masked.score(docs, masked.train(docs, counts=counts), counts=counts)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_documents(spark, sf_dir))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("text")
    return lengths.histogram(lengths.count(docs, tokenizer(RANKS), public_tokenizers.PATTERN))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_documents(spark, sf_dir), tokenizer(PIECES))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return darts.classes(_documents(spark, sf_dir))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(_documents(spark, sf_dir))


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 10)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = gam.score(docs, gam.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (gam.remainder() == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.build(_documents(spark, sf_dir)), _table(spark, sf_dir, "benchmark"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.classes(_documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


_CHAT = """
WITH plain AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM plain WHERE speaker <> 'system'),
seen AS (
  SELECT conv_id, perspective, turn, speaker, text, speaker = perspective AS trained,
    '<|start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS opening
  FROM plain JOIN people ON conv_id IS NOT DISTINCT FROM c),
placed AS (
  SELECT *, opening || text || '<|end|>' || chr(10) AS segment,
    coalesce(sum(length(opening) + length(text) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment_start
  FROM seen)
SELECT conv_id, perspective, turn, speaker, segment, segment_start, segment_start + length(opening) AS content_start,
  segment_start + length(segment) - 8 AS content_end, trained FROM placed
"""

_REPEATS = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM split, unnest(range(1, len(w) - 11)) t(i) WHERE len(w) >= 13),
least AS (SELECT g, min(doc_id) AS m FROM windows GROUP BY g),
lost AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN least USING (g), unnest(range(0, 13)) t(k) WHERE doc_id > m),
words AS (SELECT doc_id, p, w[p] AS word FROM split, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM words WHERE NOT EXISTS (SELECT 1 FROM lost WHERE lost.doc_id = words.doc_id AND lost.p = words.p) GROUP BY doc_id)
SELECT split.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

_HAMMING = """
WITH bits AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, list_sum(list_transform(list_zip(q.b, v.b), lambda p: xor(p[1], p[2])))::INTEGER AS distance
  FROM bits q JOIN bits v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""

_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) t(i)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM b, unnest(range(1, len(w) - 3)) t(i)),
sizes AS (SELECT item_id, count(*)::INTEGER AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*)::INTEGER AS n_found, count(*) / n_shingles::DOUBLE AS containment
FROM ds JOIN bs USING (g) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""

_RANKED = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT r, doc_id, len(w)::HUGEINT AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS terms FROM sizes),
strata AS (SELECT r, doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM sizes, total),
freq AS (SELECT r, t, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS weight FROM freq, total GROUP BY t, docs),
asked AS (SELECT item_id, t, count(*)::HUGEINT AS c FROM (SELECT item_id, unnest(w) AS t FROM b) GROUP BY item_id, t),
scores AS (
  SELECT item_id, r, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN freq USING (t) JOIN strata USING (r) GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
leads AS (
  SELECT r, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
grams AS (
  SELECT DISTINCT r, concat_ws(' ', w1, w2, w3, w4, w5) AS g FROM leads WHERE w5 IS NOT NULL
  UNION SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, linked.b FROM reach JOIN linked ON linked.a = reach.b)
SELECT x.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(y.doc_id) AS component_id
FROM reach JOIN d x ON x.r = reach.a JOIN d y ON y.r = reach.b LEFT JOIN sizes ON sizes.r = reach.a GROUP BY reach.a, x.doc_id, n
"""

_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
split AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
leads AS (
  SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, [w1] AS p FROM leads UNION ALL SELECT lang, [w1, w2] FROM leads WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3] FROM leads WHERE w3 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3, w4] FROM leads WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, p, count(*)::HUGEINT AS f FROM grams GROUP BY lang, p),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang),
cand AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1 AND f >= 30),
parts AS MATERIALIZED (SELECT lang, p, a, k, p[1:k] AS x, p[k + 1:] AS y FROM cand, unnest([1, 2, 3]) t(k) WHERE k < len(p)),
cuts AS (
  SELECT parts.lang, parts.p, a, k, l.f AS l, r.f AS r, (2000000 * a) // (l.f + r.f) AS score
  FROM parts JOIN f l ON [parts.lang] || parts.x = [l.lang] || l.p JOIN f r ON [parts.lang] || parts.y = [r.lang] || r.p),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, p[i:i + k - 1] AS p, max(a) AS longer FROM cand, unnest(range(2, 4)) x(k), unnest(range(1, 4)) y(i)
  WHERE k < len(p) AND i + k - 1 <= len(p) GROUP BY 1, 2),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase,
    a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, score::BIGINT AS score
  FROM best LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def queries() -> dict:
    own = (op1_pseudo_likelihood, op2_pii, op3_chat_rotation, op4_token_counts, op5_sentencepiece, op6_near_duplicates, op7_repeated_passages,
           op8_hamming_topk, op9_decontamination, op10_quality, op11_ranked_search, op12_ngram_join, op13_collocations)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_rotation": _CHAT, "op7_repeated_passages": _REPEATS, "op8_hamming_topk": _HAMMING, "op9_decontamination": _LEAKS,
            "op11_ranked_search": _RANKED, "op12_ngram_join": _JOIN, "op13_collocations": _PHRASES}
