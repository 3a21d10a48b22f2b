"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wegloom.llm import collocations, common, fingerprints, media, minhash, packing, periodic, ppm, quality, sentencepiece_codec, sharding, simhash, substring_dedup, warc


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(common.documents(spark, sf_dir))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(common.documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.documents(spark, sf_dir), like=85)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(common.documents(spark, sf_dir))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(common.documents(spark, sf_dir))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(common.documents(spark, sf_dir))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs(periodic.with_planted_runs(common.documents(spark, sf_dir)))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_sharding, op3_substring, op4_warc, op5_packing, op6_quality, op7_minhash, op8_fingerprints, op9_media, op10_ppm, op11_periodic, op12_simhash, op13_collocations)}

#: Windows of 13 words as strings; a word goes if one of the windows that cover it also starts in an earlier document.
_OP3 = r"""WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM documents WHERE text IS NOT NULL
), windows AS (
    SELECT doc_id, i, w, string_agg(w, ' ') OVER ahead AS s, count(*) OVER ahead AS n FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), firsts AS (SELECT s, min(doc_id) AS first FROM windows WHERE n = 13 GROUP BY s),
judged AS (SELECT doc_id, i, w, n = 13 AND f.first < doc_id AS repeated FROM windows LEFT JOIN firsts f USING (s)),
covered AS (SELECT doc_id, i, w, coalesce(bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM judged),
cut AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN cut USING (doc_id)"""

_OP4 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM p LEFT JOIN firsts USING (html)"""

#: Full sets of shingles, their intersections by a join on the shingles, and components by walking all links.
_OP7 = r"""WITH RECURSIVE listed AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL
), words AS (SELECT doc_id, len(ws) AS total, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed),
runs AS (
    SELECT doc_id, total, string_agg(w, ' ') OVER ahead AS s, count(*) OVER ahead AS n FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), shingles AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM runs WHERE n = least(total, 5)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
arcs AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM arcs UNION SELECT r.node, arcs.b FROM reach r JOIN arcs ON r.seen = arcs.a),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON node = d.doc_id"""

#: Phrases by windows of up to five words; an as frequent longer one need only be looked for among those of a word more.
_OP13 = r"""WITH cut AS (
    SELECT doc_id, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents
), pieces AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM cut),
distinct_pieces AS (SELECT lang, ws, count(*) AS weight FROM pieces WHERE len(ws) > 0 GROUP BY ALL),
total AS (SELECT lang, sum(len(ws) * weight)::HUGEINT AS n FROM distinct_pieces GROUP BY lang),
grams AS (
    SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS gram, weight
    FROM (SELECT lang, ws, weight, k, unnest(range(1, len(ws) - k + 2)) AS i FROM distinct_pieces, (VALUES (1), (2), (3), (4), (5)) AS t(k))
), counts AS MATERIALIZED (SELECT lang, k, gram, sum(weight)::HUGEINT AS f FROM grams GROUP BY ALL HAVING sum(weight) >= 100),
cuts AS (
    SELECT lang, k, gram AS phrase, f AS a, c, array_to_string(string_split(gram, ' ')[1 : c], ' ') AS head, array_to_string(string_split(gram, ' ')[c + 1 :], ' ') AS tail
    FROM (SELECT *, unnest(range(1, k)) AS c FROM counts WHERE k > 1)
), judged AS (
    SELECT c.lang, c.k, phrase, a, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score, row_number() OVER (PARTITION BY c.lang, phrase ORDER BY 1000 * a * n // (x.f * y.f), c) AS i
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.gram = head JOIN counts y ON y.lang = c.lang AND y.gram = tail JOIN total t ON t.lang = c.lang
), inside AS (
    SELECT lang, unnest([array_to_string(string_split(gram, ' ')[1 : k - 1], ' '), array_to_string(string_split(gram, ' ')[2 :], ' ')]) AS phrase, f FROM counts WHERE k > 2
), around AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
standing AS (SELECT j.* FROM judged j LEFT JOIN around o ON o.lang = j.lang AND o.phrase = j.phrase WHERE i = 1 AND (o.f IS NULL OR 100 * o.f < 100 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM standing)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""

ORACLES: dict[str, str] = {"op3_substring": _OP3, "op4_warc": _OP4, "op7_minhash": _OP7, "op13_collocations": _OP13}
