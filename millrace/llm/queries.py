"""The registered queries of the training-data operators, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mixture_rates

    return mixture_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.fingerprints import fingerprint_with_edits

    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.warc import page_digests, round_trip

    return page_digests(round_trip(table(spark, sf_dir, "pages")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.chat import format_conversations

    return format_conversations(table(spark, sf_dir, "conversations"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.media import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from millrace.llm.negatives import hard_negatives

    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").where(finite).select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.leaks import find_leaks, leak_digest

    return leak_digest(find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_fingerprints, op2_warc, op3_mixing, op4_suffix_dedup, op5_packing, op6_toxicity, op7_chat, op8_line_dedup, op9_near_duplicates, op10_media, op11_collocations, op12_hard_negatives, op13_decontaminate)
    return {f.__name__: f for f in named}


#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), q AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
        FROM q
    """,
    "op7_chat": """
        WITH t AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations
        ), p AS (
            SELECT conv_id, i, string_agg(md5(role || chr(0) || text), '' ORDER BY i) OVER (PARTITION BY conv_id ORDER BY i) AS h,
                count(*) OVER (PARTITION BY conv_id) AS n
            FROM t
        ), ends AS (SELECT h, min(conv_id) AS conv_id, count(*) AS copies, min(n) AS n_turns FROM p WHERE i = n GROUP BY h),
        kept AS (SELECT * FROM ends WHERE h NOT IN (SELECT h FROM p WHERE i < n))
        SELECT conv_id, n_turns, copies, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) AS text
        FROM kept JOIN t USING (conv_id) GROUP BY conv_id, n_turns, copies
    """,
    "op9_near_duplicates": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
            FROM w
        ), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
        e AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
        ), r AS (
            SELECT doc_id AS id, doc_id AS reach FROM s
            UNION
            SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a
        ), c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM s JOIN c ON s.doc_id = c.id
    """,
    "op11_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
            FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces
        ), runs AS (
            SELECT lang, m, array_to_string(w[j:j + m - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS j FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m))
        ), f AS (
            SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30
        ), totals AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
        ), c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1),
        cuts AS (
            SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, m)) AS k FROM c) AS c
            JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
        ), inner_parts AS (
            SELECT lang, phrase, max(longer) AS longer
            FROM (
                SELECT lang, a AS longer, array_to_string(w[j:j + s - 1], ' ') AS phrase
                FROM (SELECT *, unnest(range(1, m - s + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS s FROM c WHERE m > 2))
            ) GROUP BY ALL
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
        FROM cuts LEFT JOIN inner_parts USING (lang, phrase) JOIN totals USING (lang)
        WHERE longer IS NULL OR 100 * longer < 80 * a
        QUALIFY rank <= 2000
    """,
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
            FROM e AS a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id
        ), positives AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
            other AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5
    """,
    "op13_decontaminate": """
        WITH i AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark
        ), d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS s
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0))
        ), runs AS (
            SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS s
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM d CROSS JOIN (SELECT DISTINCT n FROM windows))
        ), found AS (
            SELECT doc_id, item_id, j, n FROM runs JOIN windows USING (n, s)
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM found) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
}
