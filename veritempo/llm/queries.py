"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritempo.llm import bit_sliced, byte_bpe, filter_audit, language_id, line_dedup, minhash, ngram_join, packing, prefix_forest, suffix_dedup, token_counts, url_filter, whitening
from veritempo.llm.common import table

#: The rules that op1 judges by: verdict, host and path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.delete_repeated_runs(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_minhash": op7_minhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_prefix_forest": op10_prefix_forest,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_ngram_join": op13_ngram_join,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_top_k": """
        WITH ok AS (
            SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id),
        sliced AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS v FROM ok)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (
            SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
                SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
                FROM sliced q JOIN sliced c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id AND len(c.v) = len(q.v)))
        WHERE rank <= 5
    """,
    # Two lines in a row that also start earlier, by plain enumeration.
    "op5_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
        numbered AS (
            SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS place FROM split),
        every AS (
            SELECT doc_id, place, parts[place] AS line, regexp_replace(parts[place], '^\s+|\s+$', '', 'g') AS bare FROM numbered),
        content AS (
            SELECT doc_id, place, bare, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS n FROM every WHERE bare != ''),
        pairs AS (
            SELECT doc_id, n, bare, lead(bare) OVER (PARTITION BY doc_id ORDER BY n) AS follower FROM content),
        starts AS (
            SELECT doc_id, n FROM (
                SELECT doc_id, n, row_number() OVER (PARTITION BY bare, follower ORDER BY doc_id, n) AS copy
                FROM pairs WHERE follower IS NOT NULL) WHERE copy > 1),
        gone AS (
            SELECT doc_id, n FROM starts UNION SELECT doc_id, n + 1 FROM starts),
        runs AS (
            SELECT doc_id, count(*) AS n_removed,
                count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM gone p WHERE p.doc_id = g.doc_id AND p.n = g.n - 1)) AS n_runs
            FROM gone g GROUP BY doc_id),
        kept AS (
            SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.place) AS kept
            FROM every e LEFT JOIN content c ON c.doc_id = e.doc_id AND c.place = e.place
            LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.n = c.n WHERE g.n IS NULL GROUP BY e.doc_id)
        SELECT s.doc_id, (SELECT count(*) FROM content c WHERE c.doc_id = s.doc_id)::INT AS n_lines,
            coalesce(r.n_removed, 0)::INT AS n_removed, coalesce(r.n_runs, 0)::INT AS n_runs,
            CASE WHEN s.text IS NULL THEN NULL ELSE sha256(coalesce(k.kept, '')) END AS kept_sha256
        FROM split s LEFT JOIN runs r ON r.doc_id = s.doc_id LEFT JOIN kept k ON k.doc_id = s.doc_id
    """,
    # Every document is followed through every order, filter by filter.
    "op12_filter_audit": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        first AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t),
        marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        flags AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                map {'A': len(words) < 200,
                     'B': 100 * len(list_distinct(words)) < 50 * len(words),
                     'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                     'D': regexp_matches(t, '[#$%&*|]'),
                     'E': coalesce(first_id < doc_id, false)} AS fails
            FROM docs JOIN first USING (t) LEFT JOIN marks USING (doc_id)),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        steps AS (SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS before FROM orders, range(1, 6) s(step)),
        groups AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
            FROM flags GROUP BY part, fails),
        marked AS (
            SELECT part, filter_order, step, f, n, n_good, n_toxic, fails[f] AS fails_here,
                step > 1 AND len(list_filter(before, lambda x: x != '' AND fails[x])) > 0 AS gone_before,
                len(list_filter(map_values(fails), lambda x: x)) = 1 AND fails[f] AS only_here
            FROM groups, steps),
        told AS (
            SELECT part, filter_order, step, any_value(f) AS f,
                sum(n) FILTER (WHERE NOT gone_before AND NOT fails_here) AS kept,
                sum(n) FILTER (WHERE NOT gone_before AND fails_here) AS removed,
                sum(n) FILTER (WHERE gone_before AND fails_here) AS redundant,
                sum(n) FILTER (WHERE only_here) AS unique_fails,
                sum(n_good) FILTER (WHERE NOT gone_before AND fails_here) AS good_lost,
                sum(n_toxic) FILTER (WHERE NOT gone_before AND fails_here) AS toxic_lost
            FROM marked GROUP BY part, filter_order, step)
        SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
            coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
            coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
        FROM told
    """,
    # All pairs that share a shingle, and all that can be reached over links.
    "op13_ngram_join": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
        reached(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reached GROUP BY x) USING (doc_id)
    """,
}
