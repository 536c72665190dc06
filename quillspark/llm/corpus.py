"""Queries of nearest vectors, splitting and near-duplicates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.words import TOKEN_RE2
from quillspark.llm.knn import neighbour_pairs, neighbours
from quillspark.llm.neardup import near_duplicates, similar_pairs
from quillspark.llm.split import oversized_ids, split_oversized
from quillspark.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(table(spark, folder, "vector_records"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(table(spark, folder, "vector_records"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return oversized_ids(table(spark, folder, "chunks"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "chunks"))


def _deduplicable(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").filter("deduplicable").select("id", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The task compares sets of sequences, so the bags have weights 1."""
    pairs = similar_pairs(_deduplicable(spark, folder), words=3, threshold=0.5, multiset=False)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_deduplicable(spark, folder)).withColumnRenamed("id", "chunk_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_neighbours, p4_found, p4_pieces, p5_found, p5_groups)}

_HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
SQL = {
    # Every pair of usable vectors, by brute force; distinct on id as rows may repeat.
    "p3_found": """
        WITH v AS (
            SELECT id, any_value(list_transform(vector, lambda x: x::DOUBLE)) AS v FROM vector_records
            WHERE len(vector) = 48 AND list_bool_and(list_transform(vector, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))
            GROUP BY id),
        s AS (SELECT a.id AS x, b.id AS y, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS r FROM v a JOIN v b ON a.id <> b.id)
        SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM s WHERE r <= 5""",
    "p4_found": f"SELECT DISTINCT id AS chunk_id FROM chunks WHERE len(regexp_extract_all(text, '{TOKEN_RE2}')) > 650",
    "p5_found": rf"""
        WITH w AS (SELECT DISTINCT id, regexp_extract_all(regexp_replace(lower(text), '([{_HAN}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') AS w FROM chunks WHERE deduplicable),
        s AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        b AS (SELECT a.id AS x, b.id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
        SELECT x AS chunk_id_a, y AS chunk_id_b FROM b JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE shared >= 0.5 * (p.n + q.n - shared)
        UNION SELECT a.id, b.id FROM w a JOIN w b ON a.w = b.w AND a.id < b.id WHERE len(a.w) BETWEEN 1 AND 2""",
    # Bags of five-word sequences, every pair that shares one, and all that is reached over pairs of 0.8 or more.
    "p5_groups": rf"""
        WITH RECURSIVE r AS (SELECT id, min(text) AS text FROM chunks WHERE deduplicable AND id IS NOT NULL GROUP BY id),
        m AS (SELECT id, CASE WHEN regexp_matches(text, '[\p{{L}}\p{{N}}]') THEN lower(text) END AS c FROM r),
        cl AS (SELECT c, min(id) AS least, count(*) AS n FROM m WHERE c IS NOT NULL GROUP BY c),
        w AS (SELECT c, regexp_extract_all(regexp_replace(c, '([{_HAN}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') AS w FROM cl),
        s AS (SELECT c, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
        k AS (SELECT c, s, count(*) AS k FROM s GROUP BY 1, 2), t AS (SELECT c, sum(k) AS t FROM k GROUP BY 1),
        p AS (SELECT a.c AS x, b.c AS y, sum(least(a.k, b.k)) AS o FROM k a JOIN k b ON a.s = b.s AND a.c < b.c GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN t u ON u.c = x JOIN t v ON v.c = y WHERE o >= 0.8 * (u.t + v.t - o)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach AS (SELECT c, c AS d FROM cl UNION SELECT reach.c, e.y FROM reach JOIN e ON reach.d = e.x),
        g AS (SELECT reach.c, min(least) AS group_id FROM reach JOIN cl ON cl.c = reach.d GROUP BY 1),
        n AS (SELECT x AS c, count(*) AS links FROM e GROUP BY 1)
        SELECT id AS chunk_id, coalesce(group_id, id) AS group_id, coalesce(links, 0) AS links, coalesce(cl.n - 1, 0) AS copies FROM m LEFT JOIN cl USING (c) LEFT JOIN g USING (c) LEFT JOIN n USING (c)""",
}
