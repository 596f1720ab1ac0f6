"""The queries of the operators, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("op9_minhash_neardup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def held_out(mod: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as the empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm import toxicity as tox

    docs = table(spark, sf_dir, "documents")
    model = tox.learn(docs, table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    return tox.toxicity(docs, model).withColumn("held_out", held_out(3, 1))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm import language

    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~held_out(4, 2)))
    return language.identify(docs, model).withColumn("held_out", held_out(4, 2))


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_maxent_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.maxent import score_texts

    return score_texts(table(spark, sf_dir, "documents"), ~held_out(7, 2)).withColumn("held_out", held_out(7, 2))


@query("op8_sentencepiece_nbest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.pieces import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"))


@query("op10_pii_surrogates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.pii import replace_pii

    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_entities")


@query(
    "op4_hamming_topk",
    """
    WITH v AS (
        SELECT vec_id, CAST(list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS BIT) AS code
        FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    ), p AS (
        SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, CAST(bit_count(xor(q.code, n.code)) AS INTEGER) AS distance
        FROM v q JOIN v n ON q.vec_id <> n.vec_id WHERE q.vec_id % 20 = 0
    ), r AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance FROM p
    )
    SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.llm.hamming import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def _shingles(table_name: str, key: str, k: int) -> str:
    """SQL for the distinct (id, shingle) rows of a table."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+')"
    cut = f"CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"SELECT DISTINCT {key}, s FROM (SELECT {key}, unnest({cut}) AS s FROM (SELECT {key}, {words} AS w FROM {table_name} WHERE {key} IS NOT NULL))"


ORACLES["op5_decontaminate"] = f"""
    WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE doc_id IS NOT NULL),
    own AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
    d AS ({_shingles("rows", "r", 5)}), i AS ({_shingles("own", "item_id", 5)}),
    n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
    p AS (SELECT r, item_id, count(*) AS m FROM d JOIN i USING (s) GROUP BY r, item_id),
    q AS (SELECT doc_id, item_id, max(m) AS n_shared FROM p JOIN rows USING (r) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM q JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""
ORACLES["op9_minhash_neardup"] = f"""
    WITH RECURSIVE own AS (SELECT doc_id, min(text) AS text FROM documents GROUP BY doc_id),
    d AS ({_shingles("own", "doc_id", 3)}),
    n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    link AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 85 * (a.n + b.n - m)),
    reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.y, reach.c FROM reach JOIN link ON reach.id = link.x),
    best AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
    SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
    FROM documents JOIN best ON best.id = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""
