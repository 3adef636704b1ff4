"""Similarity queries: TF-IDF terms, near pairs, clusters, nearest vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions import text as T
from callgrain.operators import similarity as S
from callgrain.plans.registry import query
from callgrain.sources.tables import table


def _items(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "eval_items").where("text IS NOT NULL").select(F.col("item_id").alias("id"), T.tokens(F.col("text")).alias("tok"))
    return t.select("id", F.explode(S.word_grams(F.col("tok"), 2)).alias("term"))


_TOK = "regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)?')"
_VEC = f"""WITH t AS (SELECT item_id AS id, {_TOK} AS tok FROM eval_items WHERE text IS NOT NULL), g AS (SELECT id, unnest(list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS term FROM t),
 f AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS n FROM g), df AS (SELECT term, count(*) AS df FROM f GROUP BY term HAVING count(*) >= 2), r AS (SELECT id, term, df, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS v FROM f JOIN df USING (term), n),
 l AS (SELECT id, sqrt(sum(v * v)) AS norm FROM r GROUP BY id), v AS (SELECT id, term, df, v / norm AS w FROM r JOIN l USING (id)), p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM v a JOIN v b USING (term) WHERE a.id < b.id GROUP BY ALL)"""


@query(_VEC + " SELECT id, term, df, round(w, 6) AS w FROM v")
def tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    return S.tfidf(_items(spark, d)).select("id", "term", "df", F.round("w", 6).alias("w"))


@query(_VEC + " SELECT a, b, round(cosine, 6) AS cosine FROM p WHERE cosine >= 0.5")
def cosine_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.cosine_pairs(S.tfidf(_items(spark, d)), 0.5, rare=12).select("a", "b", F.round("cosine", 6).alias("cosine"))


_CLUST = _VEC.replace("WITH t AS", "WITH RECURSIVE t AS") + """, e AS (SELECT a, b FROM p WHERE cosine >= 0.5 UNION SELECT b, a FROM p WHERE cosine >= 0.5), c(node, lab) AS (SELECT a, a FROM e UNION SELECT e.b, c.lab FROM c JOIN e ON c.node = e.a)"""


@query(_CLUST + " SELECT component, count(*) AS size, array_to_string(list_sort(list(node)), '|') AS members FROM (SELECT node, min(lab) AS component FROM c GROUP BY node) GROUP BY component")
def near_clusters(spark: SparkSession, d: str) -> DataFrame:
    pairs = S.cosine_pairs(S.tfidf(_items(spark, d)), 0.5, rare=12)
    c = S.components(pairs.select("a", "b"))
    return c.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), "|").alias("members"))


@query("WITH g AS (SELECT doc_id AS id, lower(regexp_replace(left(text, 10000000), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT id, unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) AS gram FROM g WHERE length(t) >= 3) SELECT gram, count(*) AS n, count(DISTINCT id) AS df FROM x GROUP BY gram HAVING count(DISTINCT id) >= 2")
def char_gram_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Character trigrams of all documents with their counts."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    g = t.select(F.col("doc_id").alias("id"), F.explode(S.char_grams(F.col("text"), 3, 3)).alias("gram"))
    per = g.groupBy("gram", "id").agg(F.count("*").alias("c"))
    return per.groupBy("gram").agg(F.sum("c").alias("n"), F.count("*").alias("df")).where("df >= 2")


@query("WITH q AS (SELECT vec_id AS a, embedding AS x FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT a, e.vec_id AS b, list_cosine_similarity(x::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM q, embeddings e WHERE e.vec_id <> a), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS place FROM s) SELECT a, b, round(c, 6) AS cosine, place FROM k WHERE place <= 5")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20, among all, searched in blocks.

    The queries are sent to all tasks in blocks; each task keeps its best five per query, and only those are merged.
    """
    import numpy as np
    import pyarrow as pa

    e = table(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding")
    best = None
    for block in _blocks(e.where("vec_id % 20 = 0"), 20_000):
        ids = np.array([r.vec_id for r in block], np.int64)
        q = np.array([r.embedding for r in block], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

        def search(batches, ids=ids, q=q):
            for batch in batches:
                own = batch.column(0).to_numpy()
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                s = np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T, 6)
                s[ids[:, None] == own[None, :]] = -2
                top = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :5]
                a = np.repeat(ids, top.shape[1])
                c = np.take_along_axis(s, top, 1).ravel()
                keep = c > -2
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(own[top].ravel()[keep]), pa.array(c[keep])], ["a", "b", "cosine"])

        found = e.mapInArrow(search, "a bigint, b bigint, cosine double")
        best = found if best is None else best.union(found)
    if best is None:
        return spark.createDataFrame([], "a bigint, b bigint, cosine double, place bigint")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return best.withColumn("place", place.cast("bigint")).where("place <= 5")


def _blocks(rows: DataFrame, size: int):
    """Rows in lists of at most `size`, one list at a time in the driver."""
    held = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
