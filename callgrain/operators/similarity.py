"""TF-IDF vectors, exact cosine joins and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.session import cut

#: Most rounds of label propagation; a round halves what is left of the paths.
MOST_ROUNDS = 60
#: Most edges whose components are found in the driver.
FEW_EDGES = 200_000


def word_grams(tokens: Column, most: int) -> Column:
    """All runs of 1 to `most` tokens."""
    grams = tokens
    for n in range(2, most + 1):
        more = F.transform(F.array(tokens), lambda s: F.when(F.size(s) >= n, _runs(s, n)).otherwise(F.array().cast("array<string>")))  # noqa: B023  tokens are evaluated once
        grams = F.concat(grams, F.flatten(more))
    return grams


def _runs(tokens: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def _substrings(t: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))


def char_grams(t: Column, least: int, most: int) -> Column:
    """All substrings of `least` to `most` characters, runs of white space being one blank."""
    t = F.regexp_replace(F.lower(t), r"\s+", " ")
    out = None
    for n in range(least, most + 1):
        g = F.flatten(F.transform(F.array(t), lambda s: F.when(F.length(s) >= n, _substrings(s, n)).otherwise(F.array().cast("array<string>"))))  # noqa: B023  t is evaluated once
        out = g if out is None else F.concat(out, g)
    return out


def tfidf(grams: DataFrame, min_df: int = 2, max_share: float = 1.0, max_terms: int | None = None, sublinear: bool = True) -> DataFrame:
    """(id, term, df, w): unit vectors of rows (id, term); idf = ln((1 + n) / (1 + df)) + 1.

    Terms in fewer than min_df documents or a larger share than max_share fall out; of the rest the max_terms most
    frequent ones stay. Documents without a term have no rows.
    """
    tf = grams.groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = grams.select("id").distinct().agg(F.count("*").alias("n_docs"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).join(F.broadcast(n))
    df = df.where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n_docs")))
    if max_terms:
        df = df.orderBy(F.desc("cf"), "term").limit(max_terms)
    df = df.select("term", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    weight = (1 + F.log("tf") if sublinear else F.col("tf")) * F.col("idf")
    raw = tf.join(df, "term").select("id", "term", "df", weight.alias("v"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", "df", (F.col("v") / F.col("norm")).alias("w"))


def cosine_pairs(vectors: DataFrame, threshold: float, rare: int) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs at or above the threshold; exact, without a dense matrix.

    Products over rare terms (df <= rare) are added up first. What the common terms can add is bounded by the lengths
    that remain; pairs whose bound falls short end there. Pairs without a common rare term can only reach the threshold
    if both have little weight on rare terms: those documents, and they alone, also meet over their common terms.
    The rest is verified over all terms.
    """
    v = cut(vectors, "vectors")
    is_rare = F.col("df") <= rare
    mass = v.groupBy("id").agg(F.coalesce(F.sum(F.when(is_rare, F.col("w") * F.col("w"))), F.lit(0.0)).alias("m"))
    r = v.where(is_rare).join(mass, "id")
    a, b = (r.select("term", F.col("id").alias(x), F.col("w").alias(f"w{x}"), F.col("m").alias(f"m{x}")) for x in ("a", "b"))
    met = a.join(b, "term").where("a < b").groupBy("a", "b", "ma", "mb").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    bound = F.col("s") + F.sqrt(F.greatest((1 - F.col("ma")) * (1 - F.col("mb")), F.lit(0.0)))
    some = met.where(bound >= threshold - 1e-9).select("a", "b")
    # a document of which the common part alone could carry a pair; among those, the rarest terms of the common part
    # that together exceed what a pair may miss must hold a shared one (prefix filter)
    low = v.join(mass.where(1 - F.col("m") >= threshold * threshold - 1e-9), "id").where(~is_rare)
    order = Window.partitionBy("id").orderBy("df", "term")
    part = low.withColumn("before", F.coalesce(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    # (1 - m) - before is what the rest of the vector can still hold; below threshold^2 no pair can be without an earlier term
    prefix = part.where(1 - F.col("m") - F.col("before") >= threshold * threshold - 1e-9).select("term", "id")
    other = prefix.select("term", F.col("id").alias("a")).join(prefix.select("term", F.col("id").alias("b")), "term").where("a < b").select("a", "b").distinct()
    pairs = some.union(other).distinct()
    wa, wb = v.select(F.col("id").alias("a"), "term", F.col("w").alias("wa")), v.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"))
    exact = pairs.join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return exact.where(F.col("cosine") >= threshold - 1e-12)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b): the least node of each component.

    Few edges are joined in the driver. More alternate large-star and small-star rounds until nothing changes; each round
    is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "edges")
    if all(kind == "bigint" for _, kind in e.dtypes) and (few := e.limit(FEW_EDGES + 1).toArrow()).num_rows <= FEW_EDGES:
        return edges.sparkSession.createDataFrame(_joined(few.column("a").to_numpy(), few.column("b").to_numpy()), "node bigint, component bigint")
    seen = None
    for _ in range(MOST_ROUNDS):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components aren't done after {MOST_ROUNDS} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.join(e.select(F.col("a").alias("node")), "node", "left_anti")).distinct()


def _joined(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(node, component) of edges (a, b)."""
    node, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    least = np.arange(len(node))
    while True:
        new = least.copy()
        low = np.minimum(least[x], least[y])
        np.minimum.at(new, least[x], low)
        np.minimum.at(new, least[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, least):
            return pa.table({"node": node, "component": node[least]})
        least = new
