"""Near-duplicate records with small edits (problem 5), by inverted lists, parity codes and exact overlap.

The elements of a text are its words, repeated words counted as often as they occur, each hashed once. Texts meet in
lists of their rare elements and of equal parts of their common ones (`bags.lists`), which no pair that overlaps by
THRESHOLD escapes; exact overlap of the whole bags decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm import bags, layout
from callgrain.llm.splits import SCHEMA, digester
from callgrain.operators.similarity import components
from callgrain.session import cut

THRESHOLD = 0.8
#: Share of bags above which an element is common here: more entries in lists than at `bags.COMMON`, half the pairs.
COMMON = 1 / 400


def near_bags(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, bag_id, cls), and pairs (a, b) of bag ids that overlap by THRESHOLD and more."""
    texts = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text")).where("row_id IS NOT NULL AND text IS NOT NULL")
    coded = cut(texts.mapInArrow(digester, SCHEMA), "digests")
    common, counts, total = bags.common_elements(coded.where("element IS NOT NULL").select("element", "n"), COMMON, bags.COMMON_LEAST)
    seen = coded.where("bag IS NOT NULL").drop("element", "n")
    ids = seen.groupBy("bag").agg(F.min("row_id").alias("bag_id"))
    lists = bags.lists(texts, ids.select("bag_id"), common, counts / max(total, 1))
    pairs = cut(bags.own_meetings(lists), "candidates")
    pairs = cut(bags.verified(pairs, texts, THRESHOLD), "pairs")
    rows = layout.classes(seen.select("row_id", "seq", "root", "bag")).join(ids, "bag").select("row_id", "bag_id", "cls")
    return cut(rows, "rows"), pairs


def near_links(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, node) and links (node_a, node_b): all rows of the one are near all rows of the other."""
    rows, pairs = near_bags(df, id_col, text_col)
    nodes = rows.groupBy("bag_id", "cls").agg(F.min("row_id").alias("node"))
    a = nodes.select(F.col("bag_id").alias("a"), F.col("cls").alias("ca"), F.col("node").alias("node_a"))
    b = nodes.select(F.col("bag_id").alias("b"), F.col("cls").alias("cb"), F.col("node").alias("node_b"))
    several = nodes.groupBy("bag_id").count().where("count > 1").select(F.col("bag_id").alias("a"))
    same = a.join(several, "a", "left_semi").join(b, F.col("a") == F.col("b")).where("node_a < node_b")
    near = pairs.join(a, "a").join(b, "b").where("ca <> cb")
    links = near.select("node_a", "node_b").union(same.select("node_a", "node_b")).distinct()
    return rows.join(nodes, ["bag_id", "cls"]).select("row_id", "node").distinct(), links


def near_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rec_id, group_id, n_links) of all rows that stand in a pair: the smallest rec_id of the group that the pairs
    form, directly or over others, and the number of pairs of the row."""
    members, links = near_links(df, id_col, text_col)
    members, links = cut(members, "members"), cut(links, "links")
    sizes = members.groupBy("node").agg(F.count("*").alias("n"))
    both = links.union(links.select("node_b", "node_a"))
    n_links = both.join(sizes, F.col("node_b") == F.col("node")).groupBy(F.col("node_a").alias("node")).agg(F.sum("n").cast("bigint").alias("n_links"))
    found = components(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    told = members.join(n_links, "node").join(found, "node")
    return told.select(F.col("row_id").alias("rec_id"), F.col("component").alias("group_id"), "n_links")


def near_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rec_id_a, rec_id_b) of all pairs of rows whose words overlap by 0.8 and more and whose content isn't the same.

    Null and blank texts and rows with a null id are in no pair; rows that share an id are one row.
    """
    members, links = near_links(df, id_col, text_col)
    left = members.select(F.col("node").alias("node_a"), F.col("row_id").alias("x"))
    right = members.select(F.col("node").alias("node_b"), F.col("row_id").alias("y"))
    return links.join(left, "node_a").join(right, "node_b").where("x <> y").select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b")).distinct()
