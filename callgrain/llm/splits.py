"""The same or nearly the same text in several splits (problem 2), by lists of parts and parity bit fingerprints.

Bags of words that stand in train and bags that stand in another split meet in lists (`bags.lists`), which no pair that
overlaps by 0.8 escapes; parity fingerprints filter what meets, and whole bags decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm import bags, layout
from callgrain.llm import textcodes as tc
from callgrain.session import cut

THRESHOLD = 0.8
TRAIN = "train"

#: Digests of rows, and partial counts of elements in rows of their own.
SCHEMA = "row_id bigint, seq binary, root binary, bag binary, element bigint, n bigint"


def digester(batches):
    """SCHEMA of batches of (row_id, text), in one pass over the words."""
    counts = bags.Counts()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def counted(element: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(n), t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(element), pa.array(n)], names)

    for batch in batches:
        seen: set[int] = set()
        for first, part in tc.chunks(batch.column(1).to_pylist()):
            words = tc.words_of(part)
            seq, root = layout.digests(part, words)
            b = tc.bags_of(part, words)
            counts.add(b, len(part), seen)
            digest = np.stack([b.key_a, b.key_b], 1).tobytes()
            bag = [digest[16 * i : 16 * i + 16] if n else None for i, n in enumerate(b.size)]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(seq, pa.binary()), pa.array(root, pa.binary()), pa.array(bag, pa.binary()), none, none], names)
        if counts.full():
            yield counted(*counts.take())
    yield counted(*counts.take(last=True))


def cross_split_links(df: DataFrame, id_col: str, text_col: str, split_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train rows, other rows, links between their groups): rows have (row_id, grp); links are (train_grp, other_grp)."""
    keep = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"), F.lower(F.trim(split_col)).alias("split"))
    keep = keep.where("row_id IS NOT NULL AND text IS NOT NULL AND split <> ''")
    coded = cut(keep.select("row_id", "text").mapInArrow(digester, SCHEMA), "codes")
    common, counts, total = bags.common_elements(coded.where("element IS NOT NULL").select("element", "n"), bags.COMMON, bags.COMMON_LEAST)
    seen = coded.where("bag IS NOT NULL").drop("element", "n")
    rows = layout.classes(seen.select("row_id", "seq", "root", "bag")).join(keep.select("row_id", (F.col("split") == TRAIN).alias("is_train")), "row_id")
    sides = rows.groupBy("bag").agg(F.min("row_id").alias("bag_id"), F.max("is_train").alias("in_train"), F.max(~F.col("is_train")).alias("in_other"))
    sides = cut(sides, "sides")
    rows = cut(rows.join(sides.select("bag", "bag_id"), "bag").select("row_id", "bag_id", "cls", "is_train"), "rows")
    texts = keep.select("row_id", "text")
    share = counts / max(total, 1)
    a, b = (bags.lists(texts, sides.where(x), common, share) for x in ("in_train", "in_other"))
    pairs = cut(bags.meetings(a, b), "candidates")
    pairs = cut(bags.verified(pairs, texts, THRESHOLD), "pairs")
    # groups: rows of one bag and content class
    groups = rows.groupBy("bag_id", "cls").agg(F.min("row_id").alias("grp"))
    members = rows.join(groups, ["bag_id", "cls"]).select("row_id", "grp", "is_train").distinct()
    t = groups.select(F.col("bag_id").alias("a"), F.col("cls").alias("ca"), F.col("grp").alias("train_grp"))
    o = groups.select(F.col("bag_id").alias("b"), F.col("cls").alias("cb"), F.col("grp").alias("other_grp"))
    near = pairs.join(t, "a").join(o, "b").select("train_grp", "other_grp")
    same_bag = t.join(o, F.col("a") == F.col("b")).select("train_grp", "other_grp")
    same_class = t.join(o, F.col("ca") == F.col("cb")).select("train_grp", "other_grp")
    links = near.union(same_bag).union(same_class).distinct()
    return members.where("is_train").select("row_id", "grp"), members.where("NOT is_train").select("row_id", "grp"), links


def cross_split_pairs(df: DataFrame, id_col: str, text_col: str, split_col: str) -> DataFrame:
    """(rec_id_a, rec_id_b), a < b, of all pairs of a train row and a row of another split with the same content or an
    overlap of 0.8 and more. Rows without split or id and blank texts are in no pair."""
    train, other, links = cross_split_links(df, id_col, text_col, split_col)
    x = train.select(F.col("row_id").alias("x"), F.col("grp").alias("train_grp"))
    y = other.select(F.col("row_id").alias("y"), F.col("grp").alias("other_grp"))
    return links.join(x, "train_grp").join(y, "other_grp").where("x <> y").select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b")).distinct()


def overlap_report(df: DataFrame, id_col: str, text_col: str, split_col: str, source_col: str) -> DataFrame:
    """Per split and source of the held-out rows: how many rows have a partner in train, and how many pairs there are."""
    train, other, links = cross_split_links(df, id_col, text_col, split_col)
    partners = links.join(train.groupBy(F.col("grp").alias("train_grp")).agg(F.count("*").alias("n")), "train_grp").groupBy("other_grp").agg(F.sum("n").alias("n"))
    told = other.join(partners, F.col("grp") == F.col("other_grp")).select("row_id", "n")
    where = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(split_col).alias("split"), F.col(source_col).alias("source"))
    return where.join(told, "row_id").groupBy("split", "source").agg(F.count("*").alias("rows"), F.sum("n").cast("bigint").alias("pairs"))
