"""Consensus of several annotators' labels (problem 6), by the triplet moment method.

Answers are normalised to the classes of the taxonomy. How often two annotators agree on the items both answered,
corrected for chance, is the product of their two reliabilities; so that of three annotators' pairwise agreements each
one's reliability can be solved: q_i^2 = k_ij k_ik / k_jk. An annotator's estimate is the weighted median over all
triplets with two others; all of them count, and their work is spread over the executors.
Votes then count by their log-odds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.session import cut

#: Words by which an answer in own wording names a class, in the order in which they are tried. Fixed values.
KEYWORDS = {
    1: ("bank", "kyc", "otp"),
    2: ("upi", "wallet"),
    3: ("invest", "task"),
    4: ("digital", "arrest", "govern", "govt"),
    5: ("loan", "credit"),
    6: ("delivery", "customer care", "customer-care", "customer_care", "care"),
    7: ("dating", "romance", "extortion"),
    8: ("telecom", "legacy"),
}
#: If set, how many annotators, those who answered most, stand as partners in the triplets of all; None takes all.
PARTNERS: int | None = None
#: Fewest items in common.
LEAST_COMMON = 10
#: Classes that an answer may name.
CLASSES = 8


def class_no(answer: Column) -> Column:
    """1 to 8, or null for an answer that names none of the classes."""
    low = F.lower(F.trim(F.regexp_replace(answer, r"\s+", " ")))
    out = F.when(low.isNull() | low.rlike(r"^(?:no|not)\b"), F.lit(None).cast("int"))
    out = out.when(low.rlike(r"^[1-8](?!\d)\b"), F.substring(low, 1, 1).cast("int")).when(low.rlike(r"^\d"), F.lit(None).cast("int"))
    for k, words in KEYWORDS.items():
        out = out.when(F.greatest(*[low.contains(w) for w in words], F.lit(False)), F.lit(k))
    return out


def answers(first_two: DataFrame, sheets: DataFrame) -> DataFrame:
    """(blind_id, annotator, class_no): one answer per item and annotator that names a class.

    Of several answers by one annotator to an item the latest counts, of equally late ones the alphabetically last;
    an answer that names no class doesn't count, nor does it bring back an earlier one. Null ids and annotators have none.
    """
    one = first_two.select("blind_id", F.lit("annotator 1").alias("annotator"), F.col("a1_cat").alias("category"), F.lit(None).cast("timestamp").alias("at"))
    two = first_two.select("blind_id", F.lit("annotator 2").alias("annotator"), F.col("a2_cat").alias("category"), F.lit(None).cast("timestamp").alias("at"))
    more = sheets.select("blind_id", F.col("annotator"), "category", F.col("submitted_at").cast("timestamp").alias("at"))
    rows = one.unionByName(two).unionByName(more).where("blind_id IS NOT NULL AND annotator IS NOT NULL")
    last = F.max(F.struct(F.coalesce("at", F.lit("1900-01-01").cast("timestamp")).alias("at"), F.col("category"))).alias("last")
    return rows.groupBy("blind_id", "annotator").agg(last).select("blind_id", "annotator", class_no(F.col("last.category")).alias("class_no")).where("class_no IS NOT NULL")


def agreements(given: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """(a, b, n, agree): of each annotator a and each other annotator b, if given among the partners (annotator), items in
    common and equal answers."""
    a = given.select("blind_id", F.col("annotator").alias("a"), F.col("class_no").alias("ca"))
    b = (given if partners is None else given.join(F.broadcast(partners.select("annotator")), "annotator")).select("blind_id", F.col("annotator").alias("b"), F.col("class_no").alias("cb"))
    both = a.join(b, "blind_id").where("a <> b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum((F.col("ca") == F.col("cb")).cast("bigint")).alias("agree"))


def kappas(pairs: DataFrame, shares: DataFrame) -> DataFrame:
    """(a, b, n, kappa) of pairs with LEAST_COMMON items and more; shares: (annotator, share of each class)."""
    x, y = shares.select(F.col("annotator").alias("a"), F.col("share").alias("sa")), shares.select(F.col("annotator").alias("b"), F.col("share").alias("sb"))
    chance = F.aggregate(F.arrays_zip("sa", "sb"), F.lit(0.0), lambda acc, z: acc + z["sa"] * z["sb"])
    k = (F.col("agree") / F.col("n") - chance) / F.greatest(1 - chance, F.lit(1e-9))
    return pairs.where(F.col("n") >= LEAST_COMMON).join(x, "a").join(y, "b").select("a", "b", "n", F.greatest(k, F.lit(0.01)).alias("kappa"))


def medians(pairs: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """(annotator, median): the weighted median of q^2 over all triplets of an annotator and two others who share items."""
    among = pairs.where("a < b").select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("nbc"), F.col("kappa").alias("kbc"))
    if partners is not None:
        among = among.join(F.broadcast(partners.select(F.col("annotator").alias("b"))), "b")
    x = pairs.select("a", "b", F.col("n").alias("nb"), F.col("kappa").alias("kb"))
    y = pairs.select("a", F.col("b").alias("c"), F.col("n").alias("nc"), F.col("kappa").alias("kc"))
    value = F.least(F.greatest(F.col("kb") * F.col("kc") / F.col("kbc"), F.lit(1e-4)), F.lit(1.0))
    found = x.join(y, "a").where("b < c").join(among, ["b", "c"]).groupBy("a", value.alias("value")).agg(F.sum(F.least("nb", "nc", "nbc")).alias("w"))
    whole = Window.partitionBy("a")
    upto = F.sum("w").over(whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    told = found.select("a", "value", upto.alias("upto"), F.sum("w").over(whole).alias("total"))
    return told.where("2 * upto >= total").groupBy(F.col("a").alias("annotator")).agg(F.min("value").alias("median"))


def reliabilities(given: DataFrame) -> DataFrame:
    """(annotator, n_answers, accuracy, weight): the reliability of each annotator and what a vote of theirs counts."""
    counts = given.groupBy("annotator").agg(F.count("*").alias("n_answers"), *(F.sum((F.col("class_no") == c).cast("int")).alias(f"c{c}") for c in range(1, 9)))
    counts = cut(counts.select("annotator", "n_answers", F.array(*(F.col(f"c{c}") / F.col("n_answers") for c in range(1, 9))).alias("share")), "annotators")
    partners = cut(counts.orderBy(F.desc("n_answers"), "annotator").limit(PARTNERS), "partners") if PARTNERS else None
    pairs = cut(kappas(agreements(given, partners), counts.select("annotator", "share")), "agreements")
    mean = pairs.groupBy(F.col("a").alias("annotator")).agg(F.avg("kappa").alias("mean"))
    # without a triplet the mean agreement with whomever there is, or an even guess
    q = F.coalesce(F.sqrt("median"), F.sqrt("mean"), F.lit(0.5))
    p = F.least(F.greatest((q * (CLASSES - 1) + 1) / CLASSES, F.lit(1 / CLASSES + 0.01)), F.lit(0.995))
    each = counts.join(medians(pairs, partners), "annotator", "left").join(mean, "annotator", "left").select("annotator", "n_answers", p.alias("accuracy"))
    return each.withColumn("weight", F.log(F.col("accuracy") * (CLASSES - 1) / (1 - F.col("accuracy"))))


def consensus(first_two: DataFrame, sheets: DataFrame) -> DataFrame:
    """(blind_id, class_no, n_answers, n_classes, agreement, confidence) of every item with an answer.

    The class is the one with the largest sum of weights; of equal ones the one named more often in all, then the
    smaller number. agreement is the share of pairs of answers that are equal, null for a single answer.
    """
    given = cut(answers(first_two, sheets), "answers")
    weights = cut(reliabilities(given), "weights")
    often = F.broadcast(given.groupBy("class_no").agg(F.count("*").alias("often")))  # eight rows
    votes = given.join(weights, "annotator").groupBy("blind_id", "class_no").agg(F.sum("weight").alias("support"), F.count("*").alias("n"))
    votes = votes.join(often, "class_no")
    best = votes.groupBy("blind_id").agg(
        F.max(F.struct(F.round("support", 9).alias("support"), "often", (-F.col("class_no")).alias("c"))).alias("best"),
        F.sum("n").alias("n_answers"),
        F.count("*").alias("n_classes"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("same"),
        F.collect_list("support").alias("all"),
    )
    soft = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("best.support")))
    return best.select("blind_id", (-F.col("best.c")).alias("class_no"), "n_answers", "n_classes", F.try_divide(F.col("same"), F.col("n_answers") * (F.col("n_answers") - 1)).alias("agreement"), (F.lit(1.0) / soft).alias("confidence"))


def contested(first_two: DataFrame, sheets: DataFrame) -> DataFrame:
    """(blind_id, class_no) of items whose answers name two or more classes."""
    return consensus(first_two, sheets).where("n_classes >= 2").select("blind_id", F.col("class_no").cast("int").alias("class_no"))
