"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callgrain.sources.tables import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.turns import clean_turns

    return clean_turns(spread(table(spark, d, "filter_transcripts")), "source_file", "original_text", "loaded_at").drop("text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.splits import cross_split_pairs

    return cross_split_pairs(spread(table(spark, d, "count_analysis")), "rec_id", "text", "split")


def p2_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.splits import overlap_report

    return overlap_report(spread(table(spark, d, "count_analysis")), "rec_id", "text", "split", "source")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.layout import content_groups

    return content_groups(spread(table(spark, d, "count_analysis")), "rec_id", "text")


def p3_letters(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.layout import letter_groups

    return letter_groups(spread(table(spark, d, "count_analysis")), "rec_id", "text")


def _pii_parts(spark: SparkSession, d: str) -> list:
    calls, files = spread(table(spark, d, "count_analysis")), spread(table(spark, d, "filter_transcripts"))
    return [("count_analysis", calls, "rec_id", "text", False), ("filter_transcripts", files, "source_file", "original_text", True)]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.identity import entities

    return entities(_pii_parts(spark, d))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.identity import redacted

    return redacted(_pii_parts(spark, d))


def p4_routes(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.identity import routes

    return routes(_pii_parts(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.neardup import near_pairs

    return near_pairs(spread(table(spark, d, "count_analysis")), "rec_id", "text")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.neardup import near_groups

    return near_groups(spread(table(spark, d, "count_analysis")), "rec_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.consensus import contested

    return contested(table(spark, d, "compute_annotation_metrics"), table(spark, d, "annotator_sheets"))


def p6_annotators(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.consensus import answers, reliabilities

    return reliabilities(answers(table(spark, d, "compute_annotation_metrics"), table(spark, d, "annotator_sheets")))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.consensus import consensus

    return consensus(table(spark, d, "compute_annotation_metrics"), table(spark, d, "annotator_sheets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.language import language_cases

    return language_cases(spread(table(spark, d, "count_analysis")), "rec_id", "text", "lang")


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.language import segments

    return segments(spread(table(spark, d, "count_analysis")), "rec_id", "text", "lang")


def p7_parts(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.language import parts

    return parts(spread(table(spark, d, "count_analysis")), "rec_id", "text", "lang")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.encode import encode_corpus

    return encode_corpus(spread(table(spark, d, "documents")), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.leakage import leaks

    return leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.leakage import leak_report

    return leak_report(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.leakage import without_leaks

    return without_leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items")).select("doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.residue import residue

    return residue(spread(table(spark, d, "documents")), "doc_id", "text", "source").select("doc_id")


def p10_messages(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.residue import messages

    return messages(spread(table(spark, d, "documents")), "doc_id", "text", "source")


def p10_routes(spark: SparkSession, d: str) -> DataFrame:
    from callgrain.llm.residue import routes

    return routes(spread(table(spark, d, "documents")), "doc_id", "text", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


_WINDOWS = "unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' ')))"
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
P9_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items
 UNION ALL SELECT item_id, {_WORDS.format("regexp_replace(text, '(?im)^[^a-z0-9]*(caller|receiver)[ ]*:', '', 'g')")} FROM eval_items),
 x AS (SELECT doc_id, {_WINDOWS} AS g FROM d WHERE len(w) >= 12), y AS (SELECT DISTINCT item_id, {_WINDOWS} AS g FROM i WHERE len(w) >= 12) SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)"""


P9_CLEAN_SQL = f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({P9_SQL}))"
P3_LETTERS_SQL = r"""SELECT min(rec_id) AS keep_id, count(*) AS n_copies FROM (SELECT rec_id, regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]|[\x{FE00}-\x{FE0F}]', '', 'g') AS k FROM count_analysis WHERE text IS NOT NULL)
 WHERE k <> '' GROUP BY k HAVING count(*) > 1"""


def oracle_sql() -> dict[str, str]:
    """The other queries aren't expressible in SQL, or take it too long on whole tables; brute force in tests holds them."""
    return {"p9_found": P9_SQL, "p9_clean": P9_CLEAN_SQL, "p3_letters": P3_LETTERS_SQL}
