"""Scalar text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns. Fixed values.
WORD_TOKEN = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)?"
ALPHA_TOKEN = r"[a-zA-Z]+"
MIXED_TOKEN = r"[\x{0900}-\x{097F}]+|[a-z0-9]+|[^\s\w]"


def text_or_empty(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def tokens(t: Column) -> Column:
    """Lower-case words, with one inner apostrophe or hyphen. Null gives none."""
    return F.regexp_extract_all(F.lower(text_or_empty(t)), F.lit(f"({WORD_TOKEN})"), F.lit(1))


def alpha_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(t)), F.lit(f"({ALPHA_TOKEN})"), F.lit(1))


def mixed_tokens(t: Column) -> Column:
    """Runs of Devanagari, runs of Latin letters and digits, single marks."""
    return F.regexp_extract_all(F.lower(text_or_empty(t)), F.lit(f"(?U)({MIXED_TOKEN})"), F.lit(1))


def fold_space(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def mask_contacts(t: Column) -> Column:
    """Lower case, with addresses of pages and long numbers masked; marks stay. The patterns are fixed values."""
    t = F.lower(t)
    t = F.regexp_replace(t, r"https?://\S+|www\.\S+", "<URL>")
    t = F.regexp_replace(t, r"\+?\d[\d\s\-()]{7,}\d", "<PHONE>")
    return fold_space(t)


def template_text(t: Column) -> Column:
    """Lower case words alone, with pages, mail, phones and numbers replaced by their kind. The patterns are fixed values."""
    t = F.lower(t)
    t = F.regexp_replace(t, r"https?://\S+|www\.\S+", " URL ")
    t = F.regexp_replace(t, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", " EMAIL ")
    t = F.regexp_replace(t, r"(?<!\d)(?:\+?\d[\d\s().-]{7,}\d)(?!\d)", " PHONE ")
    t = F.regexp_replace(t, r"(?U)(?<!\w)\d[\d,]*(?:\.\d+)?(?!\w)", " NUM ")
    return fold_space(F.regexp_replace(t, r"(?U)[^\w\s]", " "))


def digest(t: Column) -> Column:
    return F.sha2(t, 256)


def word_count(t: Column) -> Column:
    return F.regexp_count(text_or_empty(t), F.lit(r"[\p{L}\p{N}_]+")).cast("bigint")


def space_words(t: Column) -> Column:
    return F.regexp_count(text_or_empty(t), F.lit(r"\S+")).cast("bigint")


def sentence_count(t: Column) -> Column:
    parts = F.split(text_or_empty(t), r"[.!?]+")
    return F.size(F.filter(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")).cast("bigint")


def count_patterns(t: Column, patterns: list[str]) -> Column:
    """Hits of each pattern, added up; overlaps between patterns count twice. Case is ignored."""
    return sum((F.regexp_count(text_or_empty(t), F.lit(f"(?i){p}")) for p in patterns[1:]), F.regexp_count(text_or_empty(t), F.lit(f"(?i){patterns[0]}"))).cast("bigint")


def contains_any(t: Column, terms: list[str]) -> Column:
    """Whether any term stands in the text, also inside a word."""
    low = F.lower(text_or_empty(t))
    out = low.contains(terms[0])
    for x in terms[1:]:
        out = out | low.contains(x)
    return out


def count_literal(t: Column, literal: str) -> Column:
    t = text_or_empty(t)
    return ((F.length(t) - F.length(F.replace(t, F.lit(literal), F.lit("")))) / len(literal)).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def head_and_tail(t: Column, limit: int, note: int = 120) -> Column:
    """Texts over the limit keep their beginning and end around a note of how much was left out."""
    half = (limit - note) // 2
    left_out = F.format_number(F.length(t) - 2 * half, 0)
    cut = F.concat(F.substring(t, 1, half), F.lit("\n[... "), left_out, F.lit(" characters left out ...]\n"), F.right(t, F.lit(half)))
    return F.when(F.length(t) > limit, cut).otherwise(t)


def json_body(t: Column) -> Column:
    """What stands from the first to the last brace of a model's reply, fences left out; empty if there is none."""
    bare = F.regexp_replace(F.trim(t), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\})", 1)


def reply_label(t: Column, labels: list[str]) -> Column:
    """The label a model's reply names: by its JSON field, else after 'label:', else as the whole reply; null if none."""
    got = F.coalesce(
        F.get_json_object(F.when(json_body(t) != "", json_body(t)), "$.label"),
        F.when(F.regexp_extract(t, r"(?i)label\s*[:=]\s*\"?([\w-]+)", 1) != "", F.regexp_extract(t, r"(?i)label\s*[:=]\s*\"?([\w-]+)", 1)),
        F.trim(t),
    )
    return F.when(F.lower(got).isin(labels), F.lower(got))


def dialogue_or_null(t: Column) -> Column:
    """A generated dialogue from its first 'Scammer:' on with uniform labels; null below three and two turns."""
    body = F.trim(F.regexp_extract(t, r"(?is)(scammer\s*:.*)", 1))
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)\bscammer\s*:", "Scammer:"), r"(?i)\breceiver\s*:", "Receiver:")
    enough = (F.regexp_count(body, F.lit(r"(?m)^Scammer:")) >= 3) & (F.regexp_count(body, F.lit(r"(?m)^Receiver:")) >= 2)
    return F.when((body != "") & enough, body)


def parsed_reply(t: Column, labels: list[str]) -> Column:
    """A struct (label, valid, reason) of a model's reply: by its JSON field, by a quoted field in prose, or as a whole.

    A label counts in any case and is given as it stands in `labels`; one that isn't allowed is given with the reason.
    """
    bare = F.trim(F.regexp_replace(F.trim(t), r"(?is)^```(?:json)?\s*|\s*```$", ""))
    block = F.regexp_extract(t, r"(?s)(\{.*?\})", 1)
    from_json = F.coalesce(F.try_parse_json(bare).cast("string"), F.try_parse_json(F.when(block != "", block)).cast("string"))
    field = F.get_json_object(from_json, "$.label")
    quoted = F.regexp_extract(t, r"(?i)[\"']?label[\"']?\s*:\s*[\"']([^\"']+)[\"']", 1)
    told = F.coalesce(F.trim(field), F.when(quoted != "", F.trim(quoted)))
    names = F.array(*map(F.lit, labels))
    allowed = lambda x: F.get(F.filter(names, lambda n: F.lower(n) == F.lower(x)), F.lit(0))
    answer = lambda label, valid, reason: F.struct(label.cast("string").alias("label"), F.lit(valid).alias("valid"), reason.alias("reason"))
    return (
        F.when(t.isNull() | (F.trim(t) == ""), answer(F.lit(None), False, F.lit("empty reply")))
        .when(allowed(told).isNotNull(), answer(allowed(told), True, F.lit("")))
        .when(told.isNotNull(), answer(told, False, F.lit("label not allowed")))
        .when(allowed(F.trim(t)).isNotNull(), answer(allowed(F.trim(t)), True, F.lit("")))
        .otherwise(answer(F.lit(None), False, F.lit("no label found")))
    )


def nearest_class(t: Column, classes: list[str]) -> Column:
    """The class that a reply means: the same word; else the first that ends as the reply does or with which the reply
    ends; else the one named most often, of equal ones the first. A null reply means none."""
    said = F.rtrim(F.lower(F.trim(t)), F.lit(".,;:!"))
    low = F.lower(t)
    count = lambda x: (F.length(low) - F.length(F.replace(low, F.lit(x)))) / len(x)
    names = [c.lower() for c in classes]
    out = F.when(t.isNull(), F.lit(None).cast("string"))
    for c, n in zip(classes, names):
        out = out.when(said == n, c)
    for c, n in zip(classes, names):
        out = out.when(F.lit(n).endswith(said) | said.endswith(n), c)
    best = F.array_max(F.array(*(F.struct((count(n.replace("_", " ")) + count(n)).alias("k"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, n) in enumerate(zip(classes, names)))))
    return out.otherwise(best["c"])
