"""Rule cascades over transcripts and annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrain.functions import text as T

#: Limits of the cascades. Fixed values.
MIN_CHARS, MIN_WORDS = 500, 80

#: Promotional phrases. Fixed values.
CTA_PATTERNS = [
    r"\blike and subscribe\b",
    r"\blike\s+(this\s+)?video\b",
    r"\bsubscribe\s+(to\s+the\s+)?channel\b",
    r"\bsubscribe\s+now\b",
    r"\bhit the bell\b",
    r"\bpress the bell\b",
    r"\bcomment below\b",
    r"\bshare this video\b",
    r"\bfollow (our|my|this) channel\b",
]
#: Phrases of tutorials. Fixed values.
TUTORIAL_PATTERNS = [
    r"\btoday we (will|are going to) discuss\b",
    r"\bin this video\b",
    r"\btoday's video\b",
    r"\blet me explain\b",
    r"\bhow to (report|avoid|identify|protect|recover)\b",
    r"\bhow you can\b",
    r"\bhere is how\b",
    r"\bstep\s*[-:]?\s*[1-9]\b",
    r"\bfirst of all\b",
    r"\bthe first step\b",
    r"\bnext step\b",
    r"\bto report (this|the) fraud\b",
    r"\byou should (always|never)\b",
    r"\bcyber crime helpline\b",
    r"\bcybercrime portal\b",
    r"\bawareness\b",
    r"\bawareness video\b",
]
#: Phrases of reports. Fixed values.
NARRATION_PATTERNS = [
    r"\bthe victim\b",
    r"\bthe scammer\b",
    r"\bthe fraudster\b",
    r"\bthe caller\b",
    r"\bthe accused\b",
    r"\baccording to\b",
    r"\bpolice said\b",
    r"\bpolice officials\b",
    r"\breportedly\b",
    r"\bthe incident\b",
    r"\bthis incident\b",
    r"\bin the video\b",
    r"\bthe video shows\b",
    r"\bthe story\b",
    r"\bthe case\b",
]
#: Signs of dialogue. Fixed values.
DIALOGUE_PATTERNS = [
    r'"[^"]{10,}"',
    r"'[^']{10,}'",
    r"\bscammer\s*:",
    r"\bscamster\s*:",
    r"\bcaller\s*:",
    r"\bvictim\s*:",
    r"\bfraudster\s*:",
    r"\bperson\s*1\s*:",
    r"\bperson\s*2\s*:",
    r"\bspeaker\s*1\s*:",
    r"\bspeaker\s*2\s*:",
    r"\bcaller said\b",
    r"\bvictim said\b",
    r"\bscammer said\b",
    r"\bcaller asked\b",
    r"\bvictim asked\b",
    r"\bscammer asked\b",
    r"\bcaller replied\b",
    r"\bvictim replied\b",
    r"\bscammer replied\b",
    r"\bhe replied\b",
    r"\bshe replied\b",
]
#: Labels of speakers, and quotations, that tell a dialogue. Fixed values.
SPEAKER_LABEL = r"\b(?:scammer|caller|victim|fraudster|speaker\s*[12]|person\s*[12])\s*:"
QUOTED = r'"[^"]{10,}"'
#: Terms one of which an accepted text must hold. Fixed values.
TOPIC_TERMS = [
    "kyc", "otp", "bank account", "bank", "debit card", "credit card", "net banking", "account blocked",
    "upi", "phonepe", "paytm", "gpay", "google pay", "wallet", "cashback", "payment request",
    "investment", "invest", "profit", "trading", "crypto", "cryptocurrency", "task", "commission", "withdrawal",
    "arrest", "police", "court", "warrant", "narcotics", "crime branch", "cyber cell", "illegal parcel",
    "loan", "credit", "emi", "processing fee", "loan app", "disbursement", "interest",
    "delivery", "parcel", "courier", "order", "shipment", "customer care", "refund",
    "dating", "romance", "girlfriend", "boyfriend", "nude", "sextortion", "video call", "blackmail",
    "sim", "mobile", "telecom", "jio", "airtel", "vi", "bsnl", "number",
]


def _points(*rules: tuple[Column, float]) -> Column:
    """The points of the rules that hold, at most 1."""
    total = F.lit(0.0)
    for holds, points in rules:
        total = total + F.when(holds, F.lit(points)).otherwise(F.lit(0.0))
    return F.bround(F.least(total, F.lit(1.0)), 4)


def signs(t: Column) -> dict[str, Column]:
    """Counts that the scores are made of; put them into columns first, so that each pattern is counted once."""
    return {
        "words": T.word_count(t),
        "cta": T.count_patterns(t, CTA_PATTERNS),
        "tutorial": T.count_patterns(t, TUTORIAL_PATTERNS),
        "told": T.count_patterns(t, NARRATION_PATTERNS),
        "hits": T.count_patterns(t, DIALOGUE_PATTERNS),
        "voices": F.size(F.array_distinct(F.regexp_extract_all(F.lower(T.text_or_empty(t)), F.lit(f"({SPEAKER_LABEL})"), F.lit(1)))),
        "quotes": F.regexp_count(T.text_or_empty(t), F.lit(QUOTED)),
    }


def dialogue_score(hits: Column, voices: Column, quotes: Column) -> Column:
    return _points((hits >= 1, 0.35), (hits >= 3, 0.25), (hits >= 6, 0.20), (voices >= 2, 0.40), (quotes >= 2, 0.30))


def narration_score(words: Column, told: Column, taught: Column, asked: Column) -> Column:
    hundreds = F.greatest(F.greatest(words, F.lit(1)) / F.lit(100.0), F.lit(1.0))
    return _points((told >= 2, 0.25), (told >= 5, 0.20), (taught >= 2, 0.30), (taught >= 5, 0.15), (asked >= 1, 0.20), (told / hundreds > 3, 0.10), (taught / hundreds > 3, 0.10))


def precheck(words: Column, chars: Column, tutorial: Column, cta: Column, dialogue: Column, narration: Column) -> Column:
    return (
        F.when((words < MIN_WORDS) | (chars < MIN_CHARS), "REJECT_TOO_SHORT")
        .when((tutorial >= 4) & (dialogue < 0.35), "REJECT_TUTORIAL")
        .when((cta >= 2) & (dialogue < 0.35), "REJECT_PROMOTIONAL")
        .when((dialogue >= 0.65) & (narration < 0.50), "LIKELY_CONVERSATION")
        .when(dialogue >= 0.35, "REVIEW")
        .otherwise("WEAK_DIALOGUE_SIGNAL")
    )


def quality_gate(label: Column, confidence: Column, words: Column, two_voices: Column, exchange: Column, narration: Column, tutorial: Column, t: Column) -> Column:
    """(status, reason) of the first rule that holds, in this order."""
    verdict = lambda status, reason: F.struct(F.lit(status).alias("status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when(label != "CONVERSATION", verdict("REJECT", F.concat(F.lit("LLM_LABEL_"), label)))
        .when(confidence < 0.75, verdict("MANUAL_REVIEW", "LOW_LLM_CONFIDENCE"))
        .when(words < MIN_WORDS, verdict("REJECT", "TOO_SHORT"))
        .when(~two_voices, verdict("MANUAL_REVIEW", "PARTICIPANTS_NOT_CONFIRMED"))
        .when(~exchange, verdict("MANUAL_REVIEW", "BACK_AND_FORTH_NOT_CONFIRMED"))
        .when(narration, verdict("REJECT", "MOSTLY_NARRATION"))
        .when(tutorial, verdict("REJECT", "MOSTLY_TUTORIAL"))
        .when(~T.contains_any(t, TOPIC_TERMS), verdict("MANUAL_REVIEW", "NO_CLEAR_SCAM_TERMS"))
        .otherwise(verdict("ACCEPT_CANDIDATE", "PASSED_ALL_FILTERS"))
    )


def message_language(en: Column, hi: Column, amb: Column, n: Column) -> Column:
    """From counts of token labels: dominant at 80 per cent, mixed with both, ambiguous at 50."""
    return (
        F.when(n == 0, "EMPTY")
        .when(en * 100 >= n * 80, "ENGLISH_DOMINANT")
        .when(hi * 100 >= n * 80, "HINDI_DOMINANT")
        .when((en > 0) & (hi > 0), "HINGLISH_MIXED")
        .when(amb * 100 >= n * 50, "AMBIGUOUS")
        .otherwise("OTHER_DOMINANT")
    )


#: Words that name a class in an answer in own wording, in the order in which they are tried. Fixed values.
CATEGORY_WORDS = [
    (1, ["bank", "kyc", "otp"]),
    (2, ["upi", "wallet"]),
    (3, ["invest", "task"]),
    (4, ["digital", "arrest", "government"]),
    (5, ["loan", "credit"]),
    (6, ["delivery", "customer care"]),
    (7, ["dating", "romance", "extortion", "sextortion"]),
    (8, ["telecom", "legacy"]),
]


def category(answer: Column) -> Column:
    """'1' to '8', 'No Scam', 'Missing' for null, 'Unknown' for the rest."""
    s = F.trim(answer)
    out = F.when(answer.isNull(), "Missing").when(F.lower(s) == "no scam", "No Scam").when(s.rlike(r"^[1-8]\b"), F.substring(s, 1, 1))
    for no, words in CATEGORY_WORDS:
        out = out.when(T.contains_any(s, words), str(no))
    return out.otherwise("Unknown")


def confidence(answer: Column) -> Column:
    s = F.lower(F.trim(answer))
    return F.when(s.isin("high", "medium", "low"), F.initcap(s)).otherwise("Unknown")


def realism(answer: Column) -> Column:
    """3 realistic, 2 somewhat, 1 not; null for the rest. 'somewhat' is tried before 'not', that before 'realistic'."""
    s = F.lower(F.trim(answer))
    negative = T.contains_any(s, ["not realistic", "not realisitic", "artificial", "generated"])
    return F.when(answer.isNull(), F.lit(None).cast("int")).when(s.contains("somewhat"), 2).when(negative, 1).when(s.contains("realistic"), 3)


def adjudicated(a1: Column, a2: Column, truth: Column) -> Column:
    return (
        F.when(a1 == a2, F.struct(a1.alias("label"), F.lit("agreement").alias("rationale")))
        .when(a1 == truth, F.struct(a1.alias("label"), F.lit("first annotator").alias("rationale")))
        .when(a2 == truth, F.struct(a2.alias("label"), F.lit("second annotator").alias("rationale")))
        .otherwise(F.struct(truth.alias("label"), F.lit("expert").alias("rationale")))
    )
