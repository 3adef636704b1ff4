import pytest
from pyspark.sql import functions as F

from callgrain.functions import rules
from callgrain.functions import text as T
from callgrain.plans.metrics import mann_whitney_p


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("Émail it's A-b c’d", ["mail", "it's", "a-b", "c’d"]), (None, []), ("", []), ("?!", []), ("ORD12 x", ["ord12", "x"])],
)
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokens) == want


def test_mixed_tokens(spark):
    assert one(spark, "नमस्ते ABC, 12!", T.mixed_tokens) == ["नमस्ते", "abc", ",", "12", "!"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Call +91 98765 43210 now", "call <PHONE> now"),
        ("see https://a.b/c  and www.x.y", "see <URL> and <URL>"),
        ("  A\t\nB  ", "a b"),
        ("12 34", "12 34"),
    ],
)
def test_mask_contacts(spark, text, want):
    assert one(spark, text, T.mask_contacts) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("call +91 98765 43210 now", "call PHONE now"), ("pay 1,200.50 to a@b.co!", "pay NUM to EMAIL"), ("é ü!x", "é ü x"), ("x12 y", "x12 y")],
)
def test_template_text(spark, text, want):
    assert one(spark, text, T.template_text) == want


def test_counts(spark):
    assert one(spark, "A b. C? ... d", T.sentence_count) == 3
    assert one(spark, "one two_x 3 नम", T.word_count) == 4
    assert one(spark, None, T.word_count) == 0
    assert one(spark, 'he said "0123456789" and "0123456789"', lambda c: T.count_patterns(c, rules.DIALOGUE_PATTERNS)) == 2
    assert one(spark, "aXbXc", lambda c: T.count_literal(c, "X")) == 2
    assert one(spark, "a video", lambda c: T.contains_any(c, ["vi"])) is True


@pytest.mark.parametrize(("words", "chars", "want"), [(79, 500, "REJECT_TOO_SHORT"), (80, 499, "REJECT_TOO_SHORT"), (80, 500, "WEAK_DIALOGUE_SIGNAL")])
def test_precheck_limits(spark, words, chars, want):
    lit = F.lit
    got = spark.range(1).select(rules.precheck(lit(words), lit(chars), lit(0), lit(0), lit(0.0), lit(0.0)).alias("x")).first().x
    assert got == want


@pytest.mark.parametrize(
    ("tutorial", "cta", "dialogue", "narration", "want"),
    [(4, 0, 0.34, 0.0, "REJECT_TUTORIAL"), (3, 2, 0.0, 0.0, "REJECT_PROMOTIONAL"), (9, 9, 0.65, 0.49, "LIKELY_CONVERSATION"), (0, 0, 0.65, 0.5, "REVIEW"), (0, 0, 0.35, 0.0, "REVIEW")],
)
def test_precheck_cascade(spark, tutorial, cta, dialogue, narration, want):
    lit = F.lit
    assert spark.range(1).select(rules.precheck(lit(100), lit(900), lit(tutorial), lit(cta), lit(dialogue), lit(narration)).alias("x")).first().x == want


@pytest.mark.parametrize(
    ("en", "hi", "amb", "n", "want"),
    [(8, 0, 0, 10, "ENGLISH_DOMINANT"), (2, 8, 0, 10, "HINDI_DOMINANT"), (1, 1, 8, 10, "HINGLISH_MIXED"), (1, 0, 5, 10, "AMBIGUOUS"), (0, 0, 4, 10, "OTHER_DOMINANT"), (0, 0, 0, 0, "EMPTY")],
)
def test_message_language(spark, en, hi, amb, n, want):
    lit = F.lit
    assert spark.range(1).select(rules.message_language(lit(en), lit(hi), lit(amb), lit(n)).alias("x")).first().x == want


@pytest.mark.parametrize(("answer", "want"), [(None, "Missing"), (" 5. ", "5"), ("No scam", "No Scam"), ("customer care", "6"), ("credit app", "5"), ("otp upi", "1"), ("?", "Unknown"), ("9", "Unknown")])
def test_category(spark, answer, want):
    assert one(spark, answer, rules.category) == want


@pytest.mark.parametrize(("answer", "want"), [("somewhat not realistic", 2), ("NOT realistic", 1), ("Realistic", 3), (None, None), ("x", None)])
def test_realism(spark, answer, want):
    assert one(spark, answer, rules.realism) == want


@pytest.mark.parametrize(
    ("reply", "want"),
    [('```json\n{"label": "A"}\n```', "a"), ('well {"label": "b"} so', "b"), ("label: a", "a"), ("B", "b"), ("other", None), ("", None)],
)
def test_reply_label(spark, reply, want):
    assert one(spark, reply, lambda c: T.reply_label(c, ["a", "b"])) == want


def test_dialogue_or_null(spark):
    good = "intro\nSCAMMER: a\nreceiver: b\nscammer : c\nReceiver: d\nScammer: e"
    assert one(spark, good, T.dialogue_or_null).startswith("Scammer: a")
    assert one(spark, "scammer: a\nreceiver: b", T.dialogue_or_null) is None


def test_head_and_tail(spark):
    got = one(spark, "a" * 30 + "b" * 300 + "c" * 30, lambda c: T.head_and_tail(c, 180))
    assert got.startswith("a" * 30) and got.endswith("c" * 30) and "300 characters" in got
    assert one(spark, "short", lambda c: T.head_and_tail(c, 180)) == "short"


def test_rounding_is_half_even(spark):
    r = spark.range(1).select(F.bround(F.lit(2.5), 0), F.bround(F.lit(3.5), 0)).first()
    assert list(r) == [2.0, 4.0]


@pytest.mark.parametrize(
    ("cells", "u", "p"),
    [(((342, 438, 175), (37, 17, 22)), 37631.0, 5.622835543344316e-01), (((183, 420, 365), (2, 2, 73)), 16225.5, 4.337321690e-19)],
)
def test_mann_whitney_published(cells, u, p):
    x, y = cells
    below, got = 0, 0.0
    for a, b in zip(x, y):
        got += a * (below + b / 2)
        below += b
    ties = sum((a + b) ** 3 - (a + b) for a, b in zip(x, y))
    assert got == u
    assert mann_whitney_p(u, sum(x), sum(y), ties) == pytest.approx(p, rel=1e-6)
