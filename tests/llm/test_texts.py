"""Problems 1, 4, 6, 7, 8, 9 and 10 on small fixtures."""

import os
import random
from datetime import datetime

import pytest

from callgrain.llm import consensus, encode, identity, language, leakage, residue, turns

HAVE_VOCABULARY = os.path.exists(encode.VOCABULARY)
MODEL = turns.model_of()


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[00:05] Caller: um, hello the Hmm 18 digit code (laughs)\n[00:02] Victim - at 6:30 I uh... came", [("receiver", 4), ("caller", 5)]),
        ("Speaker 1 [00:05]: one two\nSpeaker 1 [00:05]: one two\nSpeaker 2 [00:09]: three\n[00:11] four", [("caller", 2), ("receiver", 2)]),
        ("1\n00:00:01,000 --> 00:00:02,000\n>> Calller: one\n\n2\n00:00:03,000 --> 00:00:04,000\ntwo\r\n", [("caller", 2)]),
        ("<S1> one\n**Reciever:** two ((unclear)) three\n[Narrator]: four\nfive", [("caller", 1), ("receiver", 2), ("narrator", 2)]),
        ("(0:01) [SPEAKER_02]: (line drops)\n(0:02) Caller: yes [at] home", [("caller", 3)]),
        ("no labels here\nat all", []),
        ("", []),
        (None, []),
        ("Caller:", []),
    ],
)
def test_turns(text, want):
    assert [(s, turns.count_words(w)) for s, w in turns.turns_of(text, MODEL)] == want


def test_spoken_times_are_kept():
    assert turns.turns_of("Caller: be there at 6:30 sharp", MODEL) == [("caller", "be there at 6:30 sharp")]


def test_clean_turns_counts_a_file_once(spark):
    at = datetime(2031, 1, 1)
    rows = [("a", "Caller: x y", at, 1), ("a", "Caller: x y", None, 2), ("b", None, at, 3), (None, "Caller: z", at, 4), ("c", " ", at, 5)]
    df = spark.createDataFrame(rows, "source_file string, original_text string, loaded_at timestamp, text int")
    got = turns.clean_turns(df, "source_file", "original_text", "loaded_at").collect()
    assert [(r.source_file, r.turn_no, r.speaker, r.n_words) for r in got] == [("a", 1, "caller", 2)]
    assert turns.clean_turns(df.limit(0), "source_file", "original_text").count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Alice: one two\nBob: three\nAlice: four", [("caller", 2), ("receiver", 1), ("caller", 1)]),
        ("Caller: one\nOperator: two three\nVictim: four", [("caller", 1), ("narrator", 2), ("receiver", 1)]),
        ("one two\nReceiver: three\nCaller: four", [("receiver", 3), ("caller", 1)]),  # words before the first label
        ("Note: a b\nc d", []),  # one name before a colon is no label
        ("Caller: a [door slams] b *coughs* c ♪ la la ♪ d", [("caller", 4)]),  # sounds known and unknown, stars and tunes
        ("Caller: write to x [at] mail [dot] test now", [("caller", 8)]),
        ("Caller: ring (338) 555-0174 at 6:30, price 230/- only", [("caller", 8)]),
        ("[0:09] Anchr - a\n(9.5s) <Custommer> b", [("receiver", 1), ("narrator", 1)][::-1]),
    ],
)
def test_turns_from_shape_and_place(text, want):
    assert [(s, turns.count_words(w)) for s, w in turns.turns_of(text, MODEL)] == want


def test_fitting_and_decoding_decide(spark):
    """Fitting moves the model; without the sequence, each token by itself, the planted cases come out worse."""
    texts = ["[00:01] Caller: hm, hello\n[00:02] Victim: yes (pause) be there at 6:30 sharp", "Caller: x [at] mail, [door slams] no\nVictim: (338) 555 ok"] * 20
    model = turns.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert model != MODEL
    want = [[("caller", 1), ("receiver", 6)], [("caller", 4), ("receiver", 3)]]
    got = [[(s, turns.count_words(w)) for s, w in turns.turns_of(t, model)] for t in texts[:2]]
    assert got == want
    emit = model[0]
    alone = lambda symbols, _: tuple(max(range(5), key=lambda s: emit[s][k]) for k in symbols)
    kept, turns.viterbi = turns.viterbi, alone
    try:
        assert [[(s, turns.count_words(w)) for s, w in turns.turns_of(t, model)] for t in texts[:2]] != want
    finally:
        turns.viterbi = kept


@pytest.mark.parametrize(("label", "want"), [("Reciever", "receiver"), ("CALLLER", "caller"), ("voice-over", "narrator"), ("speaker_02", "receiver"), ("S3", "narrator"), ("Alice", None), ("person", None), ("", None)])
def test_roles(label, want):
    assert turns.role(label) == want


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b+c@x.example.org now", {("email", "abcxexampleorg")}),
        ("she is at 12 Kemo Street, Sonagarh today", {("street_address", "12kemostreetsonagarh")}),
        ("Calle Kipade 14, 6B, Eastwadi desde; 8 bis avenue Darsoro, 39999 Mallowtola depuis", {("street_address", "callekipade146beastwadi"), ("street_address", "8bisavenuedarsoro39999mallowtola")}),
        ("", set()),
    ],
)
def test_seeds(text, want):
    assert {(k, identity.plain(text[a:b])) for k, a, b in identity.seeds(text, text.lower())} == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to Ann dot Lee at post dot test today", {("spelled", "anndotleeatpostdottest")}),
        ("x [at] mail.example", {("spelled", "xatmailexample")}),
        ("on one nine eight eight six two seven seven zero three after", {("spoken", "onenineeighteightsixtwosevensevenzerothree")}),
        ("+91-142-423-9985 or (338) 555-0174", {("+00-000-000-0000", "911424239985"), ("(000) 000-0000", "3385550174")}),
        ("SSMXZ9098Y, QL77 2028 2267288", {("AAAAA0000A", "ssmxz9098y"), ("AA00 0000 0000000", "ql7720282267288")}),
        ("TB/905/36, 4,736 and 363838 rupees on 2031-05-11", {("0000-00-00", "20310511")}),
    ],
)
def test_forms(text, want):
    got = {(f, identity.plain(text[a:b])) for f, a, b in identity.numbers(text)} | {(f, identity.plain(text[a:b])) for _, f, a, b in identity.spelled(text.lower())}
    assert got == want


@pytest.fixture(scope="module")
def taught(spark):
    """Forms that no pattern of the library holds: telephones `00.00.00` behind T, identity numbers AAA-0000-AAA of
    eleven places, addresses of the layout `Block 0, W Quarter, W`; names that are no seeds."""
    r = random.Random(1)
    names = ["ankit", "deepak", "hannah", "kavya", "zubin", "oona"]
    towns = [a + b for a in ("Sona", "Mira", "Bela", "Kess", "Ostr", "Tull", "Varn", "Rysl", "Elms", "Nabb") for b in ("garh", "field", "ton", "wadi", "pur", "burg")]
    rows = []
    for i in range(500):
        n, s, t = r.choice(names).title(), r.choice(["Lokdhare", "Patwani", "Nelbari"]), r.choice(towns)
        phone = r.choice([f"+91 {r.randrange(10**4, 10**5)} {r.randrange(10**4, 10**5)}", f"{r.randrange(100, 999)}-{r.randrange(1000, 9999)}-{r.randrange(10, 99)}"])
        card = r.choice([f"{r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", f"ZQ{r.randrange(10**6, 10**7)}"])
        home = r.choice([f"{r.randrange(1, 99)} {r.choice(towns)} Street, {t}", f"Block {r.randrange(1, 99)}, {r.choice(towns)} Quarter, {t}"])
        rows.append(f"caller: The account is held by {n} {s} since 2019. I will wait in {t}.\nreceiver: I already told {n} everything. {n} Bank called on 9{r.randrange(10**8, 10**9)}.")
        rows.append(f"caller: Note my number, {phone} is the one.\nreceiver: My identity card says {card} on it.\ncaller: I live at {home} since last year.")
        rows.append(f"caller: The order QK{r.randrange(10**6, 10**7)} costs {r.randrange(10**6, 10**7)} in {t}.")
    df = spark.createDataFrame([(x,) for x in rows], "text string").selectExpr("text", "false AS transcript")
    return identity.learn(df)


def test_forms_are_discovered(taught):
    assert taught.forms["000-0000-00"] == "phone"
    text = "Her flat is Block 7, Elmsta Quarter, Kesspur near the shop, ring 123-4567-89 or mail a@b.co."
    assert {(k, identity.plain(text[a:b])) for k, a, b in taught.find(text)} == {("street_address", "block7elmstaquarterkesspur"), ("phone", "123456789"), ("email", "abco")}


def test_contexts_tell_equal_forms_apart(taught):
    text = "My identity card says ZQ7654321 on it. The order QK1234567 costs 7654321 in Belaton."
    assert [(k, text[a:b]) for k, a, b in taught.find(text)] == [("id_number", "ZQ7654321")], (taught.forms, taught.contexts)
    text = "Note my number, 3252382876 is the one. I paid 3252382876."
    assert [k for k, a, b in taught.find(text)] == ["phone"]


def test_unseen_names_are_discovered(taught):
    assert {"zubin", "oona"} <= taught.given and "sonagarh" not in taught.given and len(identity.SEED_NAMES) <= 10
    text = "This account is held by Zubin B. Patwani since 2019, ask Oona Bank or OONA."
    assert {identity.plain(text[a:b]) for k, a, b in taught.find(text) if k == "person_name"} == {"zubinbpatwani", "oona"}


@pytest.mark.parametrize(("kind", "value", "want"), [("email", "a@b.co", True), ("email", "a at b dot co", False), ("phone", "+91 12345 12345", True), ("phone", "12345 123456", False), ("id_number", "123-12-1234", True), ("id_number", "X1234567", False), ("street_address", "12 Kemo Street, Sonagarh", True), ("street_address", "Plot 3, Sector 4, W Nagar, T", False), ("person_name", "Ankit X", True), ("person_name", "Oona", False)])
def test_what_is_a_seed(kind, value, want):
    assert identity.is_seed(kind, value) is want


def test_redaction_keeps_the_rest(taught):
    assert identity.redact("mail a@b.co to Ankit now", taught) == "mail [EMAIL] to [PERSON_NAME] now"
    text = "[00:02] Victim: no\n[00:05] Caller: um, this is  Ankit\n[00:07] Caller: [laughs] Lokdhare, ok (pause)\n"
    assert identity.redact(text, taught, True) == "[00:02] Victim: no\n[00:05] Caller: um, this is  [PERSON_NAME]\n[00:07] Caller: [laughs] , ok (pause)\n"


def test_entities_edges(spark):
    a = spark.createDataFrame([(1, "mail x@y.example", 7), (1, "mail x@y.example", 8), (2, None, 9), (None, "z@y.example", 9), (3, "", 9)], "rec_id bigint, text string, row_key int")
    b = spark.createDataFrame([("f", "(0:01) Caller: my mail is x@y um\n(0:04) Caller: ok")], "source_file string, original_text string")
    parts = [("t", a, "rec_id", "text", False), ("f", b, "source_file", "original_text", True)]
    assert {tuple(r) for r in identity.entities(parts).collect()} == {("t", "1", "email", "xyexample"), ("f", "f", "email", "xy")}
    assert {r.text for r in identity.redacted(parts).collect()} == {"mail [EMAIL]", "", "(0:01) Caller: my mail is [EMAIL] um\n(0:04) Caller: ok"}
    none = [("t", a.limit(0), "rec_id", "text", False), ("f", b.limit(0), "source_file", "original_text", True)]
    assert identity.entities(none).count() == 0


# ---------------------------------------------------------------- 6


def sheets(spark, rows):
    return spark.createDataFrame(rows, "blind_id string, annotator string, category string, submitted_at timestamp")


def test_consensus_prefers_the_reliable(spark):
    r = random.Random(5)
    first, more, truth = [], [], {}
    for i in range(400):
        truth[f"i{i}"] = t = r.randint(1, 8)
        say = lambda p, t=t: str(t if r.random() < p else r.randint(1, 8))
        first.append((f"i{i}", say(0.9), say(0.85)))
        more += [(f"i{i}", "x", say(0.1), datetime(2031, 1, 2)), (f"i{i}", "y", say(0.1), datetime(2031, 1, 2)), (f"i{i}", "z", say(0.8), datetime(2031, 1, 2))]
    df = spark.createDataFrame(first, "blind_id string, a1_cat string, a2_cat string")
    got = {x.blind_id: x.class_no for x in consensus.consensus(df, sheets(spark, more)).collect()}
    assert sum(got[k] == v for k, v in truth.items()) > 0.93 * len(truth)
    p = {x.annotator: x.accuracy for x in consensus.reliabilities(consensus.answers(df, sheets(spark, more))).collect()}
    assert p["annotator 1"] > p["z"] > 0.6 > p["x"]


def test_few_partners_are_enough(spark, monkeypatch):
    """With fewer partners than annotators all get a reliability, near that from all triplets."""
    r = random.Random(8)
    rows = []
    for i in range(500):
        t = r.randint(1, 8)
        rows += [(f"i{i}", f"a{k}", str(t if r.random() < 0.5 + 0.05 * k else r.randint(1, 8)), datetime(2031, 1, 2)) for k in range(9)]
    first = spark.createDataFrame([], "blind_id string, a1_cat string, a2_cat string")
    given = consensus.answers(first, sheets(spark, rows))
    whole = {x.annotator: x.accuracy for x in consensus.reliabilities(given).collect()}
    monkeypatch.setattr(consensus, "PARTNERS", 4)
    few = {x.annotator: x.accuracy for x in consensus.reliabilities(given).collect()}
    assert whole.keys() == few.keys() and all(abs(whole[a] - few[a]) < 0.1 for a in whole)
    assert whole["a0"] < whole["a4"] < whole["a8"]


def test_all_partners_count(spark):
    """With more annotators than 200 each reliability is that of all triplets."""
    import numpy as np

    r = np.random.default_rng(6)
    truth, n = r.integers(1, 9, 14), 206
    said = np.array([np.where(r.random(14) < (0.95 if k % 3 else 0.5), truth, r.integers(1, 9, 14)) for k in range(n)])
    rows = [(f"i{i}", f"a{k:03}", str(said[k, i]), datetime(2031, 1, 2)) for k in range(n) for i in range(14)]
    first = spark.createDataFrame([], "blind_id string, a1_cat string, a2_cat string")
    got = {x.annotator: x.accuracy for x in consensus.reliabilities(consensus.answers(first, sheets(spark, rows))).collect()}
    share = np.array([(said == c).mean(1) for c in range(1, 9)]).T
    chance = share @ share.T
    kappa = np.maximum(((said[:, None] == said[None]).mean(2) - chance) / np.maximum(1 - chance, 1e-9), 0.01)
    for a in range(n):
        b, c = np.triu_indices(n, 1)
        keep = (b != a) & (c != a)
        value = np.sort(np.clip(kappa[a, b] * kappa[a, c] / kappa[b, c], 1e-4, 1)[keep])
        q = np.sqrt(value[-(-len(value) // 2) - 1])
        assert abs(got[f"a{a:03}"] - min(max((q * 7 + 1) / 8, 0.135), 0.995)) < 1e-9


def test_consensus_tells_agreement(spark):
    df = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", "3", None)], "blind_id string, a1_cat string, a2_cat string")
    got = {x.blind_id: (x.n_answers, x.n_classes, x.agreement) for x in consensus.consensus(df, sheets(spark, [])).collect()}
    assert got == {"a": (2, 1, 1.0), "b": (2, 2, 0.0), "c": (1, 1, None)}


def test_answers_edges(spark):
    df = spark.createDataFrame([("a", "8.", "no scam"), ("a", "8.", "no scam"), (None, "1", "1")], "blind_id string, a1_cat string, a2_cat string")
    s = sheets(spark, [("a", "x", "3", datetime(2031, 1, 1)), ("a", "x", "unsure", datetime(2031, 1, 2)), ("a", "y", "Customer-Care scam", None), ("a", None, "2", None), ("b", "y", "9", None)])
    assert {tuple(r) for r in consensus.answers(df, s).collect()} == {("a", "annotator 1", 8), ("a", "y", 6)}
    assert [r.blind_id for r in consensus.contested(df, s).collect()] == ["a"]
    assert consensus.contested(df.limit(0), s.limit(0)).count() == 0


# ---------------------------------------------------------------- 7

LINES = {
    "en": ["please tell me the number on your card now", "the branch did not send the papers yet", "I will call you back in the evening"],
    "hi": ["aapka khaata band ho jayega jaldi boliye", "मेरा खाता बंद मत करना भाई साहब", "main abhi ghar par nahi hoon"],
    "es": ["dígame el número de su tarjeta por favor", "la oficina no recibió los documentos todavía", "le llamaré esta tarde sin falta"],
    "fr": ["donnez-moi le numéro de votre carte maintenant", "le bureau n'a pas reçu vos papiers encore", "je vous rappelle dans la soirée"],
}


@pytest.mark.parametrize(("label", "want"), [("en-IN", "en"), ("HINDI", "hi"), (" Español ", "es"), ("fra", "fr"), ("und", None), ("", None), (None, None), ("de", None)])
def test_named_language(label, want):
    assert language.named_language(label) == want


def test_language_cases(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        lang = r.choice(list(LINES))
        rows.append((i, lang, ". ".join(r.choice(LINES[lang]) for _ in range(4)) + "."))
    rows += [(1000, "fr", "The branch did not send the papers yet. Please call me in the evening."), (1001, None, LINES["es"][0]), (1002, "en", LINES["en"][0] + ".\n" + LINES["fr"][2] + "."), (1003, "en", "caller: " + LINES["en"][1]), (1004, None, "two words"), (1005, None, None), (1006, "", ""), (None, None, LINES["fr"][0])]
    df = spark.createDataFrame(rows, "rec_id bigint, lang string, text string")
    got = {(x.rec_id, x.lang) for x in language.language_cases(df, "rec_id", "text", "lang").collect()}
    assert got == {(1000, "en"), (1001, "es"), (1002, "en"), (1002, "fr")}
    assert language.language_cases(df.limit(0), "rec_id", "text", "lang").count() == 0


def test_language_parts(spark):
    r = random.Random(3)
    rows = [(i, lang, ". ".join(r.choice(LINES[lang]) for _ in range(4)) + ".") for i in range(300) for lang in [r.choice(list(LINES))]]
    rows += [(1000, "en", LINES["en"][0] + ". Ok.\n" + LINES["fr"][2] + ". " + LINES["fr"][1] + "."), (1001, None, None), (1002, None, "?"), (1003, None, "zq xv")]
    df = spark.createDataFrame(rows, "rec_id bigint, lang string, text string")
    got = language.parts(df, "rec_id", "text", "lang").where("rec_id >= 1000").orderBy("rec_id", "part_no").collect()
    assert [(x.part_no, x.first_word, x.n_words, x.lang, x.ambiguous) for x in got if x.rec_id == 1000] == [(1, 1, 10, "en", False), (2, 11, 15, "fr", False)]
    assert all(0.25 <= x.confidence <= 1 for x in got) and {x.rec_id for x in got} == {1000, 1003}
    assert all(x.ambiguous for x in got if x.rec_id == 1003)


def test_code_distance():
    c = language.CODE
    assert c.shape == (5, 15)
    assert min((c[i] != c[j]).sum() for i in range(5) for j in range(i)) == 8


# ---------------------------------------------------------------- 8


@pytest.mark.skipif(not HAVE_VOCABULARY, reason="no vocabulary file")
def test_tree_encoding_is_exact():
    enc = encode.encoder(encode.VOCABULARY)
    r = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "é", "नमस्ते", "1", "!!", "'s", "the", "ab", "\t", "🙂", " \n "]
    for k in range(600):
        s = "".join(r.choice(parts if k % 3 else ["ab", "an", "na"]) for _ in range(r.randint(0, 90)))
        assert encode.encode_text(s, leaf=r.randint(1, 20), run=r.randint(2, 9)) == enc.encode_ordinary(s)
    long = "banana" * 5000
    assert encode.encode_text(long) == enc.encode_ordinary(long)
    assert enc.decode(encode.encode_text(long)) == long


@pytest.mark.skipif(not HAVE_VOCABULARY, reason="no vocabulary file")
@pytest.mark.parametrize("word", ["they're", "we've", "he'll", "it's", "i'm", "she'd", "'re", "!'ve", " 'll", "''re", "x'r", "a'really"])
def test_cuts_inside_contractions(word):
    enc = encode.encoder(encode.VOCABULARY)
    for s in (word, f"so {word} here", word * 3, f"{word} {word}"):
        for leaf in range(1, len(s) + 1):
            assert encode.encode_text(s, leaf=leaf) == enc.encode_ordinary(s)
    long = "x" * (encode.LEAF - len(word) + 1) + word + " y"
    assert encode.encode_text(long) == enc.encode_ordinary(long)


@pytest.mark.skipif(not HAVE_VOCABULARY, reason="no vocabulary file")
def test_encode_corpus(spark):
    enc = encode.encoder(encode.VOCABULARY)
    texts = ["", None, "<|endoftext|> hi", "x y " * 5000, "z" * 20000, "ab"]
    rows = [(i, t, "k", [1]) for i, t in enumerate(texts)] + [(5, "ab", "k", [1]), (None, "q" * 9000, "k", [1])]
    got = encode.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, uid string, ids array<int>"), "doc_id", "text", leaf=300, fan=4).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), enc.encode_ordinary(t) if t else []) for i, t, *_ in rows)


# ---------------------------------------------------------------- 9


def test_leaks_against_brute_force(spark):
    r = random.Random(6)
    vocab = [f"v{i}" for i in range(30)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, f"caller: {line(9)}\nreceiver: {line(9)}") for i in range(6)] + [(7, None), (8, "short"), (None, "x " * 20)]
    docs = []
    for i in range(60):
        t = r.choice(items[:6])[1]
        w = t.replace("caller:", "" if i % 2 else "caller").replace("receiver:", "" if i % 2 else "receiver").split()
        a = r.randrange(0, 7)
        docs.append((i, f"{line(5)} {', '.join(w[a : a + r.choice([11, 12, 14])]).upper()} — {line(6)}", 0))
    docs += [(100, None, 0), (101, "", 0), (None, items[0][1], 0), (102, items[0][1], 0), (102, items[0][1], 0)]
    import re

    def windows(t):
        w = re.findall(r"\w+", t.lower())
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    want = set()
    for i, t in items:
        if i is not None and t:
            own = windows(t) | windows(re.sub(r"caller:|receiver:", "", t))
            want |= {(d, i) for d, x, _ in docs if d is not None and x and own & windows(x)}
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string")
    got = leakage.leaks(d, e).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    assert all(r.longest_words >= 12 for r in got)
    assert leakage.without_leaks(d, e).where("doc_id IS NOT NULL").select("doc_id").distinct().count() == 62 + 1 - len({x for x, _ in want})
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0


def test_many_labels_and_parts(spark):
    """Items of many empty label lines stay cheap; items taken in parts give the same."""
    words = [f"w{i}" for i in range(40)]
    many = "\n".join(["caller:", "receiver:"] * 60) + "\n" + "\n".join(f"{'caller' if i % 2 else 'receiver'}: {w}" for i, w in enumerate(words))
    assert len(leakage.item_suffixes(many)) < 200_000
    items = [(1, many), (2, " ".join(words[::-1])), (3, "caller: " + " ".join(words[5:20]))]
    docs = [(1, " ".join(words[3:16])), (2, " ".join(words[::-1][2:15])), (3, "caller w1 receiver w2 caller w3 receiver w4 caller w5 receiver w6 x"), (4, " ".join(words[:11]))]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r.doc_id, r.item_id, r.longest_words) for r in leakage.leaks(d, e).collect()}
    assert whole == {(r.doc_id, r.item_id, r.longest_words) for r in leakage.leaks(d, e, part_chars=50).collect()}
    assert {x[:2] for x in whole} == {(1, 1), (2, 2), (3, 1)}


# ---------------------------------------------------------------- 10


def residue_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, reason int")
    return {r.doc_id: (r.reason, r.route) for r in residue.judged(df, "doc_id", "text", "source").collect()}


ALONE = [
    ("caller: Send {{bank_name}} now", "placeholder"),
    ("caller: [YOUR NAME HERE] is asked", "placeholder"),
    ("caller: the <date of call> and", "placeholder"),
    ("caller: %(REF_NO)s", "placeholder"),
    ("caller: __OTP_CODE__ x", "placeholder"),
    ("caller: a\nreceiver: [object Object]\ncaller: b", "stub"),
    ("caller: TODO: write this turn", "stub"),
    ("asdf, asdf, asdf, asdf, asdf, zavo", "filler"),
    ("your wording soon - your wording soon - your wording soon - vem", "filler"),
    ("Home | Calls | Login\nPlease enable JavaScript to view this transcript. (namo 70979)", "scripts"),
    ("Error 502: the page you asked for at kizodo.example could not be loaded. Go back to the home page or try later.", "error"),
    ('{"error": {"code": 504, "message": "Gateway Timeout", "trace": "tega-101491"}}', "error"),
    ("404 Not Found\nsoma.example proxy, request 95446684", "error"),
    ("caller: [laughs] <sigh> {crosstalk} hello", None),
    ("caller: I pay 404 rupees\nreceiver: it only says page not found, is that normal?", None),
    ("My browser told me to switch on scripts and I do not know how.\n" + "I want to speak with your manager and I will visit the branch.\n" * 3, None),
    ("<|endoftext|> caller: balove hovbur", None),
    ("kolunto sohovsol", None),
    ("  \n", None),
    ("", None),
    (None, None),
]


def test_residue_alone(spark):
    got = residue_of(spark, [(i, t, "a", 1) for i, (t, _) in enumerate(ALONE)])
    assert {i: r for i, (r, _) in got.items()} == {i: r for i, (_, r) in enumerate(ALONE) if r}
    assert all(route == "rule" for _, route in got.values())


def test_residue_counts_across_sources(spark):
    weak = "caller: Hello <Gadget> there"
    notice = "The recording on this page was taken down, case {} of 2031-0{}-11."  # masked, these are one unit; no strong rule knows it
    rows = [(i, weak, s, 1) for i, s in enumerate(["a", "b", None])] + [(10, "caller: hi <Other>", "a", 1), (11, None, "a", 1), (None, "TODO: x", "a", 1), (12, "Error 404: page not found", "a", 1), (12, "Error 404: page not found", "b", 1)]
    rows += [(20 + i, notice.format(i * 977, i), "abc"[i % 3], 1) for i in range(1, 5)] + [(30, "The tape on that page was lost by us.", "a", 1)]
    rows += [(40 + i, "caller: " + notice.format(i, i), "abc"[i % 3], 1) for i in range(1, 5)]  # spoken, so no message
    got = residue_of(spark, rows)
    assert got == {**{i: ("placeholder", "group") for i in range(3)}, 12: ("error", "rule"), **{20 + i: ("error", "group") for i in range(1, 5)}}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, reason int")
    assert residue.residue(df.limit(0), "doc_id", "text", "source").count() == 0
    told = {(r.reason, r.n_docs, r.n_sources): r.message for r in residue.messages(df, "doc_id", "text", "source").collect()}
    assert "case 0 of 0" in told["error", 8, 3] and ("placeholder", 3, 3) in told


def test_mock_text_of_unknown_words(spark):
    r = random.Random(9)
    mock = "zwelg print osmar tulde vekon abrix folda mirne".split()
    speech = [f"the person said that you must {r.choice(['pay', 'wait', 'call'])} for it and {x}" for x in "abcdefghij"]
    rows = [(i, " ".join(r.choice(mock) for _ in range(14)), "ab"[i % 2], 1) for i in range(12)]
    rows += [(100 + i, "caller: " + r.choice(speech) + " " + r.choice(speech), "ab"[i % 2], 1) for i in range(60)]
    rows += [(200, "caller: " + " ".join(mock[:3]) + " the person said that you must pay for it", "a", 1), (201, "one two three four five six", "a", 1)]
    assert residue_of(spark, rows) == {i: ("filler", "words") for i in range(12)}


def test_candidates_take_each_context_once(monkeypatch):
    """The context of a place is taken once, and numbers keep the plus or bracket before them."""
    taken, plain = [], identity.context
    monkeypatch.setattr(identity, "context", lambda text, a, b: taken.append((a, b)) or plain(text, a, b))
    text = "please send it to our new Flat 12B, Rosen Gate 4, Sonagarh today."
    assert "street_address" in {e[0] for e in identity.candidates(text)}
    assert len(taken) == len(set(taken))
    assert [(f, text[a:b]) for text in ("at +49 30 1234567.", "at (030) 1234567 now", "code AB12345678x") for f, a, b in identity.numbers(text)] == [
        ("+00 00 0000000", "+49 30 1234567"), ("(000) 0000000", "(030) 1234567"), ("AA00000000A", "AB12345678x")]
