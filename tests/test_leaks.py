"""Corpus-wide near duplicates, checked joins, outside models and sources on small fixtures."""

import json
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callgrain.functions import text as T
from callgrain.operators import cosine as C
from callgrain.operators import joins, remote
from callgrain.plans import leaks
from callgrain.sources import corpus as sources
from callgrain.sources import sinks


def grams(t, least=3, most=5):
    return Counter(t[i : i + n] for n in range(least, most + 1) for i in range(len(t) - n + 1))


def brute(texts, sublinear, min_df=2):
    """Unit TF-IDF vectors of {id: text}."""
    tf = {i: grams(t) for i, t in texts.items()}
    df = Counter(g for c in tf.values() for g in c)
    n = sum(1 for c in tf.values() if c)
    out = {}
    for i, c in tf.items():
        v = {g: (1 + math.log(k) if sublinear else k) * (math.log((1 + n) / (1 + df[g])) + 1) for g, k in c.items() if df[g] >= min_df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[i] = {g: x / norm for g, x in v.items()}
    return out


def dot(a, b):
    return sum(x * b.get(g, 0) for g, x in a.items())


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    words = [f"w{i}{c}" for i in range(60) for c in "abc"]
    base = [" ".join(r.choice(words) for _ in range(r.choice([6, 20, 40]))) for _ in range(25)]
    rows = []
    for t in base:
        w = t.split()
        rows += [t, t.upper() + "  ", " ".join(w[:-1]), " ".join([*w[:3], "nue", *w[3:]]), " ".join(w[: len(w) // 2])]
    rows += [base[0]] * 40 + [None, "", "  ", "ab", "ab"]
    rows = [(i, t, r.choice(["a", "b", None]), r.choice(["train", "test", "val"])) for i, t in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "rec_id bigint, text string, true_class string, split string").repartition(3)


def test_gram_counts():
    texts = ["aab aab", "", "ab\0cd", "नमस्ते"]
    doc, gram, n = C.gram_counts(texts, 2, 3)
    for i, t in enumerate(texts):
        want = Counter(g for p in t.split("\0") for g in grams(p, 2, 3).elements())
        assert sorted(n[doc == i]) == sorted(want.values())
    assert len(C.gram_counts([""], 3, 5)[0]) == 0


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_near_pairs_against_brute_force(docs, threshold):
    rows, df = docs
    norm = lambda t: " ".join(t.lower().split())  # noqa: E731  what template_text does to these texts
    held = {}
    for i, t, *_ in rows:
        if t and t.strip():
            held.setdefault(norm(t), i)
    v = brute({i: t for t, i in held.items()}, True)
    want = {(a, b): dot(v[a], v[b]) for a in v for b in v if a < b and dot(v[a], v[b]) >= threshold}
    members, pairs = leaks.near_pairs(df, threshold)
    got = {(r.a, r.b): r.cosine for r in pairs.collect()}
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # clusters: every member of a group of two or more, the largest first
    group = {i: i for i in held.values()}
    for _ in range(30):
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    node = {i: held[norm(t)] for i, t, *_ in rows if t and t.strip()}
    size = Counter(group[n] for n in node.values())
    clusters = {}
    for r in leaks.ranked_clusters(members, pairs).collect():
        clusters.setdefault(r.cluster_id, []).append((r.rec_id, r.cluster_size))
    assert sorted(x for m in clusters.values() for x, _ in m) == sorted(i for i, n in node.items() if size[group[n]] > 1)
    ranked = sorted(((-k, g) for g, k in size.items() if k > 1))
    assert [(len(clusters[i + 1]), min(x for x, _ in clusters[i + 1])) for i in range(len(ranked))] == [(-k, min(i for i, n in node.items() if group[n] == g)) for k, g in ranked]


def test_train_test_pairs_against_brute_force(docs):
    rows, df = docs
    held, sides = {}, {}
    for i, t, _, s in rows:
        if t and t.strip() and s in ("train", "test"):
            k = " ".join(t.lower().split())
            held.setdefault(k, i)
            sides.setdefault(held[k], {"train": [], "test": []})[s].append(i)
    v = brute({i: t for t, i in held.items()}, False)
    want = {}
    for a in v:
        for b in v:
            c = dot(v[a], v[b]) if a != b else 1.0
            if sides[a]["train"] and sides[b]["test"] and c >= 0.8:
                want[min(sides[a]["train"]), min(sides[b]["test"])] = (len(sides[a]["train"]), len(sides[b]["test"]), c)
    got = {(r.train_id, r.test_id): (r.n_train, r.n_test, r.cosine) for r in leaks.train_test_pairs(df, 0.8).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-4 for k in want)


def test_no_texts(spark):
    none = spark.createDataFrame([], "rec_id bigint, text string, true_class string, split string")
    assert leaks.train_test_pairs(none).count() == 0
    rows, pairs = leaks.near_pairs(none)
    assert leaks.ranked_clusters(rows, pairs).count() == 0


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('```json\n{"label": "loan"}\n```', ("Loan", True, "")),
        ('Sure: {"label": "Bank", "x": 1} ok', ("Bank", True, "")),
        ("{'label': 'bank'} and so on", ("Bank", True, "")),
        ('{"label": "Lottery"}', ("Lottery", False, "label not allowed")),
        (" LOAN ", ("Loan", True, "")),
        ("I can't say", (None, False, "no label found")),
        ("", (None, False, "empty reply")),
        (None, (None, False, "empty reply")),
    ],
)
def test_parsed_reply(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    assert tuple(df.select(T.parsed_reply(F.col("r"), ["Bank", "Loan"]).alias("p")).first().p) == want


@pytest.mark.parametrize(("reply", "want"), [("1_bank", "1_bank"), ("Class: 2_loan!", "2_loan"), ("loan.", "2_loan"), ("a 1_bank and 2_loan and 2_loan case", "2_loan"), ("nothing", "1_bank"), (None, None)])
def test_nearest_class(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(T.nearest_class(F.col("r"), ["1_bank", "2_loan"]).alias("c")).first().c == want


def test_verdicts(spark):
    good = json.dumps(dict.fromkeys(remote.VERDICT_FIELDS, True) | {"label": "TUTORIAL", "confidence": "0.5", "reason": "r"})
    bad = {"a": good, "b": good.replace("TUTORIAL", "SONG"), "c": good.replace("is_reenactment", "other"), "d": "no json"}
    rows = spark.createDataFrame([("1", "a", None), ("2", "b", "x"), ("3", "c", ""), ("4", "d", ""), ("5", "a", "REJECT_TOO_SHORT"), ("6", None, None)], "key string, text string, pre string")
    got = {r.key: (r.llm_label, r.llm_status[:6]) for r in remote.transcript_verdicts(rows, "key", "text", "pre", bad.__getitem__).collect()}
    assert got == {"1": ("TUTORIAL", "OK"), "2": ("UNCLEAR", "ERROR:"), "3": ("UNCLEAR", "ERROR:"), "4": ("UNCLEAR", "ERROR:"), "5": ("REJECT", "SKIPPE"), "6": ("UNCLEAR", "no tex")}


def test_typed_decisions(spark):
    calls = Counter()

    def client(t):
        calls[t] += 1
        if t == "busy" and calls[t] < 3 or t == "always":
            raise remote.Busy
        if t == "broken":
            raise OSError("x")
        return {"choice": "OTHER" if t != "odd" else "Elsewhere", "confidence": 0.5, "probabilities": {"other": 0.5}}

    rows = spark.createDataFrame([(t,) for t in ("ok", "busy", "always", "broken", "odd", None)], "text string").withColumn("key", F.coalesce("text", F.lit("none"))).coalesce(1)
    got = {r.key: (r.label, (r.error or "")[:12], r.attempts) for r in remote.typed_decisions(rows, "key", "text", client, ["other"], tries=4, wait=0).collect()}
    assert got == {"ok": ("other", "", 1), "busy": ("other", "", 3), "always": (None, "MAX_RETRIES_"[:12], 4), "broken": (None, "CONNECTION_E", 1), "odd": ("Elsewhere", "UNRECOGNIZED", 1), "none": (None, "no text", 0)}


def test_generation_gives_up(spark):
    rows = spark.range(30).select(F.lit("x").alias("class"), F.col("id").alias("number")).coalesce(1)
    got = remote.generated(rows, lambda c, k: None if k > 2 else f"{c}{k}", tries=2, give_up=5).orderBy("number").collect()
    assert [r.text for r in got[:4]] == ["x0", "x1", "x2", None]
    assert sum(r.attempts for r in got) == 3 + 5 * 2 and got[-1].attempts == 0


def test_checked_joins(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string"), spark.createDataFrame([(1, "q"), (3, "r")], "k int, y string")
    assert sorted(map(tuple, joins.left_join_once(a, b, "k").collect()), key=str) == [(1, "a", "q"), (2, "b", None), (None, "c", None)]
    for x, y in ((a.union(a), b), (a, b.union(b))):
        with pytest.raises(Exception, match="isn't unique"):
            joins.left_join_once(x, y, "k").collect()
    assert [tuple(r) for r in joins.checked_inner(a.where("k = 1"), b, "k").collect()] == [(1, "a", "q")]
    with pytest.raises(Exception, match="no partner"):
        joins.checked_inner(a, b, "k").collect()


def test_files_by_path(spark):
    files = spark.createDataFrame([("x/a.txt",), ("y/a.txt",), ("/abs/b.txt",)], "path string")
    wanted = spark.createDataFrame([("/abs/b.txt",), ("y/a.txt",), ("a.txt",), ("/gone/a.txt",), ("z/c.txt",)], "source string")
    got = {r.source: r.path for r in joins.by_path(wanted, files).collect()}
    assert got == {"/abs/b.txt": "/abs/b.txt", "y/a.txt": "y/a.txt", "a.txt": "x/a.txt", "/gone/a.txt": None, "z/c.txt": None}


def test_more_sources(spark, tmp_path):
    for c, t in (("bank", "one"), ("bank", "  "), ("loan", "x" * 50)):
        (tmp_path / "root" / c).mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / c / f"{len(t)}.txt").write_text(t)
    classes = spark.createDataFrame([(1, "bank"), (2, "loan"), (3, "none")], "class_no int, slug string")
    rows = sources.class_folders(spark, str(tmp_path / "root"), "train", classes)
    own = sources.labelled_corpus(rows, classes, keep_blank=False, most_chars=10)
    assert sorted((r.class_no, r.char_len) for r in own.collect()) == [(1, 3), (2, 10)]
    with pytest.warns(UserWarning, match="none"):
        assert sources.checked_corpus(rows, classes).count() == 3
    with pytest.raises(ValueError, match="none"):
        sources.checked_corpus(rows, classes, required=True)
    with pytest.raises(ValueError, match="any class"):
        sources.checked_corpus(rows.limit(0), classes)
    (tmp_path / "t.csv").write_text('a,b\n1,"x, ""y"""\n')
    assert [tuple(r) for r in sources.csv_rows(spark, str(tmp_path / "t.csv"), "a int, b string").collect()] == [(1, 'x, "y"')]
    assert {r.name: r.found for r in sources.input_manifest(spark, str(tmp_path), ["t.csv", "u.csv"]).collect()} == {"t.csv": True, "u.csv": False}
    (tmp_path / "log.json").write_text(json.dumps([{"k": "a", "n": 1}, {"k": "a", "n": 2}, {"n": 3}]))
    assert [tuple(r) for r in sources.log_or_array(spark, str(tmp_path / "log.json"), "k string, n int", "k", "n").collect()] == [("a", 2)]
    for n in (3, 5):
        sinks.replace_table(spark.range(n), str(tmp_path / "table"))
        assert spark.read.parquet(str(tmp_path / "table")).count() == n


def test_padding(spark):
    from callgrain.operators import bpe

    try:
        rows = bpe.padded(spark.createDataFrame([(1, "one two three four five six seven eight"), (2, ""), (3, None)], "id bigint, text string"), "id", "text", size=6).orderBy("id").collect()
    except Exception:
        pytest.skip("no vocabulary file")
    assert [len(r.ids) for r in rows] == [6, 6, 6]
    assert [sum(r.mask) for r in rows] == [6, 2, 2] and [r.truncated for r in rows] == [True, False, False]
    assert rows[0].ids[0] == rows[1].ids[0] and rows[1].ids[1] == rows[0].ids[5] == rows[0].ids[0] + 1 and rows[1].ids[2:] == [rows[0].ids[0] + 2] * 4


def test_cosine_join_in_parts(spark, docs, monkeypatch):
    """Terms and texts in many small parts give the pairs that one part gives, with sides and without."""
    rows, _ = docs
    texts = {" ".join(t.lower().split()): i for i, t, *_ in rows if t and t.strip()}
    df = spark.createDataFrame([(i, t) for t, i in texts.items()], "id bigint, text string").repartition(3)
    v = brute({i: t for t, i in texts.items()}, True)
    want = {(a, b): dot(v[a], v[b]) for a in v for b in v if a != b and dot(v[a], v[b]) >= 0.7}
    some, other = (spark.createDataFrame([(i,) for i in v if i % 3 in k], "id bigint") for k in ((0, 1), (1, 2)))
    for terms, many in ((2_000_000, 32_000), (1500, 20)):
        monkeypatch.setattr(C, "PART_TERMS", terms)
        monkeypatch.setattr(C, "PART_TEXTS", many)
        got = {(r.a, r.b): r.cosine for r in C.cosine_join(df, 0.7).collect()}
        assert got.keys() == {p for p in want if p[0] < p[1]} and all(abs(got[p] - want[p]) < 1e-9 for p in got)
        got = {(r.a, r.b) for r in C.cosine_join(df, 0.7, True, some, other).collect()}
        assert got == {(a, b) for a, b in want if a % 3 != 2 and b % 3 != 0}


def test_sizes_and_lengths_of_texts(spark, docs):
    """No pair at the threshold is told apart by sizes, most others are; a row of lengths takes two bytes a bucket."""
    rows, _ = docs
    texts = {" ".join(t.lower().split()): i for i, t, *_ in rows if t and t.strip()}
    df = spark.createDataFrame([(i, t) for t, i in texts.items()], "id bigint, text string").repartition(3)
    for sublinear in (True, False):
        v = brute({i: t for t, i in texts.items()}, sublinear)
        parts = C.term_parts(C.counted_grams(df), sublinear)
        held = {r.id: r for r in C.sketches(df, parts, 0.8, sublinear).collect()}
        fits = {(a, b) for a in held for b in held if held[a].least <= held[b].size and held[b].least <= held[a].size}
        assert held.keys() == {i for i in v if v[i]} and {(a, b) for a in v for b in v if dot(v[a], v[b]) >= 0.8} <= fits
        assert len(fits) < 0.6 * len(v) ** 2
        assert max(len(r.lengths) for r in held.values()) < 2000


def test_counted_grams_of_many_batches():
    """Counts and least hashes are the same however often new grams are taken into the table."""
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([0, 5, 300]))) for _ in range(400)]
    hashes = C._hashed(C.np.arange(len(texts)))
    want = {}
    for t, h in zip(texts, hashes.tolist()):
        for g in set(C.gram_counts([t], 3, 5)[1].tolist()):
            n, least = want.get(g, (0, h))
            want[g] = n + 1, min(least, h)
    for every in (400, 7):
        counted = C._Counted()
        for lo in range(0, len(texts), every):
            order = lo + C.np.argsort(hashes[lo : lo + every])[::-1]
            doc, gram, _ = C.gram_counts([texts[i] for i in order], 3, 5)
            counted.add(doc, gram, hashes[order])
            if every == 7:
                counted.fold()
        (gram, n, least), = counted.take()
        assert dict(zip(gram.tolist(), zip(n.tolist(), least.tolist()))) == want


def test_one_part_at_a_time_on_disk(spark, docs, monkeypatch):
    """What is sent of texts is removed again before the next part is sent."""
    sent, made = [], spark.sparkContext.broadcast

    def broadcast(value):
        held = made(value)
        if isinstance(value, C.Lengths):
            assert not any(os.path.exists(path) for path in sent)
            sent.append(held._path)
        return held

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    monkeypatch.setattr(C, "PART_TEXTS", 20)
    assert leaks.train_test_pairs(docs[1], 0.8).count() > 0
    assert len(sent) > 1 and not any(os.path.exists(path) for path in sent)


@pytest.mark.parametrize("letters", ["ab ", "".join(map(chr, range(0x20, 0x900))), "a’₹中\U0001f600 ༅"])
def test_gram_table_of_few_and_many_characters(letters):
    """Counts are those of brute force, texts of a gram come in order, and a gram has one number whatever texts it stands beside."""
    r = random.Random(2)
    texts = ["".join(r.choice(letters) for _ in range(r.choice([0, 2, 3, 5, 60]))) for _ in range(120)]
    gram, many, doc, n = C.gram_table(texts, 3, 5)
    starts = C.np.cumsum(many) - many
    want = {}
    for i, t in enumerate(texts):
        for g, k in grams(t).items():
            want.setdefault(g, []).append((i, k))
    got = [list(zip(doc[a : a + k].tolist(), n[a : a + k].tolist())) for a, k in zip(starts.tolist(), many.tolist())]
    assert sorted(got) == sorted(want.values()) and len(set(gram.tolist())) == len(want)
    numbers = lambda *t: set(C.gram_table(list(t), 3, 5)[0].tolist())
    assert numbers(texts[0] + "abcd") | numbers("xyz 中") == numbers(texts[0] + "abcd", "xyz 中")


def test_blocks_hold_rows_of_like_sizes():
    """Rows dealt out to strips leave fewer rows of a part to be multiplied with each block; the pairs are all there."""
    r = C.np.random.default_rng(1)
    size = r.uniform(1, 9, 2000)
    batch = C.pa.RecordBatch.from_arrays([C.pa.array(range(2000)), C.pa.array(size), C.pa.array(size * r.uniform(0.1, 1, 2000)), C.pa.array([b"\x00\x00\x80\xff"] * 2000)], ["id", "size", "least", "lengths"])

    def area(x):
        blocks = [slice(k, k + 100) for k in range(0, 2000, 100)]
        return sum(int(((size >= x.least[b].min()) & (batch.column(2).to_numpy() <= x.size[b].max())).sum()) for b in blocks)

    assert area(C.Lengths(batch, 5)) < 0.9 * area(C.Lengths(batch))
    held = C.Lengths(batch, 5)
    assert sorted(held.ids.tolist()) == list(range(2000)) and all(held.size[i] == size[k] for i, k in enumerate(held.ids))


def test_folded_lengths_bound_the_unfolded():
    """Each folding of the buckets gives a product that is never below that of the next, and of the lengths themselves."""
    r = C.np.random.default_rng(2)
    squares = C.np.where(r.random((60, C.WIDE + C.TIMES)) < 0.08, r.random((60, C.WIDE + C.TIMES)), 0)
    x = C.Lengths(C._sketched(C.np.arange(60), squares, 0.9, True), 3).open()
    narrow, middle, wide = (v.astype(float) @ v.T.astype(float) for v in (x.narrow, x.middle, x.wide(0, 60)))
    assert x.middle.shape == (60, C.MIDDLE) and (narrow >= middle - 1e-5).all()
    common = x.wide(0, 60)[:, 1 : C.COMMON_WIDE].astype(float)
    assert (middle >= wide - common @ common.T + x.middle[:, :1] @ x.middle[:, :1].T - 1e-5).all()
