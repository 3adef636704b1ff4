import random

import pytest
from pyspark.sql import functions as F

from callgrain.operators import similarity as S
from callgrain.operators.ranking import digest_slice, place_in_group, seeded_order
from callgrain.operators.remote import classify_rows
from callgrain.plans.metrics import per_class
from callgrain.sources import corpus, sinks
from callgrain.streaming.windows import first_loads, tumbling_totals


def test_place_in_group_is_a_row_number(spark):
    t = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, "hot").alias("k"), F.lit(0).alias("place_")).withColumn("o", seeded_order("s", F.col("id")))
    got = {(r.k, r.o): r.place for r in place_in_group(t, ["k"], "o", digest_slice("o")).collect()}
    for k in ("hot", None):
        own = sorted(o for x, o in got if x == k)
        assert [got[k, o] for o in own] == list(range(1, len(own) + 1))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (20, 21), (21, 22), (20, 22), (7, 7)]
    got = {r.node: r.component for r in S.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}


def test_components_of_a_long_path(spark):
    n = 200
    got = {r.component for r in S.components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).collect()}
    assert got == {0}


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """Components of few edges come from the driver, the same as those of the rounds, and no rounds are run for them."""
    r = random.Random(9)
    edges = [(r.randrange(3000) - 1000, r.randrange(3000) - 1000) for _ in range(1400)] + [(5, 5), (7, 6), (7, 6)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    monkeypatch.setattr(S, "FEW_EDGES", 0)
    want = {r.node: r.component for r in S.components(df).collect()}
    monkeypatch.setattr(S, "FEW_EDGES", 200_000)
    monkeypatch.setattr(S, "MOST_ROUNDS", 0)
    got = S.components(df).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want) > 1000


def test_components_of_nothing(spark):
    assert S.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("rare", [1, 2, 4, 50])
def test_cosine_pairs_are_exact(spark, rare):
    words = ["a b c d e", "a b c d f", "a b x y z", "q r s", "q r s t", "a", "a b", "c d e f", ""]
    rows = [(i, w) for i, t in enumerate(words) for w in t.split()]
    v = S.tfidf(spark.createDataFrame(rows, "id bigint, term string"), min_df=1)
    held = {}
    for r in v.collect():
        held.setdefault(r.id, {})[r.term] = r.w
    want = {(a, b) for a in held for b in held if a < b and sum(w * held[b].get(t, 0) for t, w in held[a].items()) >= 0.4}
    assert {(r.a, r.b) for r in S.cosine_pairs(v, 0.4, rare).collect()} == want


def test_tfidf_limits(spark):
    rows = [(1, "x"), (1, "y"), (2, "x"), (3, "x"), (3, "z"), (3, "z")]
    v = S.tfidf(spark.createDataFrame(rows, "id bigint, term string"), min_df=1, max_share=0.9)
    assert {r.term for r in v.collect()} == {"y", "z"}
    assert {r.term for r in S.tfidf(spark.createDataFrame(rows, "id bigint, term string"), min_df=1, max_terms=1).collect()} == {"x"}


def test_per_class_edges(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "zzz"), ("b", "a"), ("b", None)], "gold string, pred string").withColumn("k", F.lit(1))
    got = {r.label: r for r in per_class(rows, ["k"], spark.createDataFrame([("a",), ("b",), ("c",)], "label string")).collect()}
    assert (got["a"].precision, got["a"].recall) == (0.5, 0.5)
    assert (got["b"].f1, got["b"].support, got["c"].support, got["c"].f1) == (0.0, 2, 0, 0.0)


def test_remote_resumes_and_retries(spark):
    def client(texts):
        if any("bad" in t for t in texts):
            return ["?"] * len(texts)
        return ["x"] * len(texts)

    todo = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "d")], "id bigint, text string").coalesce(1)
    done = spark.createDataFrame([("4", "x", True), ("1", None, False)], "key string, label string, valid boolean")
    got = {r.key: (r.label, r.valid) for r in classify_rows(todo, done, "id", "text", client, ["x"], tries=2).collect()}
    assert got == {"1": ("x", True), "2": (None, False), "3": (None, False)}


def test_sources(spark, tmp_path):
    for p, b in (("a/x.txt", b"hi"), ("a/y.TXT", b"a\xffb"), ("b/z.txt", b" \n"), ("b/e.txt", b""), ("q/u.txt", b"no"), ("a/n.md", b"-")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b)
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    rows = corpus.class_folders(spark, str(tmp_path), "train", classes)
    got = {(r.true_class, r.filename): r.text for r in rows.collect()}
    assert got == {("a", "x.txt"): "hi", ("a", "y.TXT"): "a�b", ("b", "z.txt"): " \n"}
    assert [r.slug for r in corpus.missing_classes(rows, classes).collect()] == ["c"]


def test_logs_and_seeds(spark, tmp_path):
    (tmp_path / "log").write_text('{"k": "a", "n": 1}\nbroken\n{"k": "a", "n": 3}\n{"k": "b", "n": 2}\n')
    assert {(r.k, r.n) for r in corpus.record_log(spark, str(tmp_path / "log"), "k string, n int", "k", "n").collect()} == {("a", 3), ("b", 2)}
    (tmp_path / "seed").write_text("fraud\tone\ttwo\nnormal\tx\nfraud\n")
    assert {r.text for r in corpus.seed_lines(spark, str(tmp_path / "seed"), "fraud").collect()} == {"one\ttwo", None}
    (tmp_path / "map").write_text('{"a": "EN", "b": "?"}')
    assert [(r.key, r.label) for r in corpus.json_map(spark, str(tmp_path / "map"), ["EN"]).collect()] == [("a", "EN")]


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2)], "Gold int, p int")
    assert corpus.resolve_column(df, ["true_class", "gold"]) == "Gold"
    assert corpus.resolve_column(df, ["x"], required=False) is None
    with pytest.raises(ValueError, match="none of"):
        corpus.resolve_column(df, ["x"])


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", "caller: x"), ("val", "b", None)], "split string, true_class string, text string")
    sinks.write_folders(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    sinks.rewrite(df, "text", "caller:", "Scammer:", str(tmp_path / "r"))
    assert {r.text for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {"Scammer: x", None}
    sinks.append_log(df, str(tmp_path / "l"))
    sinks.append_log(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_summary(df, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == df.columns


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(200).select((F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 3).alias("k"), F.lit(1.5).alias("v"))
    rows.write.parquet(src)
    batch = {(r.window.start, r.k): (r.n, r.total) for r in tumbling_totals(spark.read.parquet(src), "ts", "1 hour", ["k"], "v").collect()}
    stream = tumbling_totals(spark.readStream.schema(rows.schema).parquet(src), "ts", "1 hour", ["k"], "v")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.window.start, r.k): (r.n, r.total) for r in spark.table("w").collect()} == batch
    assert first_loads(spark.read.parquet(src), "ts", ["k"]).count() == 3
