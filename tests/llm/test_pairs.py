"""Problems 2, 3 and 5 against brute force on small fixtures."""

import json
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callgrain.llm import bags, layout
from callgrain.llm import textcodes as tc
from callgrain.llm.layout import content_groups, parse_record
from callgrain.llm.neardup import near_groups, near_pairs
from callgrain.llm.splits import cross_split_pairs, overlap_report

WORDS = [f"w{i}" for i in range(4000)]


def bag(text):
    return Counter(re.findall(r"[^\W_]+", text.casefold()))


def overlap(a, b):
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def letters(text):
    return "".join(c for c in text.casefold() if c.isalnum())


@pytest.fixture(scope="module")
def corpus(spark):
    """A third of all rows is one text; others are copies, edits, moved turns and strangers."""
    r = random.Random(3)
    base = [" ".join(r.choice(WORDS) for _ in range(r.choice([8, 40, 90]))) for _ in range(40)]
    texts = []
    for t in base:
        texts.append(t)
        w = t.split()
        texts.append(" ".join(w[: len(w) // 2 * 2][::-1]))  # moved
        texts.append(", ".join(w).upper())  # layout alone
        w2 = list(w)
        for _ in range(max(1, len(w) // 20)):
            w2[r.randrange(len(w2))] = r.choice(WORDS)
        texts.append(" ".join(w2))
        texts.append(" ".join(w[: int(len(w) * 0.6)]))
    texts += [base[0]] * 60 + [None, "", "  ", "?!", "one", "one", "One!"]
    rows = [(i, t, r.choice(["train", "val", "test", "external", None]), r.choice("st"), 1) for i, t in enumerate(texts)]
    rows.append((None, base[1], "train", "s", 1))
    return rows, spark.createDataFrame(rows, "rec_id bigint, text string, split string, source string, row_id int").repartition(3)


def near(rows):
    out = set()
    own = [(i, t, s) for i, t, s, *_ in rows if i is not None and t and bag(t)]
    for (i, a, _), (j, b, _) in combinations(own, 2):
        if letters(a) != letters(b) and overlap(a, b) >= 0.8:
            out.add((min(i, j), max(i, j)))
    return out


def test_near_pairs(corpus):
    rows, df = corpus
    assert {(r.rec_id_a, r.rec_id_b) for r in near_pairs(df, "rec_id", "text").collect()} == near(rows)


def test_content_groups(corpus):
    rows, df = corpus
    held = {}
    for i, t, *_ in rows:
        if i is not None and t and letters(t):
            held.setdefault(letters(t), []).append(i)
    want = {(min(v), len(v)) for v in held.values() if len(v) > 1}
    assert {(r.keep_id, r.n_copies) for r in content_groups(df, "rec_id", "text").collect()} == want


def test_cross_split_pairs(corpus):
    rows, df = corpus
    split = {i: s for i, _, s, *_ in rows}
    want = set()
    for (i, a, s), (j, b, t) in combinations([(i, t, s) for i, t, s, *_ in rows if i is not None and t and bag(t) and s], 2):
        if (s == "train") != (t == "train") and (letters(a) == letters(b) or overlap(a, b) >= 0.8):
            want.add((min(i, j), max(i, j)))
    got = {(r.rec_id_a, r.rec_id_b) for r in cross_split_pairs(df, "rec_id", "text", "split").collect()}
    assert got <= want
    assert len(got) >= 0.99 * len(want)
    told = overlap_report(df, "rec_id", "text", "split", "source").collect()
    assert sum(r.pairs for r in told) == len(got)
    assert sum(r.rows for r in told) == len({i for p in got for i in p if split[i] != "train"})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "rec_id bigint, text string, split string, bag string, n int, cls string")
    assert near_pairs(none, "rec_id", "text").count() == 0
    assert content_groups(none, "rec_id", "text").count() == 0
    assert cross_split_pairs(none, "rec_id", "text", "split").count() == 0


FIELDS = {"case": "AB-12", "Firm": "Zoza Bank", "loss": "12,000", "reply": "Wait, let me see"}
NOTATIONS = [
    "\n".join(f"{k}: {v}" for k, v in FIELDS.items()),
    " | ".join(f"{k.upper()} - {v}" for k, v in reversed(FIELDS.items())),
    "; ".join(f"{k}={v}" for k, v in sorted(FIELDS.items())),
    json.dumps(dict(reversed(FIELDS.items()))),
    "- " + "\n- ".join(f"“{k}”:   {v.lower()}" for k, v in FIELDS.items()),
]


def test_records_in_any_notation(spark):
    trees = [parse_record(t) for t in NOTATIONS]
    assert all(t == trees[0] for t in trees)
    flat = " ".join(f"{k} {v}" for k, v in FIELDS.items())  # the first one's letters, without its marks
    other = NOTATIONS[0].replace("12,000", "12,001")
    rows = [*enumerate([*NOTATIONS, flat, other, other.upper(), "caller: a\nreceiver: b\nagent: c"])]
    got = {(r.keep_id, r.n_copies) for r in content_groups(spark.createDataFrame(rows, "rec_id bigint, text string"), "rec_id", "text").collect()}
    assert got == {(0, 6), (6, 2)}


@pytest.mark.parametrize("text", ["caller: a\nreceiver: b\nagent: c", "a: 1", "a: 1\na: 2\na: 3", "", "x", "{}", "{bad: 1, ", "a: 1\nb\nc: 2"])
def test_what_is_no_record(text):
    assert parse_record(text) is None


def test_white_space_and_names():
    long = "a name of many words that is longer than any field name should be"
    for a, b in [("\n\n loss: 40\ncase: 1\nfirm: abc", "firm: abc\nloss: 40\ncase: 1\n"), ('{\n  "a": 1,\n  "b": 2\n}', '{"b": 2, "a": 1}'), ("a: 1\nb: 2", "b=2; a=1"), (f"{long}: x\ny: z", f"y: z | {long.upper()}: x")]:
        assert parse_record(a) is not None and parse_record(a) == parse_record(b)


def test_repeated_keys_stay():
    a, b = parse_record('{"a": 1, "a": 2, "b": 3, "c": 4}'), parse_record('{"a": 2, "b": 3, "c": 4}')
    assert a != b and layout.merkle(a) != layout.merkle(b)
    assert a == parse_record('{"c": 4, "a": 2, "b": 3, "a": 1}')


def test_letter_groups(corpus):
    rows, df = corpus
    held = {}
    for i, t, *_ in rows:
        if i is not None and t and letters(t):
            held.setdefault(letters(t), []).append(i)
    got = {(r.keep_id, r.n_copies) for r in layout.letter_groups(df, "rec_id", "text").collect()}
    assert got == {(min(v), len(v)) for v in held.values() if len(v) > 1}


def test_nested_records():
    a = parse_record('{"a": {"x": [1, 2], "y": "Z"}, "b": null, "c": "q"}')
    assert a == parse_record('{"c": "Q!", "b": "", "a": {"y": "z", "x": ["1", "2"]}}')
    assert layout.merkle(a) != layout.merkle(parse_record('{"c": "Q!", "b": "", "a": {"y": "z", "x": ["2", "1"]}}'))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_words_and_bags(texts):
    w, b = tc.words_of(texts), tc.bags_of(texts)
    table = tc.word_table()
    for i, t in enumerate(texts):
        want, run = [], ""
        for c in t.casefold() + " ":
            if table[ord(c)]:
                run += c
            elif run:
                want.append(run)
                run = ""
        assert (w.doc == i).sum() == len(want) == b.size[i]
        single = tc.bags_of([" ".join(reversed(want))])
        assert (single.key_a[0], single.key_b[0]) == (b.key_a[i], b.key_b[i])
    digests = list(zip(*tc.sequence_digests(w)))
    plain = ["".join(c for c in t.casefold() if table[ord(c)]) for t in texts]
    for (i, x), (j, y) in combinations(enumerate(plain), 2):
        assert (digests[i] == digests[j]) == (x == y)


def template_texts(n_template, n_own):
    """Texts of one frequent template that share no rare word."""
    template = [f"t{i}" for i in range(n_template)]
    return [" ".join(template + [f"o{k}x{i}" for i in range(n_own)]) for k in range(150)]


@pytest.mark.parametrize(("n_template", "n_own"), [(20, 1), (60, 6), (95, 5), (190, 20), (9, 1), (4, 1)])
def test_pairs_of_a_frequent_template(spark, n_template, n_own):
    rows = [(i, t, "train" if i % 2 else "val") for i, t in enumerate(template_texts(n_template, n_own))]
    noise = [(1000 + i, " ".join(f"n{i}x{j}" for j in range(30)), "train") for i in range(100)]
    df = spark.createDataFrame(rows + noise, "rec_id bigint, text string, split string").repartition(3)
    holds = n_template / (n_template + 2 * n_own) >= 0.8
    want = {(i, j) for i, j in combinations(range(150), 2) if holds and i % 2 != j % 2}
    assert {(r.rec_id_a, r.rec_id_b) for r in cross_split_pairs(df, "rec_id", "text", "split").collect()} == want
    near = near_pairs(df, "rec_id", "text").collect()
    assert {(r.rec_id_a, r.rec_id_b) for r in near} == {(i, j) for i, j in combinations(range(150), 2) if holds}


def test_near_groups(corpus):
    rows, df = corpus
    pairs = near(rows)
    links = Counter(i for p in pairs for i in p)
    group = {i: i for i in links}
    while any(group[i] != group[j] for i, j in pairs):
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    got = near_groups(df, "rec_id", "text").collect()
    assert sorted((r.rec_id, r.group_id, r.n_links) for r in got) == sorted((i, group[i], n) for i, n in links.items())
    assert near_groups(df.limit(0), "rec_id", "text").count() == 0


@pytest.mark.parametrize("rows_a_batch", [7, 5000])
def test_pairs_within_lists(rows_a_batch):
    """Lists over many batches, long and short: each pair that may overlap comes out once a list, but not one of two texts
    that stand there for larger ones alone."""
    r = np.random.default_rng(5)
    entries = []
    for value, size in enumerate([1, 2, 3, 40, bags.SHORT, bags.SHORT + 1, 700, 1, 5]):
        base = r.integers(-(2**63), 2**63, 4)
        for i in r.permutation(1000)[:size]:
            code = base ^ (np.int64(1) << r.integers(0, 64, 4)) if r.random() < 0.5 else r.integers(-(2**63), 2**63, 4)
            n = int(r.integers(80, 140))
            entries.append((value - 4, int(i), -n if r.random() < 0.3 else n, *map(int, code)))
    entries.sort(key=lambda x: (x[0], -x[2]))
    want = Counter()
    for x, y in combinations(entries, 2):
        n, m = abs(x[2]), abs(y[2])
        apart = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x[3:], y[3:]))
        if x[0] == y[0] and (x[2] > 0 or y[2] > 0) and 5 * n >= 4 * m and 5 * m >= 4 * n and 9 * apart <= n + m:
            want[min(x[1], y[1]), max(x[1], y[1])] += 1
    table = pa.table({"value": [x[0] for x in entries], "bag_id": [x[1] for x in entries], "n": pa.array([x[2] for x in entries], pa.int32())} | {c: pa.array([x[3 + k] for x in entries], pa.int64()) for k, c in enumerate(bags.CODES)})
    got = Counter(p for b in bags._met(table.combine_chunks().to_batches(rows_a_batch)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert got == want and len(want) > 1000


def test_lists_for_larger_texts():
    """A text of which no partner reaches the next band of sizes stands in lists of its own band alone."""
    common = np.sort(tc.bags_of([" ".join(f"c{i}" for i in range(400))]).element)
    share = np.full(len(common), 0.5)
    for n in range(20, 300, 7):
        b = tc.bags_of([" ".join(f"c{i}" for i in range(n))])
        doc, value, top, low = bags.lists_of(b, 1, common, share)
        band = np.searchsorted(bags._BANDS, n, "right")
        assert low.any() == (5 * n // 4 >= bags._BANDS[band]) and set(top[~low]) == {bags._BANDS[band] - 1}
