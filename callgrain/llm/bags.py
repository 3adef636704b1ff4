"""What the pair operators (problems 2 and 5) share: how often words occur, exact overlap, and pairs of rows.

Rows are first folded into nodes, one per (bag of words, content class). Candidates are found between bags, their
overlap is verified exactly, and only pairs that hold are spread over the rows of their nodes.

Candidates miss no pair that overlaps by 0.8: of two texts of x and y words, at most (x + y) / 9 elements stand in one
alone. Elements that aren't common rank first, by hash; a pair that shares one of them shares one among the first
n - ceil(0.8 n) + 1 of either text and meets in its list. In a pair that shares none, all r of them stand in one text
alone. The common elements of a text are dealt out by hash to m parts, one more than the elements that may differ in
its band of sizes, so that some parts are equal; each text leaves out the r parts that tell least, and the pair still
meets in the list of an equal part. Texts of one band meet in its own lists, those of the next larger band in the lists
of that band. Pairs in a list are compared by PARITY bits of parity, which differ in no more places
than the texts have elements of their own; lists of texts of few words carry them folded.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm import textcodes as tc
from callgrain.llm.layout import BROADCAST_IDS

#: Share of bags, and least number, above which an element is common.
COMMON, COMMON_LEAST = 1 / 200, 64
PARITY = 256
#: Most words of texts in lists that carry a quarter of the bits, and a half.
QUARTER, HALF = 100, 200
#: Longest list whose pairs are written out; longer ones are compared in blocks of BLOCK pairs.
SHORT, BLOCK = 48, 1 << 17

CODES = [f"code_{i}" for i in range(PARITY // 64)]
LISTS = "value bigint, bag_id bigint, n int, " + ", ".join(f"{c} bigint" for c in CODES)
#: Least size of each band; texts that overlap by 0.8 lie in one band or in neighbouring ones.
_BANDS = [1]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(_BANDS[-1] * 5 // 4 + 1)
_BANDS = np.array(_BANDS, np.int64)

#: Stands in the counted table for the number of bags.
TOTAL = 0


class Counts:
    """How many bags of a task hold each element; copies within a batch count once. Partial counts that grow too large
    are given out on the way."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held, self.n = 0, 0

    def add(self, b: tc.Bags, n_docs: int, seen: set[int]) -> None:
        fresh = np.zeros(n_docs, bool)
        for i in np.flatnonzero(b.size):
            if (k := int(b.key_a[i])) not in seen:
                seen.add(k)
                fresh[i] = True
        self.n += int(fresh.sum())
        e = np.sort(b.element[fresh[b.doc]])
        at = tc.firsts(e)
        self.keys.append(e[at].view(np.int64))
        self.counts.append(np.diff(np.append(at, len(e))))
        self.held += len(at)
        if self.held > 3_000_000:
            self._fold()

    def _fold(self) -> None:
        k, c = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        at = tc.firsts(k)
        self.keys, self.counts = [k[at]], [np.add.reduceat(c, at)]
        self.held = len(at)

    def full(self) -> bool:
        return self.held > 2_000_000

    def take(self, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(element, n) so far, and at the end the number of bags as well."""
        if self.keys:
            self._fold()
        k, c = (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.keys, self.counts, self.held = [], [], 0
        return (np.append(k, TOTAL), np.append(c, self.n)) if last else (k, c)


def common_elements(counted: DataFrame, share: float, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Elements in more than max(share x bags, least) bags, sorted, with their counts; and the number of bags.

    counted: partial counts (element, n) of all texts. At most (words a text) / share elements can come out, so the size
    of what is sent to all executors doesn't grow with the corpus.
    """
    counted = counted.groupBy("element").agg(F.sum("n").alias("n")).where(F.col("n") > least).cache()
    total = counted.where(F.col("element") == TOTAL).agg(F.max("n")).first()[0] or 0
    got = counted.where((F.col("element") != TOTAL) & (F.col("n") > share * total)).toArrow()
    counted.unpersist()
    element = got.column("element").to_numpy().astype(np.int64).view(np.uint64)
    n = got.column("n").to_numpy().astype(np.int64)
    order = np.argsort(element)
    return element[order], n[order], int(total)


def lists_of(b: tc.Bags, n_docs: int, common: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, value, most words of its texts or 0 for any, whether it stands there for larger texts alone) of the lists
    in which each text of a chunk stands."""
    size = b.size.astype(np.int64)
    at = np.minimum(np.searchsorted(common, b.element), max(len(common) - 1, 0))
    is_common = common[at] == b.element if len(common) else np.zeros(len(b.element), bool)
    rare_doc, rare = b.doc[~is_common], b.element[~is_common]
    n_rare = np.bincount(rare_doc, minlength=n_docs)
    order = np.lexsort((rare, rare_doc))
    rare_doc, rare = rare_doc[order], rare[order]
    place = np.arange(len(rare)) - (np.cumsum(n_rare) - n_rare)[rare_doc]
    first = place < (size - -(-4 * size // 5) + 1)[rare_doc]
    docs, values, tops, lows = [rare_doc[first]], [rare[first]], [np.zeros(int(first.sum()), np.int64)], [np.zeros(int(first.sum()), bool)]
    doc, mixed = b.doc[is_common], tc.mix(b.element[is_common] ^ tc.SEED_B)
    weight = -np.log(np.minimum(share[at[is_common]], 0.999)) if len(common) else np.zeros(0)
    for step in (0, 1):
        band = np.searchsorted(_BANDS, np.maximum(size, 1), "right") - 1 + step
        top = _BANDS[band + 1] - 1
        parts = np.where(size > 0, 2 * top // 9 + 1, 0)
        most = np.minimum(top, 5 * size // 4)  # words of a partner
        keep = np.maximum((size + most) // 9 + 1 - n_rare, 0)
        if step:  # for texts of the next band, of whose words a smaller one misses a ninth of its own at most
            keep[(most < _BANDS[band]) | (n_rare > size // 9)] = 0
        begin = np.cumsum(parts) - parts
        of = np.repeat(np.arange(n_docs), parts)
        to = begin[doc] + (mixed % parts[doc].astype(np.uint64)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        run = tc.firsts(to[order])
        digest = np.zeros(len(of), np.uint64)
        with np.errstate(over="ignore"):
            if len(run):
                digest[to[order][run]] = np.add.reduceat(tc.mix(mixed[order]), run)
            nth = np.arange(len(of)) - begin[of]
            digest = tc.mix(digest + tc.mix(nth.astype(np.uint64) * tc.BASE_B + band[of].astype(np.uint64)))
        told = np.bincount(to, weight, minlength=len(of))
        order = np.lexsort((-told, of))
        picked = order[nth < keep[of]]  # `of` is sorted already, so `nth` are also the places after sorting
        docs.append(of[picked])
        values.append(digest[picked])
        tops.append(top[of[picked]])
        lows.append(np.full(len(picked), bool(step)))
    return np.concatenate(docs), np.concatenate(values), np.concatenate(tops), np.concatenate(lows)


def parity(b: tc.Bags, n_docs: int) -> np.ndarray:
    """PARITY / 64 numbers per text: whether an even or odd number of its elements falls on each of PARITY places."""
    counts = np.bincount(b.doc * PARITY + (b.element % np.uint64(PARITY)).astype(np.int64), minlength=n_docs * PARITY)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n_docs, PARITY), axis=1).view(np.int64)


def _list_batches(common: np.ndarray, share: np.ndarray):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, part in tc.chunks(batch.column(1).to_pylist()):
                b = tc.bags_of(part)
                doc, value, top, low = lists_of(b, len(part), common, share)
                code = parity(b, len(part))[doc]
                for most, width in ((HALF, 2), (QUARTER, 1)):
                    fold = (top > 0) & (top <= most)
                    code[fold, :width] ^= code[fold, width : 2 * width]
                    code[fold, width:] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(ids[first + doc]), pa.array(np.where(low, -b.size[doc], b.size[doc]).astype(np.int32)), *(pa.array(c) for c in code.T.copy())],
                    ["value", "bag_id", "n", *CODES],
                )

    return run


def lists(texts: DataFrame, ids: DataFrame, common: np.ndarray, share: np.ndarray) -> DataFrame:
    """LISTS of the bags whose ids are in ids (bag_id); texts: (row_id, text). n is the number of words, below 0 where the
    text stands in the list for larger texts alone: two such texts meet in a list of their own band."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    need = ids.select(F.col("bag_id").alias("row_id"))
    own = texts.join(F.broadcast(need) if small else need, "row_id", "left_semi").select("row_id", "text")
    return own.mapInArrow(_list_batches(common, share), LISTS)


def meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of bags, from the left and from the right, that meet in a list and may overlap by 0.8."""
    a = left.select("value", F.col("bag_id").alias("a"), F.col("n").alias("na"), *(F.col(c).alias(f"a_{c}") for c in CODES))
    b = right.select("value", F.col("bag_id").alias("b"), F.col("n").alias("nb"), *(F.col(c).alias(f"b_{c}") for c in CODES))
    na, nb = F.abs("na"), F.abs("nb")
    sized = ((F.col("na") > 0) | (F.col("nb") > 0)) & (5 * na >= 4 * nb) & (5 * nb >= 4 * na)
    apart = [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in CODES]
    # most pairs are told apart by the first bits already
    near = reduce(Column.__and__, (9 * reduce(Column.__add__, apart[:k]) <= na + nb for k in (1, 2, len(apart))))
    return a.join(b, "value").where((F.col("a") != F.col("b")) & sized & near).select("a", "b").distinct()


def own_meetings(lists: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of bags that meet in a list and may overlap by 0.8: the entries of a list follow each other
    after one shuffle, and each pair of them is compared once."""
    rows = lists.repartition("value").sortWithinPartitions("value", F.desc("n"))
    return rows.mapInArrow(_met, "a bigint, b bigint").distinct()


def _met(batches):
    """Pairs (a, b) of LISTS in order of value, texts of the list's own band first; a list may go on in the next batch."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(0).to_numpy()
        whole = int(np.searchsorted(value, value[-1]))
        if held and (whole or held[-1].column(0)[-1].as_py() != value[-1]):
            yield from _met_in([*held, batch.slice(0, whole)])
            held = []
        elif whole:
            yield from _met_in([batch.slice(0, whole)])
        held.append(batch.slice(whole))
    if held:
        yield from _met_in(held)


def _met_in(parts: list[pa.RecordBatch]):
    table = pa.Table.from_batches(parts)
    value, ids, n, *codes = (c.to_numpy() for c in table.columns)
    codes = [c.view(np.uint64) for c in codes]  # the bits of a number below 0 would be counted without its sign
    low, n = n < 0, np.abs(n).astype(np.int64)
    begin = tc.firsts(value)
    size = np.diff(np.append(begin, len(value)))

    def told(i: np.ndarray, j: np.ndarray):
        keep = (ids[i] != ids[j]) & (5 * n[i] >= 4 * n[j]) & (5 * n[j] >= 4 * n[i])
        i, j = i[keep], j[keep]
        apart = np.zeros(len(i), np.int64)
        for c in codes:
            apart += np.bitwise_count(c[i] ^ c[j])
            keep = 9 * apart <= n[i] + n[j]
            i, j, apart = i[keep], j[keep], apart[keep]
        if len(i):
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # of short lists all pairs are written out; a text that stands there for larger ones alone meets none after it
    after = np.repeat(begin + size, size) - np.arange(len(value)) - 1
    after[low | np.repeat(size > SHORT, size)] = 0
    i = np.repeat(np.arange(len(value)), after)
    yield from told(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after))
    for k in np.flatnonzero(size > SHORT):
        lo, end = int(begin[k]), int(begin[k] + size[k])
        own = end - int(low[lo:end].sum())
        while lo < own:
            hi = min(own, lo + max(1, BLOCK // (end - lo)))
            first = np.bitwise_count(codes[0][lo:hi, None] ^ codes[0][None, lo:end]) + np.bitwise_count(codes[1][lo:hi, None] ^ codes[1][None, lo:end])
            # 9 times the bits of half the places, against the words of both
            i, j = np.nonzero(first <= np.minimum((n[lo:hi, None] + n[None, lo:end]) // 9, 255).astype(np.uint8))
            after_it = j > i
            yield from told(lo + i[after_it], lo + j[after_it])
            lo = hi


def _bag_batches(batches):
    for batch in batches:
        for first, part in tc.chunks(batch.column(1).to_pylist()):
            b = tc.bags_of(part)
            size = np.bincount(b.doc, minlength=len(part))
            offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            elements = pa.ListArray.from_arrays(pa.array(offsets), pa.array((b.element >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), elements], ["bag_id", "elements"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of bag ids those whose overlap is at least threshold, by their whole bags.

    texts: (row_id, text); a bag's id is the row_id of one row that has it. Elements travel as 32 bits of their hashes:
    two of the few hundred elements of a pair coincide in one pair of some 100,000, which then counts one word amiss.
    """
    need = pairs.select(F.col("a").alias("row_id")).union(pairs.select("b")).distinct()
    small = need.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = texts.join(F.broadcast(need) if small else need, "row_id", "left_semi").dropDuplicates(["row_id"])
    bags = own.select("row_id", "text").mapInArrow(_bag_batches, "bag_id bigint, elements array<int>")
    a = bags.select(F.col("bag_id").alias("a"), F.col("elements").alias("ea"))
    b = bags.select(F.col("bag_id").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    return (
        pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("ea") + F.size("eb")).alias("sum"))
        .where(F.col("both") >= threshold * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b")
    )
