"""Encoding of a whole corpus with a public byte-level BPE (problem 8).

Texts of up to LEAF characters are encoded at once. Longer ones are cut in halves, and those again, down to leaves that
are encoded in parallel; neighbours are then joined like a tree. Around each join the text is encoded again in a window
that begins at the last piece on the left, or at the apostrophe before it (a contraction may be cut there; nothing
earlier can depend on what follows), and grows until one of its piece
boundaries meets one on the right; from there on the right side stands. A single piece longer than RUN bytes is encoded
in the same way below the level of pieces: windows of tokens grow until their first and last token agree with both
sides. Two tokens that stand side by side in some encoding always may, so the result is the encoding of the whole.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary file lies; a parameter of every function here.
VOCABULARY = os.environ.get("CALLGRAIN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The published way in which this vocabulary cuts text into pieces before merging. Fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, RUN = 8192, 4096
#: Neighbouring parts of a text that one task joins in one round.
FAN = 32


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _piece_pattern():
    import regex

    return regex.compile(PIECES)


def join_tokens(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of one piece from those of its two parts."""
    w = 4
    while True:
        a, b = min(w, len(left)), min(w, len(right))
        whole = enc._core_bpe.encode_single_piece(b"".join(map(enc.decode_single_token_bytes, left[len(left) - a :] + right[:b])))
        head = a == len(left) or whole[0] == left[len(left) - a]
        tail = b == len(right) or whole[-1] == right[b - 1]
        if (head and tail) or (a == len(left) and b == len(right)):
            return left[: len(left) - a] + whole + right[b:]
        w *= 2


def encode_piece(enc, piece: bytes, run: int = RUN) -> list[int]:
    """One piece, by halves if it is long."""
    if len(piece) <= run:
        return enc._core_bpe.encode_single_piece(piece)
    half = len(piece) // 2
    return join_tokens(enc, encode_piece(enc, piece[:half], run), encode_piece(enc, piece[half:], run))


def encode_leaf(enc, text: str, run: int = RUN) -> tuple[list[int], list[int], list[int]]:
    """Of a part of a text: ids, where each piece begins in the text, and where in the ids; each with a last bound."""
    ids, at, starts = [], [], []
    for m in _piece_pattern().finditer(text):
        at.append(m.start())
        starts.append(len(ids))
        ids += encode_piece(enc, m.group().encode("utf-8", "replace"), run)
    return ids, [*at, len(text)], [*starts, len(ids)]


Encoded = tuple[str, list[int], list[int], list[int]]


def join_parts(enc, left: Encoded, right: Encoded, run: int = RUN) -> Encoded:
    """The encoding (text, ids, bounds in the text, bounds in the ids) of two neighbouring parts."""
    lt, li, lat, lst = left
    rt, ri, rat, rst = right
    if not lt or not rt:
        return right if not lt else left
    keep = len(lat) - 2  # pieces on the left that stand
    if keep and lt[lat[keep - 1] : lat[keep]].endswith("'"):
        keep -= 1
    cut_at, cut_id = lat[keep], lst[keep]
    tail = lt[cut_at:]
    there = {p: k for k, p in enumerate(rat[:-1])}
    grow = 256
    while True:
        window = tail + rt[:grow]
        all_of_it = grow >= len(rt)
        wi, wat, wst = encode_leaf(enc, window, run)
        meet = next((k for k in range(len(wat) - (1 if all_of_it else 2)) if wat[k] - len(tail) in there and wat[k] >= len(tail)), None)
        if meet is not None:
            k = there[wat[meet] - len(tail)]
            shift_t, shift_i = len(lt) - rat[0], cut_id + wst[meet] - rst[k]
            return (lt + rt, li[:cut_id] + wi[: wst[meet]] + ri[rst[k] :], lat[:keep] + [cut_at + x for x in wat[:meet]] + [x + shift_t for x in rat[k:]], lst[:keep] + [cut_id + x for x in wst[:meet]] + [x + shift_i for x in rst[k:]])
        if all_of_it:
            return lt + rt, li[:cut_id] + wi, lat[:keep] + [cut_at + x for x in wat], lst[:keep] + [cut_id + x for x in wst]
        grow *= 2


def encode_tree(enc, parts: list[Encoded], run: int = RUN) -> Encoded:
    """The encoding of neighbouring parts of a text, joined two and two."""
    while len(parts) > 1:
        parts = [join_parts(enc, parts[i], parts[i + 1], run) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else ("", [], [0], [0])


def encode_text(text: str | None, path: str = VOCABULARY, leaf: int = LEAF, run: int = RUN) -> list[int]:
    """The ids of one text, by halves wherever it is long; null and empty texts give no ids."""
    enc = encoder(path)
    parts = [text[i : i + leaf] for i in range(0, len(text or ""), leaf)]
    return encode_tree(enc, [(p, *encode_leaf(enc, p, run)) for p in parts], run)[1]


def _ids(lists: list[list[int]]) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


def _short(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids([enc.encode_ordinary(t) if t else [] for t in batch.column(1).to_pylist()])], ["doc_id", "ids"])

    return run


_UID = "uid struct<doc_id:bigint,h:bigint,u:bigint>"
_PART = f"{_UID}, k int, text string, ids array<int>, at array<int>, starts array<int>"


def _cut(leaf: int):
    def run(batches):
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                parts = [t[a : a + leaf] for a in range(0, len(t), leaf)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(parts), batch.column(0).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["uid", "k", "text"])

    return run


def _leaves(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            got = [encode_leaf(enc, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(_ids([g[i] for g in got]) for i in range(3))], ["uid", "k", "text", "ids", "at", "starts"])

    return run


def _joined(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            out = [encode_tree(enc, [(p["text"], p["ids"], p["at"], p["starts"]) for p in parts]) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()), *(_ids([x[i] for x in out]) for i in (1, 2, 3))], ["uid", "k", "text", "ids", "at", "starts"])

    return run


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(doc_id, ids) of every row, without special tokens; strings that look like special tokens are ordinary text.

    The empty and the null text get an empty list. Rows with a null id or with an id that stands several times are
    encoded row by row. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > leaf
    short = rows.where(~long).mapInArrow(_short(path), "doc_id bigint, ids array<int>")
    uid = F.struct("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("u"))
    named = rows.where(long).select(uid.alias("uid"), "text")  # before the rows are multiplied
    # a fixed number of partitions, which no later step folds together: leaves are few rows but much work
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    parts = named.mapInArrow(_cut(leaf), f"{_UID}, k int, text string").repartition(tasks, "uid", "k").mapInArrow(_leaves(path), _PART)
    most = rows.agg(F.max(F.length("text"))).first()[0] or 0
    left = -(-most // leaf)
    while left > 1:  # a round joins `fan` neighbours in one task, so that no task holds more of a text than it must
        group = parts.groupBy("uid", F.floor(F.col("k") / fan).cast("int").alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "text", "ids", "at", "starts"))).alias("parts"))
        parts = group.mapInArrow(_joined(path), _PART)
        left = -(-left // fan)
    return short.union(parts.select("uid.doc_id", "ids"))
