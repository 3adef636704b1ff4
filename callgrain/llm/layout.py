"""Records that are the same but for layout (problem 3).

A text is a tree: a call is one leaf, a record written as named fields is an unordered node of (name, value) leaves,
whose values may be nested records or lists. Leaves are normalised to their letters and digits, case folded; a node's
digest is taken over the sorted digests of its children. Rows are grouped by root digest, and a group stands only as
far as the full normalised structures of its rows are equal.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgrain.llm import textcodes as tc
from callgrain.session import cut

#: Most ids that are broadcast; above it the join shuffles.
BROADCAST_IDS = 500_000

#: Labels of voices: lines that begin with them are turns of a call, not fields.
VOICES = {"caller", "receiver", "scammer", "victim", "customer", "agent", "callee", "narrator", "speaker", "person", "host"}

_WORD = re.compile(r"[^\W_]+")
_FIELD = re.compile(r"^[\W_]*([^\W\d][\w ]*?)[\"'*“”]*\s*(?:=|:|\s-\s)\s*(.*)$", re.S)
_HINT = re.compile(r"[\W_]*[^\W_][\w ]*[\"'*“”]*\s*(?:[=:]|\s-\s)|\{")


def _plain(text: str) -> str:
    """Letters and digits alone, case folded."""
    t = tc.word_table()
    return "".join(c for c in text.casefold() if t[ord(c)])


class _Pairs(tuple):
    """The names and values of a parsed object, in their order."""


def _tree(value: object) -> object:
    """A normalised structure of a parsed value; unordered nodes are sorted lists of [name, value], in which a name
    that is repeated stands as often."""
    if isinstance(value, _Pairs):
        return sorted(([_plain(k), _tree(v)] for k, v in value), key=repr)
    if isinstance(value, list):
        return ["list", *map(_tree, value)]
    return _plain("" if value is None else str(value))


def parse_record(text: str) -> object | None:
    """The normalised structure of a text written as named fields, two or more of them if not in braces, else None."""
    s = text.strip()
    if not _HINT.match(s):
        return None
    if s.startswith("{") and s.endswith("}"):
        try:
            got = json.loads(s.translate({0x201C: '"', 0x201D: '"'}), object_pairs_hook=_Pairs)
        except (ValueError, RecursionError):
            got = None
        if isinstance(got, _Pairs) and got:
            return _tree(got)
    for mark in ("\n", "|", ";"):
        if mark not in s:
            continue
        parts = [p for p in s.split(mark) if _WORD.search(p)]
        if len(parts) < 2:
            continue
        found = [_FIELD.match(p) for p in parts]
        if not all(found):
            continue
        names = [_plain(m.group(1)) for m in found]
        if len(set(names)) < len(names) or any(n.rstrip("0123456789") in VOICES for n in names):
            continue
        return sorted(([n, _plain(m.group(2))] for n, m in zip(names, found)), key=repr)
    return None


def merkle(tree: object) -> bytes:
    """The digest of a normalised structure, from the leaves up."""
    if isinstance(tree, str):
        return hashlib.blake2b(b"leaf" + tree.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if tree and tree[0] == "list":
        return hashlib.blake2b(b"list" + b"".join(map(merkle, tree[1:])), digest_size=16).digest()
    children = sorted(hashlib.blake2b(b"field" + merkle(k) + merkle(v), digest_size=16).digest() for k, v in tree)
    return hashlib.blake2b(b"node" + b"".join(children), digest_size=16).digest()


def digests(texts: list[str], words: tc.Words | None = None) -> tuple[list[bytes | None], list[bytes | None]]:
    """Of each text of a chunk: the digest of its letters and digits in order, and its Merkle root if it is a record."""
    a, b = tc.sequence_digests(words or tc.words_of(texts))
    raw = np.stack([a, b], 1).tobytes()
    seq = [raw[16 * i : 16 * i + 16] if x else None for i, x in enumerate(a)]
    return seq, [None if s is None or (tree := parse_record(t)) is None else merkle(tree) for t, s in zip(texts, seq)]


def _digest_batches(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        seqs, roots = [], []
        for _, part in tc.chunks(texts):
            s, r = digests(part)
            seqs += s
            roots += r
        yield pa.RecordBatch.from_arrays([ids, pa.array(seqs, pa.binary()), pa.array(roots, pa.binary())], ["row_id", "seq", "root"])


def classes(rows: DataFrame) -> DataFrame:
    """row_id and the digest `cls` of its content, from rows (row_id, seq, root); rows without letter or digit fall out.

    A text that has the letters and digits of some record in that record's own order belongs to the record's class.
    """
    rows = rows.where("seq IS NOT NULL AND row_id IS NOT NULL")
    known = rows.where("root IS NOT NULL").groupBy("seq").agg(F.min("root").alias("seq_root"))
    return rows.join(known, "seq", "left").select(*[c for c in rows.columns if c != "root"], F.coalesce("seq_root", "seq").alias("cls"))


def _proof_batches(batches):
    for batch in batches:
        texts = batch.column(2).to_pylist()
        proofs = []
        for t in texts:
            tree = parse_record(t)
            whole = _plain(t) if tree is None else json.dumps(tree, ensure_ascii=False)
            # the structures are compared in full by a digest of 256 bits, so that no text is shuffled
            proofs.append(("" if tree is None else "{") + hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(proofs, pa.string())], ["row_id", "cls", "proof"])


def content_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(keep_id, n_copies) of each group of two or more rows with the same content.

    Null texts, texts without letter or digit and rows with a null id are in no group. Rows loaded twice with one id
    count as often as they stand. An empty table gives an empty result; other columns are ignored.
    """
    narrow = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"))
    raw = cut(narrow.mapInArrow(_digest_batches, "row_id bigint, seq binary, root binary"), "digests")
    seen = cut(classes(raw).select("row_id", "cls"), "layout")
    twice = seen.groupBy("cls").count().where("count > 1").select("cls")
    rows = seen.join(twice, "cls", "left_semi")
    small = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.distinct()
    texts = narrow.join(F.broadcast(rows) if small else rows, "row_id").select("row_id", "cls", "text")
    proofs = texts.mapInArrow(_proof_batches, "row_id bigint, cls binary, proof string").groupBy("cls", "proof").agg(F.min("row_id").alias("keep_id"), F.count("*").alias("n"))
    # a row that equals a record letter by letter without being one itself joins that record
    own = F.min(F.when(F.col("proof").startswith("{"), F.col("proof"))).over(Window.partitionBy("cls"))
    proofs = proofs.withColumn("proof", F.when(F.col("proof").startswith("{"), F.col("proof")).otherwise(F.coalesce(own, F.col("proof"))))
    return (
        proofs.groupBy("cls", "proof")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").cast("bigint").alias("n_copies"))
        .where("n_copies > 1")
        .select("keep_id", "n_copies")
    )


def letter_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(keep_id, n_copies) of each group of two or more rows with the same letters and digits in the same order; null
    and blank texts and null ids fall out. The part of `content_groups` that reads no fields."""
    narrow = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"))
    raw = narrow.mapInArrow(_digest_batches, "row_id bigint, seq binary, root binary").where("seq IS NOT NULL AND row_id IS NOT NULL")
    groups = raw.groupBy("seq").agg(F.min("row_id").alias("keep_id"), F.count("*").alias("n_copies"))
    return groups.where("n_copies > 1").select("keep_id", "n_copies")
