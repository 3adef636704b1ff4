"""Encoding with a public tokenizer and how finely it cuts words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.functions import text as T

#: A published byte-pair tokenizer; its path is a parameter and its file isn't part of this repository.
WORD_BPE = "/opt/tokenizers/word_bpe_49k.json"


def word_pieces(words: DataFrame, path: str = WORD_BPE) -> DataFrame:
    """(word, pieces) of distinct words, encoded one by one: each word is encoded once, however often it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for batch in batches:
            got = t.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.ids) for x in got], pa.int32())], ["word", "pieces"])

    return words.select("word").distinct().mapInArrow(run, "word string, pieces int")


def fertility(docs: DataFrame, key: str, text: str, path: str = WORD_BPE) -> DataFrame:
    """Of each document: words, pieces, pieces a word, and the shares of words cut into 2, 3 and 4 pieces and more.

    Null and blank texts have no words and all figures 0.
    """
    words = docs.select(F.col(key).alias("id"), F.explode_outer(T.tokens(F.col(text))).alias("word"))
    counts = words.groupBy("id", "word").agg(F.count("word").alias("c"))
    p = counts.join(word_pieces(counts.where("word IS NOT NULL"), path), "word", "left").na.fill(0, ["pieces"])
    of = lambda k: F.coalesce(F.sum(F.when(F.col("pieces") >= k, F.col("c"))), F.lit(0))
    a = p.groupBy("id").agg(F.sum("c").alias("n_words"), F.sum(F.col("c") * F.col("pieces")).alias("n_pieces"), *[of(k).alias(f"split_{k}") for k in (2, 3, 4)])
    return a.select("id", "n_words", "n_pieces", T.ratio(F.col("n_pieces"), F.col("n_words")).alias("fertility"), *[T.ratio(F.col(f"split_{k}"), F.col("n_words")).alias(f"split_{k}_share") for k in (2, 3, 4)], *[(F.col("n_pieces") > k).alias(f"over_{k}") for k in (512, 1024, 2048, 4096, 8192)])


def padded(docs: DataFrame, key: str, text: str, size: int = 512, path: str = WORD_BPE) -> DataFrame:
    """(id, ids, mask, n_tokens, truncated): the ids of a text between a begin and an end mark, cut or padded to `size`.

    The marks and the padding are numbered after the vocabulary: begin, end, padding. n_tokens counts the ids without
    marks before cutting. Null and empty texts have the marks alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        begin = t.get_vocab_size(with_added_tokens=True)
        for batch in batches:
            got = [x.ids for x in t.encode_batch([x or "" for x in batch.column(1).to_pylist()], add_special_tokens=False)]
            whole = [[begin, *x[: size - 2], begin + 1] for x in got]
            ids = [x + [begin + 2] * (size - len(x)) for x in whole]
            mask = [[1] * len(x) + [0] * (size - len(x)) for x in whole]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int8())), pa.array([len(x) for x in got], pa.int32()), pa.array([len(x) > size - 2 for x in got])], ["id", "ids", "mask", "n_tokens", "truncated"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, ids array<int>, mask array<tinyint>, n_tokens int, truncated boolean")
