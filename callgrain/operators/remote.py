"""Batches of rows through an outside model: resumable, validated, with retries; the client is injected."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a client gets and gives: texts in, labels out.
Client = Callable[[list[str]], list[str]]


def classify_rows(todo: DataFrame, done: DataFrame | None, key: str, text: str, client: Client, labels: list[str], batch: int = 100, tries: int = 4, wait: float = 0.0) -> DataFrame:
    """(key, label, valid, attempts) for rows that `done` doesn't hold yet.

    A reply counts only if it has one allowed label per text; a failed batch is tried again, then row by row. Rows with
    a null text get no call and an invalid row. Records in `done` that aren't valid are tried again.
    """
    rows = todo.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    if done is not None:
        rows = rows.join(done.where("valid").select(F.col("key")).distinct(), "key", "left_anti")
    allowed = set(labels)

    def ask(texts: list[str]) -> list[tuple[str | None, int]]:
        for n in range(1, tries + 1):
            try:
                got = client(texts)
                if len(got) == len(texts) and all(x in allowed for x in got):
                    return [(x, n) for x in got]
            except Exception:  # any failure of the service counts as a try
                pass
            time.sleep(wait * n)
        if len(texts) == 1:
            return [(None, tries)]
        return [x for t in texts for x in ask([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple[str | None, int]] = [(None, 0)] * len(keys)
            there = [i for i, t in enumerate(texts) if t is not None]
            for s in range(0, len(there), batch):
                part = there[s : s + batch]
                for i, x in zip(part, ask([texts[i] for i in part])):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([x for x, _ in out], pa.string()), pa.array([x is not None for x, _ in out]), pa.array([n for _, n in out], pa.int32())], ["key", "label", "valid", "attempts"])

    return rows.mapInArrow(run, "key string, label string, valid boolean, attempts int")


class Busy(Exception):
    """What a client raises when the service asks to wait (too many requests, a server's own error)."""


#: The fields that a verdict must have, and its labels. Fixed values.
VERDICT_FIELDS = ("label", "confidence", "has_two_or_more_participants", "has_substantial_back_and_forth", "is_mostly_narration", "is_mostly_tutorial", "is_reenactment", "reason")
VERDICT_LABELS = ("CONVERSATION", "REENACTMENT", "AWARENESS", "TUTORIAL", "NARRATION", "UNCLEAR")
VERDICT = "key string, llm_label string, llm_confidence double, " + ", ".join(f"{f} boolean" for f in VERDICT_FIELDS[2:7]) + ", llm_reason string, llm_status string"


def _verdict(reply: str) -> tuple:
    got = json.loads(reply[reply.find("{") : reply.rfind("}") + 1])
    lacking = [f for f in VERDICT_FIELDS if f not in got]
    if lacking or got["label"] not in VERDICT_LABELS:
        raise ValueError(f"lacks {lacking}" if lacking else "label not allowed")
    return (got["label"], float(got["confidence"]), *(bool(got[f]) for f in VERDICT_FIELDS[2:7]), str(got["reason"]), "OK")


def transcript_verdicts(rows: DataFrame, key: str, text: str, precheck: str, client: Callable[[str], str], tries: int = 3, wait: float = 0.0) -> DataFrame:
    """VERDICT of each row: rows that the precheck rejects get the label REJECT and no call; the others that of the
    client's reply, which must have all fields and an allowed label. A reply that still isn't valid after `tries` calls
    gives an UNCLEAR row with the error as its status. Null texts get no call and an UNCLEAR row."""
    reject = F.coalesce(F.col(precheck), F.lit("")).startswith("REJECT")
    few = F.lit(False)
    no = rows.where(reject).select(F.col(key).cast("string").alias("key"), F.lit("REJECT").alias("l"), F.lit(1.0).alias("c"), *[few.alias(f) for f in VERDICT_FIELDS[2:7]], F.col(precheck).alias("r"), F.lit("SKIPPED").alias("s"))

    def ask(t: str | None) -> tuple:
        error = "no text"
        for n in range(1, tries + 1) if t is not None else ():
            try:
                return _verdict(client(t))
            except Exception as e:  # any failure of the service or of its reply counts as a try
                error = f"ERROR: {e}"
                time.sleep(wait * n)
        return ("UNCLEAR", 0.0, *[False] * 5, "", error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ask(t) for t in b.column(1).to_pylist()]
            kinds = (pa.string(), pa.float64(), *[pa.bool_()] * 5, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], [c.split()[0] for c in VERDICT.split(", ")])

    asked = rows.where(~reject).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, VERDICT)
    return asked.union(no)


DECISION = "key string, label string, confidence double, probabilities map<string,double>, error string, attempts int, latency double"


def typed_decisions(rows: DataFrame, key: str, text: str, client: Callable[[str], dict], labels: list[str], tries: int = 8, wait: float = 20.0, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """DECISION of each row. The client gives a dict with choice, confidence and probabilities; it raises Busy for what
    a later try may cure, which waits `wait` seconds times the number of the try. Other errors end the row at once. A
    label counts in any case; one that isn't allowed is given with an error. Null texts get no call and an error.
    """
    named = {x.lower(): x for x in labels}

    def ask(t: str | None) -> tuple:
        if t is None:
            return None, 0.0, [], "no text", 0, 0.0
        for n in range(1, tries + 1):
            began = clock()
            try:
                got = client(t)
            except Busy:
                time.sleep(wait * n if n < tries else 0)
                continue
            except Exception as e:
                return None, 0.0, [], f"CONNECTION_ERROR: {e}", n, clock() - began
            took = float(got.get("latency", clock() - began))
            label = str(got.get("choice")).strip()
            known = named.get(label.lower())
            return known or label, float(got.get("confidence", 0.0)), list(got.get("probabilities", {}).items()), None if known else f"UNRECOGNIZED_LABEL: {label}", n, took
        return None, 0.0, [], "MAX_RETRIES_EXCEEDED", tries, 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ask(t) for t in b.column(1).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64()), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], [c.split()[0] for c in DECISION.replace("string,double", "").split(", ")])

    return rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, DECISION)


def generated(wanted: DataFrame, client: Callable[[str, int], str | None], tries: int = 3, give_up: int = 10) -> DataFrame:
    """(class, number, text, attempts) for rows (class, number): texts by the client, None being no valid text. After
    `give_up` failures in a row a task asks no more, and the rest of its rows have no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for b in batches:
            texts, attempts = [], []
            for c, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text, n = None, 0
                while text is None and n < tries and failed < give_up:
                    n += 1
                    try:
                        text = client(c, k)
                    except Exception:  # a failed call is a failed try
                        text = None
                failed = 0 if text is not None else failed + (n > 0)
                texts.append(text)
                attempts.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(attempts, pa.int32())], ["class", "number", "text", "attempts"])

    return wanted.select(F.col("class").cast("string"), F.col("number").cast("bigint")).mapInArrow(run, "class string, number bigint, text string, attempts int")
