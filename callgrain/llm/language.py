"""Languages of documents and of their sentences (problem 7), by error-correcting output codes.

The classes are English, Hindi in either script, Spanish and French. Each gets the codeword of the exhaustive code for
five classes (15 bits, any two differ in 8); one binary classifier over character n-grams predicts each bit, in two
rounds: first from the labels that rows carry, then from the sentences that the first round is sure about. Decoding
weighs each bit's loss by how well the bit is predicted and takes the nearest codeword; a small lead is ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm import textcodes as tc
from callgrain.llm.sampling import bounded

#: Most labelled rows that the classifiers are fitted on, the first by hash of their id.
TRAIN_ROWS = 3000
CLASSES = ("en", "hi", "hi-Deva", "es", "fr")
LANG = ("en", "hi", "hi", "es", "fr")
#: One column for each way to part five classes into two groups.
CODE = np.array([c for c in product((1, -1), repeat=5) if c[0] == 1 and min(c) < 0], np.float32).T
GRAMS, BUCKETS = 4, 1 << 15
#: Fewest words with letters in a whole sentence; fewest words of a case; least lead that decides.
SENTENCE_WORDS, CASE_WORDS, LEAD = 3, 5, 0.12
#: Names of languages as they are written. Fixed values.
NAMES = {
    "en": "en eng english inglés ingles anglais angrezi अंग्रेज़ी".split(),
    "hi": "hi hin hindi हिन्दी हिंदी hinglish".split(),
    "es": "es spa esp spanish español espanol castellano".split(),
    "fr": "fr fra fre french français francais".split(),
}
#: Labels and field names of this project's texts, which belong to no language. Fixed values.
NEUTRAL = "caller receiver scammer victim customer agent speaker narrator case claim firm reply channel opened outcome loss app goods remark victim_town town".split()


def named_language(label: str | None) -> str | None:
    """en, hi, es or fr if the label names it in any spelling, with or without region and script."""
    first = re.split(r"[\s_\-./(,]+", (label or "").strip().casefold())[0]
    return next((k for k, v in NAMES.items() if first in v), None)


@dataclass
class Model:
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def losses(self, score: np.ndarray) -> np.ndarray:
        """Weighted hinge loss of each row of bit scores against each codeword, per unit of weight."""
        t = np.tanh(score / self.scale)
        return np.maximum(0, 1 - t[:, None, :] * CODE[None]) @ self.trust / self.trust.sum() / 2

    def decode(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, lead over the nearest other language and confidence of each row."""
        loss = self.losses(score)
        best = loss.argmin(1)
        other = loss.copy()
        for c in range(5):
            other[np.array([LANG[b] == LANG[c] for b in best], bool) if len(best) else np.zeros(0, bool), c] = np.inf
        lead = other.min(1) - loss[np.arange(len(best)), best]
        p = np.exp(-8 * loss)
        by_lang = np.stack([p[:, [c for c in range(5) if LANG[c] == x]].sum(1) for x in ("en", "hi", "es", "fr")], 1)
        return best, lead, by_lang.max(1) / by_lang.sum(1)


@dataclass
class Sentences:
    """Sentences of a chunk: their text, words with letters, and the words themselves as places in `vocabulary`."""

    doc: np.ndarray
    first: np.ndarray
    weight: np.ndarray
    words: np.ndarray
    n_words: np.ndarray
    grams: np.ndarray
    gram_word: np.ndarray
    gram_n: np.ndarray


_neutral: np.ndarray | None = None
_END = np.array([ord(c) for c in "!?।॥…¿¡|;\"{}？！。"], np.uint32)


def neutral_hashes() -> np.ndarray:
    global _neutral
    if _neutral is None:
        _neutral = np.unique(np.concatenate([tc.words_of([x]).hash for x in NEUTRAL]))
    return _neutral


def sentences_of(texts: list[str]) -> Sentences | None:
    """Sentences end at line ends, at marks that end them, and at full stops that follow neither an initial nor a
    shortened word and stand before white space."""
    w = tc.words_of(texts)
    n = len(w.hash)
    if not n:
        return None
    codes = w.codes
    hard = np.concatenate(([0], np.cumsum(np.isin(codes, _END) | (codes == 10) | (codes == 13))))
    stop = np.concatenate(([0], np.cumsum(codes == ord("."))))
    cut = np.ones(n, bool)
    a, b = w.end[:-1], w.start[1:]
    long = (w.end - w.start)[:-1] > 1
    cut[1:] = (hard[b] > hard[a]) | ((stop[b] > stop[a]) & (b - a > 1) & long) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(cut)
    unique, where, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    begin, size = w.start[where], (w.end - w.start)[where]
    # the words, each between two marks, end to end
    total = size + 2
    offset = np.concatenate(([0], np.cumsum(total)[:-1]))
    word = np.repeat(np.arange(len(unique)), total)
    place = np.arange(total.sum()) - offset[word]
    inside = (place > 0) & (place <= size[word])
    chars = np.full(len(word), 1, np.uint64)
    chars[inside] = codes[begin[word[inside]] + place[inside] - 1]
    digit = (chars >= 48) & (chars <= 57)
    letters = size - np.bincount(word, digit, minlength=len(unique)).astype(np.int64)
    weight = ((letters >= 2) & (letters == size) & ~np.isin(unique, neutral_hashes())).astype(np.float32)
    grams, gram_word = [], []
    h = np.zeros(len(chars), np.uint64)
    with np.errstate(over="ignore"):
        for g in range(GRAMS):
            h = h[: len(chars) - g] * tc.BASE_A + chars[g:] if g else chars.copy()
            fits = place[: len(h)] + g < total[word[: len(h)]]
            grams.append((tc.mix(h[fits] + np.uint64(g) * tc.SEED_A) % np.uint64(BUCKETS)).astype(np.int64))
            gram_word.append(word[: len(h)][fits])
    gram_word = np.concatenate(gram_word)
    return Sentences(w.doc[first], first, weight, inverse, np.diff(np.append(first, n)), np.concatenate(grams), gram_word, np.bincount(gram_word, minlength=len(unique)))


def bit_scores(s: Sentences, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean bit scores of the sentences, and how many words counted."""
    per_word = np.empty((len(s.weight), weights.shape[1]), np.float32)
    picked = weights[s.grams]
    for k in range(weights.shape[1]):
        per_word[:, k] = np.bincount(s.gram_word, picked[:, k], minlength=len(s.weight))
    per_word *= (s.weight / np.maximum(s.gram_n, 1))[:, None].astype(np.float32)
    score = np.add.reduceat(per_word[s.words], s.first, axis=0)
    counted = np.add.reduceat(s.weight[s.words], s.first)
    return score / np.maximum(counted, 1)[:, None], counted


def _fit(s: Sentences, label: np.ndarray, use: np.ndarray) -> Model:
    """The bit classifiers from sentences with a class each: log odds of n-grams between the two groups of classes."""
    owner = np.repeat(np.arange(len(s.first)), s.n_words)
    counts = np.zeros((5, BUCKETS))
    order = np.argsort(s.gram_word, kind="stable")
    begin = np.concatenate(([0], np.cumsum(s.gram_n)))
    for c in range(5):
        mine = (use & (label == c))[owner]
        times = np.bincount(s.words[mine], minlength=len(s.weight)) * s.weight
        counts[c] = np.bincount(s.grams[order], np.repeat(times, s.gram_n), minlength=BUCKETS)
    del begin
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    weights = np.stack([np.log(share[CODE[:, b] > 0].mean(0)) - np.log(share[CODE[:, b] < 0].mean(0)) for b in range(CODE.shape[1])], 1).astype(np.float32)
    score, counted = bit_scores(s, weights)
    known = use & (counted >= SENTENCE_WORDS)
    scale = np.maximum(np.abs(score[known]).mean(0), 1e-3) if known.any() else np.ones(CODE.shape[1])
    right = ((score[known] > 0) == (CODE[label[known]] > 0)).mean(0) if known.any() else np.ones(CODE.shape[1])
    return Model(weights, scale.astype(np.float32), np.maximum(right - 0.5, 0.01).astype(np.float32))


def fit(rows: list[tuple[str, str]]) -> Model:
    """The model from (text, language) rows, some of which are labelled wrongly or written in several languages."""
    s = sentences_of([t for t, _ in rows]) if rows else None
    if s is None:
        return Model(np.zeros((BUCKETS, CODE.shape[1]), np.float32), np.ones(CODE.shape[1], np.float32), np.ones(CODE.shape[1], np.float32))
    deva = np.array([len(re.findall("[ऀ-ॿ]", t)) * 4 > len(t) for t, _ in rows])
    label = np.array([2 if x == "hi" and d else LANG.index(x) for (_, x), d in zip(rows, deva)])[s.doc]
    model = _fit(s, label, np.ones(len(label), bool))
    for _ in range(2):
        score, counted = bit_scores(s, model.weights)
        label, lead, _ = model.decode(score)
        model = _fit(s, label, (counted >= SENTENCE_WORDS) & (lead > LEAD))
    return model


def _fitted(rows: DataFrame):
    """The model fitted on TRAIN_ROWS labelled rows (rec_id, text, label) at most, sent to all executors."""
    labelled = bounded(rows.where("label IS NOT NULL AND trim(label) <> ''"), F.col("rec_id"), TRAIN_ROWS)
    sample = [(r.text, x) for r in labelled.select("text", "label").collect() if (x := named_language(r.label))]
    return rows.sparkSession.sparkContext.broadcast(fit(sample))


def parts(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(rec_id, part_no, first_word, n_words, lang, confidence, ambiguous): the parts of a text in one language each.

    Neighbouring sentences of one language are one part. Sentences too short to tell go with the part before, or with
    the first. A part whose nearest codeword leads by LEAD or less is ambiguous. Null and blank texts have no rows.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label")).where("rec_id IS NOT NULL AND text IS NOT NULL")
    model = _fitted(rows)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, part in tc.chunks(batch.column(1).to_pylist()):
                doc, *rest = parts_of(part, model.value)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([ids[at + d] for d in doc], pa.int64()), *(pa.array(x, k) for x, k in zip(rest, kinds))], ["rec_id", "part_no", "first_word", "n_words", "lang", "confidence", "ambiguous"])

    return rows.mapInArrow(run, "rec_id bigint, part_no int, first_word bigint, n_words bigint, lang string, confidence double, ambiguous boolean")


def parts_of(texts: list[str], model: Model) -> tuple[list, ...]:
    """Of a chunk: text, number, first word, words, language, confidence and ambiguity of each part."""
    s = sentences_of(texts)
    if s is None:
        return [], [], [], [], [], [], []
    score, counted = bit_scores(s, model.weights)
    cls, _, _ = model.decode(score)
    lang = np.array([0, 1, 1, 2, 3])[cls]
    told = counted >= SENTENCE_WORDS
    # a sentence that is too short takes the language of the last one before it that isn't, or else of the first
    begin = np.searchsorted(s.doc, s.doc)
    last = np.maximum.accumulate(np.where(told, np.arange(len(told)), -1))
    after = np.minimum.accumulate(np.where(told, np.arange(len(told)), len(told))[::-1])[::-1]
    own = np.where(last >= begin, last, np.where((after < len(told)) & (s.doc[np.minimum(after, len(told) - 1)] == s.doc), after, np.arange(len(told))))
    lang = lang[own]
    new = np.flatnonzero(np.concatenate(([True], (s.doc[1:] != s.doc[:-1]) | (lang[1:] != lang[:-1]))))
    weight = np.maximum(np.add.reduceat(counted, new), 1)
    whole = np.add.reduceat(score * counted[:, None], new, axis=0) / weight[:, None]
    _, lead, sure = model.decode(whole.astype(np.float32))
    doc = s.doc[new]
    place = np.arange(len(new)) - np.searchsorted(doc, doc)
    base = s.first[np.searchsorted(s.doc, doc)]
    names = ("en", "hi", "es", "fr")
    return doc.tolist(), (place + 1).tolist(), (s.first[new] - base + 1).tolist(), np.add.reduceat(s.n_words, new).tolist(), [names[k] for k in lang[new]], sure.astype(float).tolist(), (lead <= LEAD).tolist()


def segments(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(rec_id, lang, n_words, n_sentences, confidence, total_words, label): a row per language of a text.

    Texts without a sentence of SENTENCE_WORDS words count as one sentence. Null and blank texts have no rows.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label")).where("rec_id IS NOT NULL AND text IS NOT NULL")
    model = _fitted(rows)

    def run(batches):
        for batch in batches:
            labels = batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            for at, part in tc.chunks(batch.column(1).to_pylist()):
                out = decoded(part, model.value)
                doc = [at + d for d in out[0]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d in doc], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.float64()), pa.array(out[5], pa.int64()), pa.array([named_language(labels[d]) for d in doc], pa.string())],
                    ["rec_id", "lang", "n_words", "n_sentences", "confidence", "total_words", "label"],
                )

    return rows.mapInArrow(run, "rec_id bigint, lang string, n_words bigint, n_sentences bigint, confidence double, total_words bigint, label string")


def decoded(texts: list[str], model: Model) -> tuple[list, ...]:
    """Of a chunk: text, language, words, sentences, confidence and all words of the text, a row per language."""
    s = sentences_of(texts)
    if s is None:
        return [], [], [], [], [], []
    score, counted = bit_scores(s, model.weights)
    cls, lead, sure = model.decode(score)
    whole = (counted >= SENTENCE_WORDS) & (lead > LEAD)
    total = np.bincount(s.doc, s.n_words, minlength=len(texts)).astype(np.int64)
    lang_of = np.array([0, 1, 1, 2, 3])
    cell = s.doc[whole] * 4 + lang_of[cls[whole]]
    words = np.bincount(cell, counted[whole], minlength=4 * len(texts)).reshape(-1, 4)
    lines = np.bincount(cell, minlength=4 * len(texts)).reshape(-1, 4)
    conf = np.bincount(cell, sure[whole] * counted[whole], minlength=4 * len(texts)).reshape(-1, 4) / np.maximum(words, 1)
    # texts without a whole sentence
    mass = np.zeros((len(texts), score.shape[1]), np.float32)
    np.add.at(mass, s.doc, score * counted[:, None])
    n = np.bincount(s.doc, counted, minlength=len(texts))
    rest = np.flatnonzero((lines.sum(1) == 0) & (n > 0))
    if len(rest):
        c, _, p = model.decode(mass[rest] / n[rest, None])
        words[rest, lang_of[c]], lines[rest, lang_of[c]], conf[rest, lang_of[c]] = n[rest], 1, p
    doc, lang = np.nonzero(lines)
    return doc.tolist(), [("en", "hi", "es", "fr")[k] for k in lang], words[doc, lang].astype(np.int64).tolist(), lines[doc, lang].tolist(), conf[doc, lang].tolist(), total[doc].tolist()


def language_cases(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(rec_id, lang) of the cases: texts of five words or more whose label is missing, names no language or another
    than most of their words have, or which have whole sentences in several languages; a row per language found."""
    each = segments(df, id_col, text_col, lang_col).where(F.col("total_words") >= CASE_WORDS)
    main = F.max(F.struct("n_words", "lang"))
    whole = each.groupBy("rec_id").agg(main.alias("main"), F.max("label").alias("label"), F.collect_set("lang").alias("langs"))
    wrong = F.col("label").isNull() | (F.col("label") != F.col("main.lang")) | (F.size("langs") > 1)
    return whole.where(wrong).select("rec_id", F.explode("langs").alias("lang"))
