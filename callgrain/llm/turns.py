"""Noisy transcripts into clean speaker turns (problem 1), with a hidden Markov model over the tokens of a line.

A line is cut into marks (brackets, colons, dashes), times, hesitations and the words between them. A token's symbol is
its shape, case and place: words that look like a voice's name before a mark, words inside a pair of brackets, other
words. What a symbol means depends on its line: brackets may hold a time, a speaker, a sound or part of an address that
is spoken; a time may be spoken, and a name before a colon may be a label. The model tags each token as time, speaker,
annotation, filler or speech by Viterbi; its transition and emission probabilities start from weak counts and are fitted
to the lines of all files by rounds of Viterbi training. Turns are then assembled from the labels, in order of time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.session import cut

#: Rounds of fitting, and what the first shares weigh beside those counted.
ROUNDS, PRIOR = 2, 0.2

#: Names of voices by role; a name may be misspelled. Fixed values.
ROLES = {
    "caller": "caller scammer agent fraudster impostor".split(),
    "receiver": "receiver victim customer callee target".split(),
    "narrator": "narrator host anchor presenter voiceover commentator moderator".split(),
}
NUMBERED = re.compile(r"(?:speaker|person|spk|s|voice)[ _-]?0*(\d{1,2})", re.I)
#: Sounds that are noted, not spoken. Fixed values.
SOUNDS = frozenset(
    "silence laugh laughs laughing laughter sigh sighs cough coughs coughing music applause crosstalk inaudible unclear pause noise background typing phone ringing ring line beep static tune crying cries breath breathing throat indistinct overlap dial tone sound sounds".split()
)
#: Words for signs in addresses that are spelled out. Fixed values.
SIGNS = frozenset(("at", "dot"))

CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
HESITATION = r"(?:u+h*m+|u+h+m*|e+r+m*|h+m+|m{2,}h*m*|a+h+m*|e+h+)"
#: Times; hesitations; runs of one mark. Each begins with a set of characters, over which a scan is fast.
TIMES = re.compile(rf"{CLOCK}(?![\w:])")
UMS = re.compile(rf"(?<!\S){HESITATION}(?:\.{{1,3}}|…|,|-)*(?=\s|$)(?:\s+-(?=\s|$))?", re.I)
MARKS = re.compile(r"([\[({<\])}>*♪♫:|–—•-])\1*")
WORDLIKE = re.compile(r"[^\W_]")
_SECONDS = re.compile(r"\d+(?:\.\d+)?\s*s")
_NAME = re.compile(r"[A-ZÀ-Þ][\w.'’-]*(?: [A-ZÀ-Þ][\w.'’-]*){0,2}")
_LINES = re.compile(r"\r\n|\n|\r|\u2028|\x0b|\x0c")

SYMBOLS = ("arrow", "clock", "um", "[", "]", "(", ")", "{", "}", "<", ">", "*", "/*", "tune", "/tune", ":", "-", ">>", "role", "name", "sound", "sign", "inner", "secs", "num", "words")
_ID = {s: i for i, s in enumerate(SYMBOLS)}
_MARK = {**{c: _ID[c] for c in "[](){}<>*:"}, "♪": _ID["tune"], "♫": _ID["tune"], **dict.fromkeys("|–—•-", _ID["-"])}
_PAIRS = {_ID[a]: _ID[b] for a, b in ("[]", "()", "{}", "<>", ("*", "/*"), ("tune", "/tune"))}
_AFTER_ROLE = frozenset(_ID[s] for s in (":", "-", "]", ")", ">", "/*", "[", "("))
_AFTER_NAME = frozenset(_ID[s] for s in (":", "]", ")", ">", "/*"))
_ROLE, _NAMED, _SOUND, _SIGN, _INNER, _SECS, _NUM, _WORDS, _CLOCK = (_ID[s] for s in ("role", "name", "sound", "sign", "inner", "secs", "num", "words", "clock"))
_STAR, _TUNE, _DASH, _ARROW, _CHEVRON, _UM = (_ID[s] for s in ("*", "tune", "-", "arrow", ">>", "um"))

STATES = ("time", "speaker", "annotation", "filler", "speech")
T, S, N, U, W = range(5)

#: What the fitting starts from: how often a state shows as each symbol (others: FLOOR), and follows each state; the last
#: row begins a line.
FLOOR = 0.01
EMIT = {
    T: {"arrow": 20, "clock": 60, "[": 15, "]": 15, "(": 5, ")": 5, "secs": 20, "num": 0.1, "-": 10},
    S: {"role": 60, "name": 5, ":": 50, "[": 10, "]": 10, "(": 10, ")": 10, "<": 10, ">": 10, "*": 10, "/*": 10, "-": 8, ">>": 15},
    N: {**dict.fromkeys("[](){}<>*", 10), "/*": 10, "tune": 10, "/tune": 10, "sound": 60, "inner": 20, "num": 0.02, "words": 0.5, "-": 0.5},
    U: {"um": 200},
    W: {"words": 200, "um": 0.2, ":": 2, "(": 0.3, ")": 0.3, "[": 0.3, "]": 0.3, "-": 3, "clock": 3, "num": 5, "sign": 5, "role": 0.5, "name": 2, "inner": 0.3, "sound": 0.1, "*": 0.1, "/*": 0.1, "<": 0.1, ">": 0.1},
}
NEXT = {
    T: {T: 50, S: 40, N: 2, U: 3, W: 20},
    S: {T: 5, S: 50, N: 3, U: 5, W: 40},
    N: {T: 0.1, S: 5, N: 60, U: 2, W: 20},
    U: {T: 0.01, S: 0.01, N: 2, U: 1, W: 20},
    W: {T: 0.001, S: 0.001, N: 10, U: 10, W: 60},
    "begin": {T: 30, S: 40, N: 3, U: 3, W: 25},
}

Model = tuple[tuple[tuple[float, ...], ...], tuple[tuple[float, ...], ...]]


def _mixed(first: list[float], counted: list[float]) -> tuple[float, ...]:
    """Logarithms of the shares counted, mixed with those started from, so that what is rare stays possible."""
    a, b = sum(first), sum(counted)
    return tuple(math.log(x / a if not b else PRIOR * x / a + (1 - PRIOR) * y / b) for x, y in zip(first, counted))


def model_of(emitted: dict | None = None, followed: dict | None = None) -> Model:
    """The model from the first shares and counts of (state, symbol) and (state before or 5, state)."""
    emitted, followed = emitted or {}, followed or {}
    e = tuple(_mixed([EMIT[s].get(k, FLOOR) for k in SYMBOLS], [emitted.get((s, i), 0) for i in range(len(SYMBOLS))]) for s in range(5))
    n = tuple(_mixed([NEXT[p][s] for s in range(5)], [followed.get((i, s), 0) for s in range(5)]) for i, p in enumerate((T, S, N, U, W, "begin")))
    return e, n


def decoded(symbols: tuple[int, ...], model: Model) -> tuple[int, ...]:
    """The most probable states of a line's tokens; those of short lines, which recur, are kept."""
    return viterbi(symbols, model) if len(symbols) <= 64 else _viterbi(symbols, model)


def _viterbi(symbols: tuple[int, ...], model: Model) -> tuple[int, ...]:
    emit, follow = model
    best = [follow[5][s] + emit[s][symbols[0]] for s in range(5)]
    back = []
    for k in symbols[1:]:
        step, now = [], []
        for s in range(5):
            p = max(range(5), key=lambda q: best[q] + follow[q][s])
            step.append(p)
            now.append(best[p] + follow[p][s] + emit[s][k])
        back.append(step)
        best = now
    path = [max(range(5), key=best.__getitem__)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return tuple(reversed(path))


viterbi = lru_cache(maxsize=100_000)(_viterbi)


# ---------------------------------------------------------------- tokens


def _single(word: str) -> str:
    """Doubled letters once."""
    return re.sub(r"(.)\1+", r"\1", word)


def _near(a: str, b: str) -> bool:
    """Whether one letter left out, added, replaced or swapped with its neighbour makes a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


@lru_cache(maxsize=50_000)
def role(label: str) -> str | None:
    """caller, receiver or narrator; of numbered speakers the first calls and the second is called. None for a name that
    says neither. A name of five letters and more may have one letter wrong, and letters doubled."""
    label = label.strip().lower()
    if m := NUMBERED.fullmatch(label):
        return {1: "caller", 2: "receiver"}.get(int(m.group(1)), "narrator")
    word = label.replace("-", "").replace(" ", "")
    if len(word) > 16 or not word.isalpha():
        return None
    exact = next((r for r, names in ROLES.items() if word in names), None)
    if exact or len(word) < 5:
        return exact
    plain = _single(word)
    return next((r for r, names in ROLES.items() if any(_near(plain, _single(n)) for n in names)), None)


def _symbol(text: str, before: int, after: int) -> int:
    """The symbol of the words between two tokens."""
    s = text.strip()
    if len(s) > 60:
        return _WORDS
    if s[0].isdigit():
        if s.isdigit():
            return _NUM
        if _SECONDS.fullmatch(s):
            return _SECS
    if after in _AFTER_ROLE and len(s) < 20 and role(s):
        return _ROLE
    if _PAIRS.get(before) == after:
        low = s.lower()
        if low in SIGNS:
            return _SIGN
        return _SOUND if not SOUNDS.isdisjoint(low.split()) else _INNER
    if after in _AFTER_NAME and _NAME.fullmatch(s):
        return _NAMED
    return _WORDS


def _marks(line: str) -> list[tuple[int, int, int]]:
    """(symbol, first character, last + 1) of the times, hesitations and marks of a line, in order, some within others."""
    found = [(_CLOCK, *m.span()) for m in TIMES.finditer(line) if not m.start() or not (line[m.start() - 1] in ":.,_" or line[m.start() - 1].isalnum())]
    found += [(_UM, *m.span()) for m in UMS.finditer(line)]
    tune = False
    for m in MARKS.finditer(line):
        a, b = m.span()
        c = line[a]
        k = _MARK[c]
        if c == ":":
            if line[b : b + 1].isdigit():
                continue
        elif k == _DASH:
            if c == "-" and b - a == 2 and line[b : b + 1] == ">":
                k, b = _ARROW, b + 1
            elif not ((a == 0 or line[a - 1].isspace()) and (b == len(line) or line[b].isspace())):
                continue
        elif c == ">" and b - a == 2:
            k = _CHEVRON
        elif k == _STAR:  # stars close what stands right before them
            k += a > 0 and not line[a - 1].isspace()
        elif k == _TUNE:
            k += tune
            tune = not tune
        found.append((k, a, b))
    found.sort(key=itemgetter(1, 2))
    return found


def tokens(line: str) -> list[tuple[int, int, int]]:
    """(symbol, first character, last + 1) of a line."""
    found, at = [], 0
    for k, a, b in _marks(line):
        if a < at:
            continue
        if a > at and not line[at:a].isspace():
            found.append((-1, at, a))
        found.append((k, a, b))
        at = b
    if at < len(line) and not line[at:].isspace():
        found.append((-1, at, len(line)))
    last = len(found) - 1
    return [(k, a, b) if k >= 0 else (_symbol(line[a:b], found[i - 1][0] if i else -2, found[i + 1][0] if i < last else -2), a, b) for i, (k, a, b) in enumerate(found)]


def seconds(text: str) -> float | None:
    """When a time token begins."""
    m = re.search(r"\d[\d:.,]*", text)
    if not m:
        return None
    parts = m.group().replace(",", ".").rstrip(".:").split(":")
    try:
        return sum(float(p) * 60 ** (len(parts) - 1 - i) for i, p in enumerate(parts))
    except ValueError:
        return None


# ---------------------------------------------------------------- turns


def cues_of(text: str | None, model: Model) -> list[list]:
    """[when, place, label or None, spoken words] of the lines of a transcript, in order of time."""
    lines = [x.strip() for x in _LINES.split(text or "")]
    cues: list[list] = []
    when, seen = None, set()
    for i, line in enumerate(lines):
        if not line:
            continue
        if line.isdigit() and i + 1 < len(lines) and "-->" in lines[i + 1]:
            continue
        found = tokens(line)
        states = decoded(tuple(k for k, _, _ in found), model)
        stamp = next((line[a:b] for s, (k, a, b) in zip(states, found) if s == T and k in (_CLOCK, _SECS, _NUM)), None)
        if stamp is not None and (at := seconds(stamp)) is not None:
            when = at
            if all(s == T for s in states):
                continue
        if when is not None and (when, line) in seen:
            continue
        seen.add((when, line))
        label = next((line[a:b].strip() for s, (k, a, b) in zip(states, found) if s == S and k in (_ROLE, _NAMED)), None)
        parts, begin, end = [], None, None
        for s, (_, a, b) in zip(states, found):  # neighbouring tokens of speech keep what stands between them
            if s == W:
                begin, end = a if begin is None else begin, b
            elif begin is not None:
                parts.append(line[begin:end].strip())
                begin = None
        if begin is not None:
            parts.append(line[begin:end].strip())
        spoken = " ".join(p for p in parts if WORDLIKE.search(p))
        if spoken or label:
            cues.append([when, len(cues), label, spoken])
    cues.sort(key=lambda c: (c[0] if c[0] is not None else -1.0, c[1]))
    return cues


def voices_of(labels: list[str]) -> dict[str, str]:
    """The role of each label of a transcript. Labels that say no role take those that none has, in the order in which
    they appear, then narrator; they count if some label says a role, or one stands twice."""
    known = {x: role(x) for x in labels}
    held = {r for r in known.values() if r}
    times = Counter(x.lower() for x in labels)
    sure = bool(held) or any(n > 1 for n in times.values())
    free = [r for r in ("caller", "receiver") if r not in held]
    out: dict[str, str] = {}
    given: dict[str, str] = {}
    for x in labels:
        if known[x]:
            out[x] = known[x]
        elif sure:
            if x.lower() not in given:
                given[x.lower()] = free.pop(0) if free else "narrator"
            out[x] = given[x.lower()]
    return out


def turns_of(text: str | None, model: Model) -> list[tuple[str, str]]:
    """(speaker, spoken words) of the turns of a transcript, in order; none if no line has a speaker label.

    Words before the first label are its speaker's. What stands before a colon and is no label is spoken.
    """
    cues = cues_of(text, model)
    voices = voices_of([c[2] for c in cues if c[2]])
    if not voices:
        return []
    speaker = next(voices[c[2]] for c in cues if c[2] in voices)
    out: list[list[str]] = []
    for _, _, label, spoken in cues:
        if label in voices:
            speaker = voices[label]
        elif label:
            spoken = f"{label} {spoken}"
        if not spoken:
            continue
        if out and out[-1][0] == speaker:
            out[-1][1] += " " + spoken
        else:
            out.append([speaker, spoken])
    return [(a, b) for a, b in out]


def count_words(spoken: str) -> int:
    return sum(1 for p in spoken.split() if WORDLIKE.search(p))


# ---------------------------------------------------------------- fitting


def _pattern_batches(batches):
    for batch in batches:
        seen: Counter = Counter()
        for t in batch.column(0).to_pylist():
            for line in _LINES.split(t):
                if line := line.strip():
                    seen[bytes(k for k, _, _ in tokens(line))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])


def tally(patterns, model: Model) -> Counter:
    """How often (kind, state or state before, symbol or state) holds in (pattern, n), tagged by the model."""
    out: Counter = Counter()
    for pattern, n in patterns:
        symbols = tuple(pattern)
        path = decoded(symbols, model)
        for k, s in zip(symbols, path):
            out["e", s, k] += n
        for p, s in zip((5, *path), path):
            out["f", p, s] += n
    return out


def refit(counts: dict) -> Model:
    return model_of({(s, k): n for (kind, s, k), n in counts.items() if kind == "e"}, {(p, s): n for (kind, p, s), n in counts.items() if kind == "f"})


def fit(texts: DataFrame) -> Model:
    """The model after rounds of tagging the lines of all texts (text) and counting anew; a round's counts are some 150
    numbers, added up in Spark."""
    patterns = texts.mapInArrow(_pattern_batches, "pattern binary, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    patterns = cut(patterns, "patterns")
    model = model_of()
    for _ in range(ROUNDS):

        def count(batches, model=model):
            for batch in batches:
                got = tally(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), model)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.int32()), pa.array([k[2] for k in got], pa.int32()), pa.array(list(got.values()), pa.int64())], ["kind", "a", "b", "n"])

        counts = patterns.mapInArrow(count, "kind string, a int, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
        model = refit({(r.kind, r.a, r.b): r.n for r in counts.collect()})
    return model


def clean_turns(df: DataFrame, file_col: str, text_col: str, loaded_col: str | None = None) -> DataFrame:
    """(source_file, turn_no, speaker, n_words, text): the clean turns of each file.

    A file that is loaded several times counts once, with its first load that has a text. Files with a null name, null
    and blank texts and texts without any speaker label have no rows. Of equal lines with the same time one counts.
    """
    order = [F.col(loaded_col).alias("loaded")] if loaded_col else []
    rows = df.select(F.col(file_col).alias("source_file"), F.col(text_col).alias("text"), *order).where("source_file IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''")
    first = F.struct(*([F.col("loaded").isNull(), F.col("loaded")] if loaded_col else []), F.xxhash64("text"))
    files = rows.groupBy("source_file").agg(F.min_by("text", first).alias("text"))
    model = fit(rows.select("text"))

    def run(batches):
        for batch in batches:
            f, n, s, c, w = [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (speaker, spoken) in enumerate(turns_of(text, model), 1):
                    f.append(name)
                    n.append(i)
                    s.append(speaker)
                    c.append(count_words(spoken))
                    w.append(" ".join(spoken.split()))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(n, pa.int32()), pa.array(s, pa.string()), pa.array(c, pa.int32()), pa.array(w, pa.string())], ["source_file", "turn_no", "speaker", "n_words", "text"])

    return files.mapInArrow(run, "source_file string, turn_no int, speaker string, n_words int, text string")
