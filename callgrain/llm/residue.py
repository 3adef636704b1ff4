"""Template residue, filler and error-page text (problem 10).

Every line of every document is a unit, with its label taken off and its numbers, addresses, dates and bracketed marks
masked; so is every bracketed slot, and the phrase that a text repeats over and over. Exact hashes of the units are
grouped across documents and sources. Phrase and placeholder rules then classify each group once, by one of its texts: a
unit that recurs in MANY_DOCS documents of MANY_SOURCES sources needs a weak sign, any other a strong one. The verdict
goes back to the documents by hash: a slot or a stub decides by itself, a message only where little else stands beside it.

Mock text, whose units never recur, is found by its words: words that recur across sources, follow each other in any
order, and never stand beside a common word of the corpus.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm import textcodes as tc
from callgrain.session import cut

MANY_DOCS, MANY_SOURCES = 3, 2
#: Most words beside messages and menus in a document that consists of a message.
REST_WORDS = 12
#: Most characters of a menu or a bare address.
MENU_CHARS = 400
#: Share of documents, and least number, from which on a word is common; fewest words of mock text; least share of them
#: in its vocabulary; fewest and most different words that may follow a word of it.
COMMON, COMMON_LEAST = 0.02, 20
MOCK_WORDS, MOCK_SHARE, FOLLOWERS = 5, 0.8, (3, 200)
#: Longest phrase that is looked for as repeated, and the least number of its words in a row.
CYCLE, CYCLE_WORDS = 8, 5

REASONS = ("placeholder", "stub", "filler", "scripts", "error")
LINE, SLOT, REPEAT, WORD = range(4)

#: Words that name a voice before a turn. Fixed values.
VOICES = "caller receiver scammer victim customer agent callee narrator person speaker spk host s".split()
_VOICE = rf"(?:{'|'.join(VOICES)})(?:[ _-]?\d+)?"
#: Names of slots in templates. Fixed values.
SLOTS = "name|amount|city|company|victim|ref_no|otp_code|date_of_call|bank_name|caller_name|date|time|place|phone|email|address|bank|caller|number|code|title|location"
#: Sound notes that use the same brackets as slots. Fixed values.
NOTES = "crosstalk|sighs?|laughs?|laughter|laughing|inaudible|unclear|music|noise|background noise|pause|silence|coughs?|applause|phone ringing|ringing|typing sounds?|line drops|beep|static|cries|crying|whispers?"

_SLOT = rf"(?:{SLOTS.replace('_', '[_ ]')})"
_ANY = r"[^\W\d_][\w .-]{0,40}"
#: Ways in which templates mark a slot that was to be filled, in lower case.
STRONG_SLOT = re.compile(
    "|".join(
        [
            rf"\{{\{{\s*{_ANY}\}}\}}",
            rf"\{{%\s*{_ANY}%\}}",
            rf"\$\{{\s*{_ANY}\}}",
            rf"\[\[\s*{_ANY}\]\]",
            rf"<<\s*{_ANY}>>",
            r"__[^\W\d_]+(?:_[^\W_]+)*__",
            rf"@@{_ANY}@@",
            r"%\([^\W\d]+\)[sd]",
            r"\[\s*(?:insert|your|enter|add)\s+[^\W\d][\w ]{0,40}\]",
            rf"\{{\s*{_SLOT}\s*\}}",
            rf"<\s*{_SLOT}\s*>",
            r"[{<]\s*[^\W\d_]+_[^\W\d]+\s*[}>]",
        ]
    )
)
#: Brackets that may be a slot; only widely recurring ones count, and sound notes and labels never do.
WEAK_SLOT = re.compile(rf"[{{<](?!\s*(?:{NOTES}|{_VOICE})\s*[}}>])\s*[^\W\d_]+(?: [^\W\d_]+)?\s*[}}>]")
_BRACKETS = ("{", "<", "[", "__", "@@", "%(")
#: Turns that were never written, in lower case and without a label.
STUB = re.compile(
    r"[\W_]*(?:\[?object object\]?|(?:todo|tbd|fixme|xxx)\b.*|undefined|null|nan"
    r"|(?:\w+ )?(?:dialogue|dialog|text|transcript|content|turn|line)s? (?:goes |go |comes )?here"
    r"|(?:insert|add|write|your) (?:\w+ )?(?:dialogue|dialog|text|transcript|content|turn|line)(?: here)?)[\W_]*"
)
#: Words that a stub begins or ends with.
STUB_WORDS = "object todo tbd fixme xxx undefined null nan insert add write your here dialogue dialog text transcript content turn line lorem"
#: What pages run and what they show, by which a message is told from speech; in four languages. Fixed values.
SCRIPT_NOUNS = r"java ?scripts?|scripts?|cookies"
PAGE_NOUNS = r"pages?|página|browser|navegador|navigateur|servers?|serveur|servidor|site|website|proxy|gateway|request|http|https|session|login|traceback|exception|transcript|message|app|url"
#: What went wrong with them, or what they ask for. Fixed values.
TROUBLE = r"not found|introuvable|encontrar|encontrada?|trouvé|denied|forbidden|refus\w+|expired|expir\w+|unavailable|no longer available|uplabdh nahi|wrong|removed|error|erreur|timeout|time-?out|\w+error|bad gateway|too many|permission|could not|cannot|most recent call"
DEMANDS = r"enable|activate|activate|active|activer|allow|turn\w* (?:on|off)|switch\w* (?:it )?on|chalu|requires?|needs?|does not (?:run|support)|refresh|reload|try (?:again )?later|sign in|réessayez|inténtelo|koshish|checking your browser|go back"
_STATUS = r"(?<![\w-])[45]\d\d(?![\w-])"
_SCRIPT, _PAGE, _TROUBLE, _DEMAND, STATUS = (re.compile(rf"(?<!\w)(?:{x})(?!\w)" if x != _STATUS else x) for x in (SCRIPT_NOUNS, PAGE_NOUNS, TROUBLE, DEMANDS, _STATUS))
#: What stands beside a message: menus, bare addresses, lines of a trace.
BESIDE = re.compile(r"[^\W\d_]{2,20}(?:(?:\s*[|»>]\s*|\s{2,})[^\W\d_]{2,20}){1,8}|file \".*|\S+\.\w+\S*(?: proxy, .*)?")
#: What a group must hold to be classified if it doesn't recur: a superset of the strong rules, for the JVM.
SIGN = rf"(?i)(?<!\w)(?:{SCRIPT_NOUNS}|{PAGE_NOUNS}|{TROUBLE})(?!\w)|[45]\d\d|todo|tbd|fixme|xxx|undefined|null|nan|object|here|dialog|content|turn|text|line|lorem|\|"

_ADDRESS = re.compile(r"https?://\S+|[\w-]+(?:[./@_][\w-]+)+")
_MARK = re.compile(r"\([^()\n]*\d[^()\n]*\)")
_CODE = re.compile(r"\w*\d[\w/:.,\-]*")


def masked(text: str) -> str:
    """Lower case, with bracketed marks, addresses, dates, codes and numbers replaced, and single spaces."""
    t = _CODE.sub("0", _ADDRESS.sub("<addr>", _MARK.sub("(0)", text.lower())))
    return " ".join(t.split())


# ---------------------------------------------------------------- units

_JOINTS = np.array([ord(c) for c in "-_./@:'’"], np.uint32)
_ADDRESS_JOINTS = np.array([ord(c) for c in "_./@"], np.uint32)
_LABEL_MARKS = np.array([ord(c) for c in ":>-])*"], np.uint32)
_BREAKS = np.array([10, 13, 11, 12, 0x2028], np.uint32)
_NUMBER, _ADDR = np.uint64(1), np.uint64(2)


@lru_cache(maxsize=1)
def _voices() -> np.ndarray:
    return np.unique(tc.words_of([" ".join(VOICES)]).hash)


@lru_cache(maxsize=1)
def _stub_hashes() -> np.ndarray:
    return np.unique(tc.words_of([STUB_WORDS]).hash)


class Lines:
    """The words of a chunk, masked and by line, without the labels of turns."""

    def __init__(self, texts: list[str]):
        w = tc.words_of(texts)
        self.words, n = w, len(w.hash)
        codes = w.codes
        broken = np.cumsum(np.isin(codes, _BREAKS))
        line = broken[w.start] if n else np.zeros(0, np.int64)
        first = np.concatenate(([True], line[1:] != line[:-1])) if n else np.zeros(0, bool)
        digits = np.concatenate(([0], np.cumsum((codes >= 48) & (codes <= 57))))
        digit = digits[w.end] > digits[w.start]
        gap_end = np.append(w.start[1:], len(codes)) if n else w.start
        # labels: a voice's name, or that and a number, at the start of a line and before a mark
        marks = np.concatenate(([0], np.cumsum(np.isin(codes, _LABEL_MARKS))))
        marked = marks[gap_end] > marks[w.end]
        voice = first & np.isin(w.hash, _voices())
        second = np.zeros(n, bool)
        second[1:] = voice[:-1] & digit[1:] & ~first[1:]
        numbered = np.append(second[1:], False) if n else second
        label = voice & np.where(numbered, np.append(marked[1:], False) if n else marked, marked)
        label[1:] |= second[1:] & label[:-1]
        # masks: tokens with a digit, tokens joined as addresses are, brackets with a digit
        gap = np.zeros(n, np.int64)
        gap[1:] = w.start[1:] - w.end[:-1]
        joint = np.zeros(n, np.uint32)
        joint[1:] = codes[w.end[:-1]]
        joined = (gap == 1) & np.isin(joint, _JOINTS) & ~first
        token = np.cumsum(~joined)
        size = int(token[-1]) + 1 if n else 1
        number = np.bincount(token, digit, minlength=size)[token] > 0
        address = np.bincount(token, joined & np.isin(joint, _ADDRESS_JOINTS), minlength=size)[token] > 0
        opened, closed = np.cumsum(codes == 40), np.cumsum(codes == 41)
        inside = opened[w.start] > closed[w.start] if n else np.zeros(0, bool)
        group = np.where(inside, opened[w.start], 0) if n else np.zeros(0, np.int64)
        number |= inside & (np.bincount(group, digit, minlength=int(group.max()) + 1 if n else 1)[group] > 0)
        value = np.where(number, _NUMBER, np.where(address, _ADDR, w.hash))
        same = np.zeros(n, bool)
        same[1:] = (value[1:] == value[:-1]) & (value[1:] <= _ADDR) & ~first[1:]
        self.plain = ~number & ~address & ~label
        self.keep = ~label & ~same
        self.value, self.label, self.line = value, label, line
        self.labelled = np.bincount(w.doc[label], minlength=len(texts)) > 0
        self.total = np.bincount(w.doc[~label], minlength=len(texts))

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, words, first code point, last + 1, whether it may be a stub) of each different line of a text
        that holds a word beside its label; words are those of all its equal lines."""
        w = self.words
        at = np.flatnonzero(self.keep)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, np.zeros(0, np.uint64), none, none, none, np.zeros(0, bool)
        line = self.line[at]
        run = tc.firsts(line)
        length = np.diff(np.append(run, len(at)))
        place = np.arange(len(at)) - np.repeat(run, length)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(tc.mix(self.value[at]) * tc.powers(tc.BASE_A, int(length.max()) + 1)[place], run)
            h = tc.mix(h + length.astype(np.uint64) * tc.SEED_B)
        words = np.bincount(self.line[~self.label], minlength=int(self.line[-1]) + 1)[line[run]]
        last = at[np.append(run[1:], len(at)) - 1]
        stub = np.isin(w.hash[at[run]], _stub_hashes()) | np.isin(w.hash[last], _stub_hashes())
        doc = w.doc[at[run]]
        order = np.lexsort((h, doc))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
        pick = order[new]
        return doc[pick], h[pick], np.add.reduceat(words[order], np.flatnonzero(new)), w.start[at[run]][pick], w.end[last][pick], stub[pick]

    def cycles(self) -> list[tuple[int, int, int, int]]:
        """(text, hash, first code point, last + 1) of the phrase that a text repeats over and over."""
        w = self.words
        at = np.flatnonzero(self.keep)
        doc, value = w.doc[at], self.value[at]
        run = tc.firsts(doc)
        length = np.diff(np.append(run, len(at)))
        out, done = [], np.zeros(len(run), bool)
        for p in range(1, CYCLE + 1):
            again = np.zeros(len(at), bool)
            again[p:] = (value[p:] == value[:-p]) & (doc[p:] == doc[:-p])
            hits = np.add.reduceat(again, run, dtype=np.int64) if len(run) else np.zeros(0, np.int64)
            found = ~done & (length >= max(CYCLE_WORDS, 3 * p)) & (hits + p + 1 >= length)
            done |= found
            for k in np.flatnonzero(found):
                own = at[run[k] : run[k] + p]
                with np.errstate(over="ignore"):
                    h = tc.mix(np.array([tc.mix(self.value[own] ^ tc.SEED_A).sum() + np.uint64(p)], np.uint64))[0]
                out.append((int(doc[run[k]]), int(h.view(np.int64)), int(w.start[own[0]]), int(w.end[own[-1]])))
        return out

    def word_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Each plain word's number of texts in the chunk."""
        at = np.flatnonzero(self.plain)
        key = np.unique((self.words.doc[at].astype(np.uint64) << tc.WORD_BITS) | (self.words.hash[at] & tc.WORD_MASK)) & tc.WORD_MASK
        return np.unique(key, return_counts=True)


UNITS = "kind tinyint, doc_id bigint, source string, unit bigint, n int, total int, labelled boolean, text string"


def _slots(low: str) -> list[str]:
    return sorted({m.group() for m in STRONG_SLOT.finditer(low)} | {m.group() for m in WEAK_SLOT.finditer(low)})


def _unit_batches(batches):
    for batch in batches:
        ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, part in tc.chunks(batch.column(2).to_pylist()):
            part = [t.casefold() for t in part]
            x = Lines(part)
            doc, unit, n, start, end, stub = x.hashes()
            # one text of each unit of the chunk is enough; a labelled line can be no more than a stub
            told = np.flatnonzero(~x.labelled[doc] | stub)
            once = np.zeros(len(unit), bool)
            once[told[np.unique(unit[told], return_index=True)[1]]] = True
            joined = "\n".join(part) + "\n"
            rows = [(LINE, d, int(u), int(k), joined[a:b] if o else None) for d, u, k, a, b, o in zip(doc.tolist(), unit.view(np.int64), n, _begin(joined, start), _finish(joined, end), once)]
            rows += [(REPEAT, d, h, 0, joined[a:b]) for d, h, a, b in x.cycles()]
            for d, t in enumerate(part):
                if any(b in t for b in _BRACKETS):
                    rows += [(SLOT, d, _text_hash(s), 0, s) for s in _slots(t)]
            word, count = x.word_counts()
            k = len(word)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows] + [WORD] * k, pa.int8()),
                    pa.array([ids[at + r[1]] for r in rows] + [None] * k, pa.int64()),
                    pa.array([sources[at + r[1]] for r in rows] + [None] * k, pa.string()),
                    pa.array([r[2] for r in rows] + word.view(np.int64).tolist(), pa.int64()),
                    pa.array([r[3] for r in rows] + count.tolist(), pa.int32()),
                    pa.array([int(x.total[r[1]]) for r in rows] + [0] * k, pa.int32()),
                    pa.array([bool(x.labelled[r[1]]) for r in rows] + [False] * k, pa.bool_()),
                    pa.array([r[4] for r in rows] + [None] * k, pa.string()),
                ],
                [c.split()[0] for c in UNITS.split(", ")],
            )


def _text_hash(s: str) -> int:
    h = tc.words_of([s]).hash
    with np.errstate(over="ignore"):
        return int(tc.mix(np.array([h.sum() * tc.BASE_A + np.uint64(sum(map(ord, s)))], np.uint64)).view(np.int64)[0])


def _begin(text: str, at: np.ndarray) -> list[int]:
    """The places of brackets and quotes just before, so that a unit's text keeps them."""
    return [a - 1 if a and text[a - 1] in "[{(<\"'_" else a for a in at.tolist()]


def _finish(text: str, at: np.ndarray) -> list[int]:
    return [b + 1 if text[b] in "]})>\"'_" else b for b in at.tolist()]


# ---------------------------------------------------------------- rules


def classify(kind: int, text: str) -> tuple[str | None, bool]:
    """(reason, whether the sign is strong) of a unit, by one of its texts in lower case; 'beside' is what may stand
    beside a message."""
    if kind == SLOT:
        return "placeholder", STRONG_SLOT.fullmatch(text) is not None
    if kind == REPEAT:
        return "filler", True
    if STUB.fullmatch(text):
        return "stub", True
    if "lorem ipsum" in " ".join(text.split()):
        return "filler", True
    script, page, trouble, demand = (len(set(p.findall(text))) for p in (_SCRIPT, _PAGE, _TROUBLE, _DEMAND))
    status = STATUS.search(text) is not None
    if len(text) <= MENU_CHARS and BESIDE.fullmatch(text.strip()) and not (trouble or status):
        return "beside", True
    if script and demand:
        return "scripts", True
    signs = script + page + trouble + demand + status
    strong = (trouble + demand > 0 and (page or script or status or trouble + demand > 1)) or (status and page > 0) or page + trouble >= 3
    return ("scripts" if script else "error", bool(strong)) if signs else (None, False)


# ---------------------------------------------------------------- operators


def _docs(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL")


def verdicts(units: DataFrame) -> DataFrame:
    """(kind, unit, n_docs, n_sources, text, reason, wide) of the groups of units that a rule takes for residue."""
    own = units.where(F.col("kind") != WORD)
    sizes = own.groupBy("kind", "unit", "source").agg(F.count("*").alias("n")).groupBy("kind", "unit").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_sources"))
    wide = (F.col("n_docs") >= MANY_DOCS) & (F.col("n_sources") >= MANY_SOURCES)
    texts = own.where("text IS NOT NULL").select("kind", "unit", "text").join(sizes.withColumn("wide", wide), ["kind", "unit"]).where(F.col("wide") | (F.col("kind") != LINE) | F.col("text").rlike(SIGN))
    groups = texts.groupBy("kind", "unit", "n_docs", "n_sources", "wide").agg(F.min("text").alias("text"))
    judged = groups.select("kind", "unit", "text", "n_docs", "n_sources", "wide").mapInArrow(_judged_batches, "kind tinyint, unit bigint, text string, n_docs bigint, n_sources bigint, wide boolean, reason string, strong boolean")
    return judged.where("reason IS NOT NULL AND (wide OR strong)").drop("strong")


def _judged_batches(batches):
    for batch in batches:
        got = [classify(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in got], pa.string()), pa.array([s for _, s in got], pa.bool_())], [*batch.schema.names, "reason", "strong"])


def _mock_batches(common: np.ndarray):
    def run(batches):
        for batch in batches:
            ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in tc.chunks(batch.column(2).to_pylist()):
                x = Lines(part)
                w = x.words
                keep = np.flatnonzero(x.plain)
                doc, value = w.doc[keep], w.hash[keep] & tc.WORD_MASK
                known = np.bincount(doc, np.isin(value, common), minlength=len(part))
                size = np.bincount(doc, minlength=len(part))
                mine = ((known == 0) & (size >= MOCK_WORDS))[doc]
                doc, value = doc[mine], value[mine]
                after = np.zeros(len(value), np.uint64)
                after[:-1] = np.where(doc[1:] == doc[:-1], value[1:], 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[at + d] for d in doc], pa.int64()), pa.array([sources[at + d] for d in doc], pa.string()), pa.array(value.view(np.int64)), pa.array(after.view(np.int64))],
                    ["doc_id", "source", "word", "after"],
                )

    return run


def mock_texts(docs: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id of texts in the closed vocabulary of mock text; docs: (doc_id, source, text)."""
    n_docs = docs.count()
    counted = units.where(F.col("kind") == WORD).groupBy("unit").agg(F.sum("n").alias("n"))
    # at most (words of a text) / COMMON words can come out, so what is sent to all executors doesn't grow
    common = counted.where(F.col("n") > max(COMMON * n_docs, COMMON_LEAST)).select("unit").toArrow().column("unit").to_numpy().astype(np.int64).view(np.uint64)
    words = cut(docs.mapInArrow(_mock_batches(np.sort(common)), "doc_id bigint, source string, word bigint, after bigint"), "mock")
    spread = words.groupBy("word").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("source").alias("sources"))
    follow = words.where("after <> 0").select("word", "after").distinct().groupBy("word").agg(F.count("*").alias("followers"))
    closed = spread.join(follow, "word").where((F.col("docs") >= MANY_DOCS) & (F.col("sources") >= MANY_SOURCES) & F.col("followers").between(*FOLLOWERS)).select("word", F.lit(1).alias("closed"))
    own = words.join(closed, "word", "left").groupBy("doc_id").agg(F.count("closed").alias("k"), F.count("*").alias("n"))
    return own.where(F.col("k") >= MOCK_SHARE * F.col("n")).select("doc_id")


def judged(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, reason, route): as `residue`, and whether a recurring group, its words or a rule alone decided."""
    docs = _docs(df, id_col, text_col, source_col)
    units = cut(docs.mapInArrow(_unit_batches, UNITS), "units")
    found = cut(verdicts(units), "verdicts").select("kind", "unit", "reason", "wide")
    told = units.where(F.col("kind") != WORD).join(found, ["kind", "unit"])
    message = F.col("reason").isin("scripts", "error")
    own = told.groupBy("doc_id").agg(
        F.max((F.col("reason") == "placeholder") & F.col("wide")).alias("slot_wide"),
        F.max(F.col("reason") == "placeholder").alias("slot"),
        F.max((F.col("reason") == "stub") & F.col("wide")).alias("stub_wide"),
        F.max(F.col("reason") == "stub").alias("stub"),
        F.max((F.col("reason") == "filler") & F.col("wide")).alias("filler_wide"),
        F.max((F.col("reason") == "filler")).alias("filler"),
        F.max((F.col("reason") == "scripts")).alias("scripts"),
        F.max(message & F.col("wide")).alias("message_wide"),
        F.sum(F.when(message, F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(message | (F.col("reason") == "beside"), F.col("n")).otherwise(0)).alias("covered"),
        F.max("total").alias("total"),
        F.max("labelled").alias("labelled"),
    )
    # a message must make up most of its document, however few words stand beside it
    whole = ~F.col("labelled") & (F.col("said") > 0) & (F.col("total") - F.col("covered") <= F.least(F.lit(REST_WORDS), F.col("covered")))
    route = lambda x: F.when(F.col(x), "group").otherwise("rule")
    rules = own.select(
        "doc_id",
        F.when(F.col("slot"), F.struct(F.lit("placeholder").alias("reason"), route("slot_wide").alias("route")))
        .when(F.col("stub"), F.struct(F.lit("stub").alias("reason"), route("stub_wide").alias("route")))
        .when(F.col("filler"), F.struct(F.lit("filler").alias("reason"), route("filler_wide").alias("route")))
        .when(whole, F.struct(F.when(F.col("scripts"), "scripts").otherwise("error").alias("reason"), route("message_wide").alias("route"))).alias("r"),
    ).where("r IS NOT NULL").select("doc_id", "r.reason", "r.route")
    mock = mock_texts(docs, units).select("doc_id", F.lit("filler").alias("reason"), F.lit("words").alias("route"))
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    best = F.min(F.struct(rank.alias("k"), (F.col("route") == "rule").alias("late"), "reason", "route")).alias("best")
    return rules.unionByName(mock).groupBy("doc_id").agg(best).select("doc_id", "best.reason", "best.route")


def residue(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, reason) of documents with residue; reason is placeholder, stub, filler, scripts or error.

    Null and blank texts, sound notes, control strings of tokenizers and calls whose speakers talk of such pages have no
    row. Null sources count as one source. A document has one row, with its first reason in the order above.
    """
    return judged(df, id_col, text_col, source_col).select("doc_id", "reason")


def routes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(reason, route, n_docs): by a recurring group of units, by the words of mock text, or by a strong rule alone."""
    return judged(df, id_col, text_col, source_col).groupBy("reason", "route").agg(F.count("*").alias("n_docs"))


def _masked_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([masked(t) for t in batch.column(3).to_pylist()], pa.string())], ["reason", "n_docs", "n_sources", "message"])


def messages(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(reason, n_docs, n_sources, message) of the recurring groups of units that are residue, masked; over all documents."""
    units = cut(_docs(df, id_col, text_col, source_col).mapInArrow(_unit_batches, UNITS), "units")
    found = verdicts(units).where("wide AND reason <> 'beside'").select("reason", "n_docs", "n_sources", "text")
    return found.mapInArrow(_masked_batches, "reason string, n_docs bigint, n_sources bigint, message string")
