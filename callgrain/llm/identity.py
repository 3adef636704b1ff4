"""Personal information inside free text (problem 4), by bootstrapped contextual extraction.

Seeds are few: addresses of mail with their sign, numbers that begin with a plus, two forms of identity numbers, three
layouts of postal addresses, ten given names. What could be personal is generic: any longer number or code, numbers
spelled out, mail spelled out, capitalised words around a house number, capitalised names. Of each candidate the context
(two words before, one after) and the form (letters and digits masked; of a name the given name) are edges of a graph
over all texts of all tables; Spark scores it in rounds: a context counts as far as its forms are known, a form as far as
its contexts are sure. What is sure then finds entities in every text: contexts whatever stands between their words,
forms wherever they stand, layouts of addresses that were learnt, and names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm.turns import CLOCK, seconds
from callgrain.session import cut

#: Rounds of scoring; least score and share of all edges of its kind for a context, and least number; least score of a
#: form or name; what a context needs in the first round.
ROUNDS = 3
SURE, SUPPORT, SHARE, SURE_FORM = 0.5, 5, 0.001, 0.8
FIRST_SURE = 0.12
#: Share of address candidates from which on a word belongs to their layout, and a layout is kept.
KEYWORD_SHARE, LAYOUT_SHARE = 0.04, 0.003
#: Least share of all places of names that a given name and a surname hold, so that a million of each can come out at most.
NAME_SHARE = 1e-6
#: Characters that a context may reach to either side, and most words of an entity between the words of its context.
BEFORE, AFTER, MOST_WORDS = 60, 40, 14

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
#: Given names that start the bootstrap. Fixed values.
SEED_NAMES = frozenset("ankit deepak elena hannah imran kavya lucia martin sunita vikram".split())
#: Forms of identity numbers that start it: A for letters, 0 for digits. Fixed values.
SEED_IDS = ("000-00-0000", "0000 0000 0000")
#: Words that make a name a firm's. Fixed values.
FIRM = frozenset("bank credit trust mutual finserv telecom logistics couriers services securities finance insurance ltd limited pvt inc group company capital".split())
DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple"
_L = r"[^\W\d_]"

MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*")
SPELLED = re.compile(
    r"[\w.+-]+\s?[\[(]\s?at\s?[\])]\s?[\w-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[\w-]+)*"
    r"|[\w+-]+(?:\s+dot\s+[\w+-]+)*\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+"
)
#: A plus or bracket before it belongs to it; a pattern that begins with a digit is searched for faster.
NUMBER = re.compile(r"\d(?:[ ()\-]{0,2}\d){3,}")
SPOKEN = re.compile(rf"(?:{DIGIT_WORDS})(?:[\s,.-]+(?:{DIGIT_WORDS})\b){{6,}}")
_EACH_DIGIT = tuple(DIGIT_WORDS.split("|"))
_DIGIT_WORD = re.compile(rf"(?:{DIGIT_WORDS})[,.-]*")
#: Layouts of addresses that start the bootstrap.
SEED_ADDRESS = re.compile(
    rf"\d+[a-z]?,?\s+{_L}+\s+(?:street|road|lane),?\s+{_L}+(?:\s?[-–,]?\s?\d{{5,6}}\b)?"
    rf"|\d+(?:\s+(?:bis|ter))?,?\s+(?:rue|avenue|boulevard)\s+(?:(?:de la|du|des|de)\s+)?{_L}+,?\s+(?:\d{{5}}\s+)?{_L}+"
    rf"|(?:calle|avenida|plaza)\s+(?:(?:de la|del|de)\s+)?{_L}+,?\s+\d+,?\s+(?:\d+\s?[a-z]?,?\s+)?{_L}+(?:\s?[-–,]?\s?\d{{5}}\b)?"
)
_STREETS = (" street", " road", " lane", " rue ", "avenue ", "boulevard ", "calle ", "avenida ", "plaza ")
_SPACE = re.compile(r"\s+")
_ANCHOR = re.compile(r"\d[A-Za-z]?,\s")
_BLANK = re.compile(r"\s*")


def plain(value: str) -> str:
    """Lower case, letters and digits alone (vowel signs count as parts of their letters)."""
    return "".join(c for c in value.lower() if c.isalnum() or "ऀ" <= c <= "ॣ")


_FORM = {**{ord(c): "0" for c in "0123456789"}, **{ord(c): "A" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}}


def numbers(text: str) -> list[tuple[str, int, int]]:
    """(form, start, end) of the numbers and codes of a text that are long enough to name somebody."""
    out = []
    size = len(text)
    for m in NUMBER.finditer(text):
        begin, b = m.span()
        if begin and text[begin - 1] in "+(":
            begin -= 1
        a = begin
        if b - a < 7 and not (a and text[a - 1].isalpha()) and not text[b : b + 1].isalpha():
            continue
        if text[a].isdigit():
            while a and text[a - 1].isascii() and text[a - 1].isalpha() and begin - a < 6:
                a -= 1
        if b < size and text[b].isascii() and text[b].isalpha():
            b += 1
        if (b < size and (text[b].isalnum() or text[b] in "@_")) or (a and (text[a - 1].isalnum() or text[a - 1] in "_@/." or (text[a - 1] == "," and a > 1 and text[a - 2].isdigit()))):
            continue
        form = text[a:b].translate(_FORM)
        if sum(c in "0A" for c in form) >= 8:
            out.append((form, a, b))
    return out


@lru_cache(8)
def _scan_for(words: tuple[str, ...]):
    """An automaton over a few strings, which reads a text once for all of them."""
    import ahocorasick

    scan = ahocorasick.Automaton()
    for w in words:
        scan.add_word(w, 1)
    scan.make_automaton()
    return scan


def _holds(low: str, words: tuple[str, ...]) -> bool:
    return next(_scan_for(words).iter(low), None) is not None


def _addresses(low: str) -> list[tuple[str, int, int]]:
    return [("street_address", *m.span()) for m in SEED_ADDRESS.finditer(low) if not m.start() or not (low[m.start() - 1].isalnum() or low[m.start() - 1] == "_")]


def seeds(text: str, low: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of the entities that start the bootstrap, names aside."""
    out: list[tuple[str, int, int]] = []
    if "@" in low:
        out += [("email", *m.span()) for m in MAIL.finditer(low)]
    if _holds(low, _STREETS):
        out += _addresses(low)
    return out


def _digit_words(low: str) -> int:
    """How often digits in words stand in a text, as parts of other words too."""
    return sum(1 for _ in _scan_for(_EACH_DIGIT).iter(low))


def spelled(low: str, digits: int = 7) -> list[tuple[str, str, int, int]]:
    """(type, form, start, end) of mail and numbers that are spelled out; digits: at most so many digits in words."""
    out = []
    if "[at" in low or "(at" in low or " dot " in low or "\ndot " in low:
        out += [("email", "spelled", *m.span()) for m in SPELLED.finditer(low)]
    out += [] if digits < 7 else [("phone", "spoken", *m.span()) for m in SPOKEN.finditer(low) if not (m.start() and low[m.start() - 1].isalnum())]
    return out


# ---------------------------------------------------------------- contexts

TOKEN = re.compile(r"\S+")
_ENDS = re.compile(r"[.!?।]+[\"'”»)*]*$")


_DIGITS = re.compile(r"\d+")
_EDGES = ".,;:!?।\"'“”«»()[]{}*¿¡-…"


@lru_cache(1 << 16)
def _core(token: str) -> str:
    if token.isalpha():
        return token.lower()
    return _DIGITS.sub("0", token.lower().strip(_EDGES))


@lru_cache(1 << 16)
def _stops(token: str) -> tuple[bool, bool]:
    """Whether a token that isn't a word ends what stands before it, and whether it does so next to an entity alone."""
    return len(token) > 2 and _ENDS.search(token) is not None, token[-1] in ":>]-"


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """Two words before and one after, lower case; <s> and </s> where a sentence or line begins or ends."""
    before = text[max(0, start - BEFORE) : start]
    left: list[str] = []
    for t in before[before.rfind("\n") + 1 :].split()[::-1]:
        if not t.isalpha():
            ends, near = _stops(t)
            if ends or (near and len(left) < 2):
                break
            t = _core(t)
            if not t:
                continue
        left.append(t)
        if len(left) == 2:
            break
    after = text[end : end + AFTER].partition("\n")[0].lstrip()
    right = "</s>"
    if after and after[0] not in ".!?।":
        while after:
            t, _, after = after.partition(" ")
            for t in t.split():
                if c := _core(t):
                    right, after = c, ""
                    break
    return (f"{left[1]} {left[0]}" if len(left) > 1 else left[0] if left else "<s>").lower(), right


_TITLE = r"[A-ZÀ-Þ][a-zà-ÿ]+"
NAMED = re.compile(rf"({_TITLE})((?:\s+[A-Z]\.)?)((?:\s+{_TITLE})?)(?![\w@])")
_ADDRESS_PART = re.compile(r"[A-ZÀ-Þ][^\W\d_]*\.?(?:[A-Z][a-z]+\.)?|(?:\w*[./-])*\d+\w*(?:[/-]\d+)*|[-–]|No\.")


def around(text: str, at: int) -> tuple[int, int]:
    """The capitalised and numbered words around the number that ends at `at`."""
    a = text.rfind("\n", 0, at) + 1
    line = text[max(a, at - 80) : at]
    start = len(line)
    for m in reversed(list(TOKEN.finditer(line))[-4:]):
        if not _ADDRESS_PART.fullmatch(m.group()) or (m.group().endswith(".") and len(m.group()) > 6):
            break
        start = m.start()
    end = at
    for m in list(TOKEN.finditer(text[at : at + 120].split("\n", 1)[0]))[:MOST_WORDS]:
        t = m.group()
        if end == at and t[0] == ",":
            continue
        core = t.rstrip(".,;!?।\"'”")
        if not _ADDRESS_PART.fullmatch(core):
            break
        end = at + m.start() + len(core)
        if t[-1] in ".!?।;" and core.lower() != "no":
            break
    return at - len(line) + start, end


def form_of(address: str, keywords: frozenset[str] = frozenset()) -> str:
    """An address with its numbers and its words masked, but for keywords."""
    return re.sub(r"[^\W_]+", lambda m: w if (w := m.group().lower()) in keywords else re.sub(r"[^\W\d_]+", "W", re.sub(r"\d+", "0", w)), _SPACE.sub(" ", address.strip()))


@lru_cache(1 << 16)
def _name_words(name: str) -> tuple[str, str, bool, bool]:
    """Of capitalised words: the first, the last, whether a second one stands there that isn't an initial, whether they can
    be a person's."""
    words = name.lower().split()
    return words[0], words[-1], len(words) > 1 and not words[1].endswith("."), words[-1] not in FIRM


def candidates(text: str) -> list[tuple[str, str, str, str, bool]]:
    """(type, context, form, instance, seed) edges of a text for the graph; instances of addresses alone are told."""
    out = []
    low = text.lower()
    if len(low) != len(text):
        text = low = text.translate({0x130: "i"}).lower()
    found = seeds(text, low)
    for kind, a, b in found:
        out.append((kind, context(text, a, b), "mail" if kind == "email" else form_of(low[a:b]), low[a:b] if kind == "street_address" else "", True))
    for kind, form, a, b in spelled(low, _digit_words(low)):
        out.append((kind, context(text, a, b), form, "", False))
    for form, a, b in numbers(text):
        where = context(text, a, b)
        out.append(("phone", where, form, "", form[0] == "+"))
        out.append(("id_number", where, form, "", form in SEED_IDS))
    for m in _ANCHOR.finditer(text):
        a, b = around(text, m.end() - 2)
        if b <= m.end() or any(x < b and a < y for _, x, y in found):
            continue
        where = context(text, a, b)
        out.append(("street_address", where, form_of(low[a:b]), low[a:b], False))
        first = text[a:b].split(None, 1)
        if where[0] == "<s>" and len(first) > 1 and first[0].isalpha():  # the first word may begin the sentence
            a = b - len(first[1])
            out.append(("street_address", context(text, a, b), form_of(low[a:b]), low[a:b], False))
    for m in NAMED.finditer(text):
        a, b = m.span()
        if a and ((c := text[a - 1]).isalnum() or c in "_@."):
            continue
        given, last, two, person = _name_words(m.group())
        if not person or ((after := text[b : b + 14].split(None, 1)) and after[0].lower() in FIRM):
            continue
        where = context(text, a, b)
        out.append(("person_name", where, given, last if m.end(3) > m.start(3) else "", given in SEED_NAMES))
        if two and where[0] == "<s>":  # the first word may begin the sentence
            tail = NAMED.match(text, m.start() + len(m.group(1)) + len(_BLANK.match(text, m.end(1)).group()))
            if tail and tail.group().lower().split()[-1] not in FIRM:
                got = tail.group().lower().split()
                right = context(text, *tail.span())[1]
                if right not in FIRM:
                    out.append(("person_name", (given, right), got[0], got[-1] if tail.group(3) else "", got[0] in SEED_NAMES))
    return out


# ---------------------------------------------------------------- what is learnt


class Model:
    """What the bootstrap has learnt: contexts and forms by type, layouts of addresses, given names and surnames."""

    def __init__(self, contexts: dict[str, dict[str, set[str]]], forms: dict[str, str], layouts: list[str], given: set[str], surnames: set[str]):
        self.contexts, self.forms, self.given, self.surnames = contexts, forms, given, surnames
        self.by_left: dict[str, list[tuple[str, set[str]]]] = {}
        for kind in TYPES[:4]:
            for left, rights in contexts.get(kind, {}).items():
                if left != "<s>":
                    self.by_left.setdefault(left, []).append((kind, rights))
        #: Words that belong to learnt layouts.
        self.parts = frozenset(w for x in layouts for w in re.findall(r"[^\W\d_]+", x) if w.islower() and len(w) > 1)
        #: A long word of each layout: without any of them none holds.
        self.needed = tuple({max((w for w in re.findall(r"[^\W\d_]+", x) if w.islower()), key=len) for x in layouts})
        self.layouts = re.compile("|".join(sorted(map(layout_pattern, layouts), key=lambda x: (-len(x), x)))) if layouts else None
        pairs = contexts.get("person_name", {})
        self.name_lefts = [x for x in pairs if x != "<s>"]
        name = rf"({_L}+(?:\s+{_L}\.?(?=\s))?(?:\s+{_L}+)?)"
        right = sorted({r for rs in pairs.values() for r in rs if r != "</s>"})
        self.name = re.compile(rf"{name}\s*,?\s+(?:{'|'.join(map(re.escape, right))})(?!\w)") if right else None
        self.rest = re.compile(rf"(\s+{_L}\.?)?\s+({_L}+)")
        self._scan = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_scan": None}

    def scan(self):
        """An automaton over the words to look for, built where it is used: given names, digits in words, and of each
        context the longest word, with the words before and after it."""
        if self._scan is None:
            import ahocorasick

            found: dict[str, list[tuple]] = {}
            for w in self.given:
                found.setdefault(w, []).append(("name", "", ""))
            for w in DIGIT_WORDS.split("|"):
                found.setdefault(w, []).append(("digit", "", ""))
            for what, lefts in (("left", self.by_left), ("before", self.name_lefts)):
                for x in lefts:
                    words = x.split()
                    k = max(range(len(words)), key=lambda i: len(words[i]))
                    found.setdefault(words[k], []).append((what, words[0] if k else "", words[1] if len(words) == 2 and not k else "", x))
            self._scan = ahocorasick.Automaton()
            for w, uses in found.items():
                self._scan.add_word(w, (len(w), uses))
            self._scan.make_automaton()
        return self._scan

    def signs(self, low: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]], list[tuple[int, int]], int]:
        """Of a text: (end, phrase) of contexts of other kinds and of names, (start, end) of given names, digit words."""
        lefts, befores, names, digits, size = [], [], [], 0, len(low)
        for last, (n, uses) in self.scan().iter(low):
            a, b = last - n + 1, last + 1
            if (b < size and (low[b].isalnum() or low[b] == "_")) or (a and (low[a - 1].isalnum() or low[a - 1] == "_")):
                continue
            for what, before, after, *phrase in uses:
                if what == "digit":
                    digits += 1
                elif what == "name":
                    if not (a and low[a - 1] in "@.+-") and not (b < size and (low[b] in "@+-" or (low[b] == "." and low[b + 1 : b + 2].isalnum()))):
                        names.append((a, b))
                else:
                    end = b
                    if after:
                        rest = _BLANK.match(low, b).end()
                        if rest == b or not low.startswith(after, rest) or low[rest + len(after) : rest + len(after) + 1].isalnum():
                            continue
                        end = rest + len(after)
                    if before:
                        head = low[max(0, a - len(before) - 12) : a]
                        bare = head.rstrip()
                        if len(bare) == len(head) or not bare.endswith(before) or bare[-len(before) - 1 : -len(before)].isalnum():
                            continue
                    (lefts if what == "left" else befores).append((end, phrase[0]))
        return lefts, befores, names, digits

    def names(self, text: str, low: str, known: list[tuple[int, int]], befores: list[tuple[int, str]]) -> list[tuple[int, int]]:
        out = []
        for start, end in known:
            if r := self.rest.match(low, end):
                if r.group(2) in FIRM:
                    continue
                last = text[r.start(2) : r.end(2)]
                # a surname that is known, or, among words in lower case, one that is written as a name
                if r.group(2) in self.surnames or (last[0].isupper() and not last[1:2].isupper() and text[start].isupper()):
                    end = r.end()
            out.append((start, end))
        for at, left in befores if self.name else ():
            begin = _BLANK.match(low, at).end()
            if begin == at or not (n := self.name.match(low, begin)):
                continue
            words = n.group(1).split()
            right = low[n.end(1) : n.end()].strip(" ,\t\xa0\n")
            if right in self.contexts["person_name"].get(left, ()) and not FIRM.intersection(words) and 1 <= len(words) <= 3 and (words[0] in self.given or text[n.start(1)].isupper()):
                out.append((n.start(1), n.end(1)))
        return _longest(out)

    def between(self, low: str, start: int, kind: str, rights: set[str]) -> tuple[int, int] | None:
        """What stands from `start` to a word that ends a context, if it can be of the kind."""
        end, n = None, 0
        for m in TOKEN.finditer(low, start, start + 200):
            t = m.group()
            if n and (_core(t) in rights):
                break
            if "\n" in low[end or start : m.start()]:
                return None
            end = start if end is None else end
            end = m.end() - (len(t) - len(t.rstrip(".,;:!?।\"'”»*")))
            n += 1
            if "</s>" in rights and _ENDS.search(t) and len(t) > 3 and fits(kind, low[start:end]):
                break
            if n == MOST_WORDS:
                return None
        else:
            if "</s>" not in rights:
                return None
        if end is None or not fits(kind, low[start:end]):
            return None
        if kind == "street_address" and self.parts.isdisjoint(re.findall(r"[^\W\d_]+", low[start:end])):
            return None  # as far as is known, no address
        return start, end

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """All entities of a text as (type, start, end), without overlaps."""
        low = text.lower()
        if len(low) != len(text):
            text = low = text.translate({0x130: "i"}).lower()
        lefts, befores, known, digits = self.signs(low)
        out = [("email", *m.span()) for m in MAIL.finditer(low)] if "@" in low else []
        out += [(kind, a, b) for kind, form, a, b in spelled(low, digits) if self.forms.get(form) == kind]
        out += [(kind, a, b) for form, a, b in numbers(text) if (kind := self.forms.get(form))]
        if self.layouts and _holds(low, self.needed):
            out += [("street_address", *m.span()) for m in self.layouts.finditer(low)]
        if _holds(low, _STREETS):
            out += _addresses(low)
        for at, left in lefts:
            begin = _BETWEEN.match(low, at).end()
            if begin > at:
                for kind, rights in self.by_left[left]:
                    if got := self.between(low, begin, kind, rights):
                        out.append((kind, *got))
                        break
        out = _apart(out)
        out += [("person_name", a, b) for a, b in self.names(text, low, known, befores) if not any(x < b and a < y for _, x, y in out)]
        return out


_BETWEEN = re.compile(r"[\s,:]*")
_NUMBERISH = re.compile(r"[\d ()+\-]+")
_CODE = re.compile(r"[a-z]{0,6}[\d \-]*\d[a-z]?")


def fits(kind: str, value: str) -> bool:
    """Whether a value between the words of a sure context can be of its kind."""
    if kind == "email":
        return SPELLED.fullmatch(value) is not None or MAIL.fullmatch(value) is not None
    if kind == "phone":
        return (_NUMBERISH.fullmatch(value) is not None and 7 <= sum(map(str.isdigit, value)) <= 15) or (value.count(" ") >= 6 and all(_DIGIT_WORD.fullmatch(w) for w in value.split()))
    if kind == "id_number":
        return len(value) <= 24 and _CODE.fullmatch(value) is not None and sum(map(str.isalnum, value)) >= 8
    words = re.findall(rf"{_L}+", value)
    return any(map(str.isdigit, value)) and len(words) >= 2 and not re.search(r"[!?।]|[^\W\d_]{4,}\.", value)


def _longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    kept: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b))
    return kept


def _apart(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The longest of each entities that overlap."""
    kept: list[tuple[str, int, int]] = []
    for x in sorted(set(found), key=lambda s: (s[1] - s[2], s)):
        if not any(x[1] < b and a < x[2] for _, a, b in kept):
            kept.append(x)
    return kept


def layout_pattern(form: str) -> str:
    """A pattern for the addresses of one form."""
    out = []
    for part in re.findall(r"[^\W_]+|\s+|.", form):
        if part.isspace():
            out.append(r"\s+")
        elif part == ",":
            out.append(r"\s?,?")
        elif part in ("-", "–"):
            out.append(r"[-–]")
        elif part[0].isalnum() and (part.isalpha() and part.islower()):
            out.append(re.escape(part))
        elif part[0].isalnum():
            out.append(part.replace("0", r"\d+").replace("W", f"{_L}+"))
        else:
            out.append(re.escape(part) + "?")
    return rf"(?<!\w){''.join(out)}(?!\w)"


def _edge_batches(batches):
    for batch in batches:
        texts = [spoken_text(t) if s else t for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        counts = Counter(e for t in texts for e in candidates(t))
        rows = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([" | ".join(r[1]) for r in rows], pa.string())]
            + [pa.array([r[i] for r in rows], t) for i, t in ((2, pa.string()), (3, pa.string()), (4, pa.bool_()))]
            + [pa.array([counts[r] for r in rows], pa.int64())],
            ["kind", "pattern", "form", "instance", "seed", "n"],
        )


def _layout_batches(keywords: frozenset[str]):
    def run(batches):
        for batch in batches:
            forms = [form_of(x, keywords) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), batch.column(1)], ["layout", "n"])

    return run


def learn(texts: DataFrame) -> Model:
    """Score the graph of contexts and forms of all texts (text, transcript) in rounds and keep what is sure.

    What is collected is bounded: contexts, forms and layouts, given names and surnames hold a least share of their kind.
    """
    raw = texts.mapInArrow(_edge_batches, "kind string, pattern string, form string, instance string, seed boolean, n bigint")
    whole = cut(raw.groupBy("kind", "pattern", "form", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")), "edges")
    narrow = whole.groupBy("kind", "pattern", "form").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))
    # a context that is rarer than any that can become sure takes no part in the rounds
    size = narrow.groupBy("kind").agg(F.sum(F.when(F.col("seed"), F.col("n"))).alias("of_kind"))
    support = narrow.groupBy("kind", "pattern").agg(F.sum("n").alias("support")).join(F.broadcast(size), "kind").where((F.col("support") >= SUPPORT) & (F.col("support") >= SHARE * F.col("of_kind"))).select("kind", "pattern", "support")
    edges = cut(narrow.join(support, ["kind", "pattern"], "left"), "graph")
    score = edges.groupBy("kind", "form").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for i in range(ROUNDS):
        weighed = edges.where("support IS NOT NULL").join(score.select("kind", "form", "score"), ["kind", "form"])
        patterns = weighed.groupBy("kind", "pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 1)).alias("sure"))
        floor = FIRST_SURE if i == 0 else SURE
        # a form is as sure as the share of its places in sure contexts; half-sure ones would lift each other
        told = edges.join(patterns, ["kind", "pattern"], "left").withColumn("sure", F.when(F.col("sure") >= floor, 1.0).otherwise(0.0))
        score = cut(told.groupBy("kind", "form").agg(F.greatest(F.max(F.col("seed").cast("double")), F.sum(F.col("n") * F.col("sure")) / F.sum("n")).alias("score"), F.sum("n").alias("n")), "scores")
        patterns = cut(patterns, "patterns") if i == ROUNDS - 1 else patterns
    contexts: dict[str, dict[str, set[str]]] = {}
    for r in patterns.where(F.col("sure") >= SURE).collect():
        left, right = r.pattern.split(" | ")
        contexts.setdefault(r.kind, {}).setdefault(left, set()).add(right)
    sure = score.where((F.col("score") >= SURE_FORM) & (F.col("n") >= SUPPORT))
    forms: dict[str, tuple[float, str]] = {}
    held = score.where(F.col("kind").isin("email", "phone", "id_number")).groupBy("kind").agg(F.sum(F.col("n") * F.col("score")).alias("all"))
    for r in sure.join(F.broadcast(held), "kind").where(F.col("n") >= SHARE * F.col("all")).collect():
        forms[r.form] = max(forms.get(r.form, (0.0, "")), (r.score, r.kind))
    layouts = _layouts(whole.where("kind = 'street_address'").join(sure.select("kind", "form"), ["kind", "form"]))
    places = narrow.where("kind = 'person_name'").agg(F.sum("n")).first()[0] or 0
    names = sure.where("kind = 'person_name'").where(F.col("n") >= NAME_SHARE * places).select("form")
    given = {r.form for r in names.collect() if r.form.isalpha()} | set(SEED_NAMES)
    people = whole.where("kind = 'person_name' AND instance <> ''").join(names, "form").groupBy("instance").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, NAME_SHARE * places))
    surnames = {r.instance for r in people.collect()} - FIRM
    surnames -= {w for rights in contexts.get("person_name", {}).values() for w in rights}
    return Model(contexts, {f: k for f, (_, k) in forms.items()}, layouts, given, surnames)


def _layouts(addresses: DataFrame) -> list[str]:
    """The layouts of sure addresses (instance, n): their words that recur stand as they are, others are masked."""
    known = cut(addresses.groupBy("instance").agg(F.sum("n").alias("n")), "addresses")
    total = known.agg(F.sum("n")).first()[0] or 0
    words = known.select(F.explode(F.array_distinct(F.split(F.regexp_replace("instance", r"[^\p{L}]+", " "), " "))).alias("w"), "n").where("length(w) > 1").groupBy("w").agg(F.sum("n").alias("n"))
    keywords = frozenset(r.w for r in words.where(F.col("n") >= max(KEYWORD_SHARE * total, SUPPORT)).collect())
    got = known.mapInArrow(_layout_batches(keywords), "layout string, n bigint").groupBy("layout").agg(F.sum("n").alias("n"))
    # a layout that names no part of an address, or nothing but numbers, would hold everywhere
    return [r.layout for r in got.where(F.col("n") >= max(LAYOUT_SHARE * total, SUPPORT)).collect() if keywords.intersection(re.findall(r"[^\W\d_]+", r.layout)) and "W" in r.layout and "0" in r.layout]


# ---------------------------------------------------------------- transcripts

#: Names of voices and sounds, as far as a text must be read past them. Fixed values.
NAME = r"(?:call?l?er|caler|scamm?er|agent|fraudster|impostor|rec[ei]*ver|victim|customer|callee|target|narrator|host|anchor|presenter|voice-?over|commentator|moderator|(?:speaker|person|spk|s|voice)[ _-]?0*\d{1,2})"
SOUNDS = r"silence|laugh|laughs|laughing|laughter|sigh|sighs|cough|coughs|coughing|music|applause|crosstalk|inaudible|unclear|pause|noise|background|typing|phone ringing|ringing|ring|line drops|beep|static|tune|crying|cries|breath|breathing|clears throat|indistinct|overlap|dial tone|sounds?".replace(" ", r"\s+")
_PREFIX = re.compile(
    rf"^[\s>|*•-]*(?:(?:{CLOCK})\s*-->\s*(?:{CLOCK})|[\[(]?\s*(?P<at>{CLOCK}|\d+(?:\.\d+)?(?=s[\])]))s?\s*[\])]?)?[\s>|*•-]*"
    rf"(?:(?:[\[(<*]+\s*(?:{NAME})\s*[:\])>*]+|(?:{NAME})\s*(?:[\[(]\s*(?P<at2>{CLOCK})\s*[\])])?\s*(?:\s-\s|:|>))\s*[:-]?)?\s*",
    re.I,
)
_NOISY = re.compile(r"[\[({<*♪♫]|(?<!\S)(?:[ue]|h|mm)[hmr]", re.I)
_NOISE = re.compile(
    rf"\(\(\s*(?:{SOUNDS})\b[^()\n]*\)\)|[\[({{<*]\s*(?:{SOUNDS})\b[^\])}}>*\n]{{0,40}}[\])}}>*]|[♪♫][^♪♫\n]*[♪♫]"
    r"|(?<!\S)(?:u+h*m+|u+h+m*|e+r+m*|h+m+|m{2,})(?:\.{1,3}|…|,|-)*(?=\s|$)(?:\s+-(?=\s|$))?",
    re.I,
)



class Spoken:
    """The words of a transcript in order of time, and where each stands in it."""

    def __init__(self, words: list[tuple[str, int]]):
        self.text = " ".join(w for w, _ in words)
        self.starts, at = [], 0
        self.words = words
        for w, _ in words:
            self.starts.append(at)
            at += len(w) + 1

    def spans(self, a: int, b: int) -> list[tuple[int, int]]:
        """The places in the transcript of what stands from a to b here."""
        out = []
        for k in range(bisect_right(self.starts, a) - 1, len(self.words)):
            w, at = self.words[k]
            x, y = max(a - self.starts[k], 0), min(b - self.starts[k], len(w))
            if self.starts[k] >= b:
                break
            if x < y:
                out.append((at + x, at + y))
        return out


def _spoken_lines(text: str) -> list[tuple[float, int, str, int]]:
    """(when, line, its words, where they begin in the text) in order of time, without times, labels, sound notes and
    hesitations, which give way to blanks; a voice's words that run over several lines stand together."""
    cues: list[tuple[float, int, str, int]] = []
    when, last = -1.0, None
    lines = text.splitlines(keepends=True)
    at = 0
    for i, raw in enumerate(lines):
        begin, at = at, at + len(raw)
        line = raw.strip()
        if not line or line == last or (line.isdigit() and i + 1 < len(lines) and "-->" in lines[i + 1]):
            continue
        last = line
        begin += raw.index(line)
        m = _PREFIX.match(line)
        stamp = line if "-->" in line[:40] else m.group("at") or m.group("at2")
        if stamp and (t := seconds(stamp)) is not None:
            when = t
        rest = line[m.end() :]
        if _NOISY.search(rest):
            rest = _NOISE.sub(_blanks, rest)
        cues.append((when, i, rest, begin + m.end()))
    cues.sort(key=lambda c: c[:2])
    return cues


def _blanks(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def spoken_text(text: str) -> str:
    return " ".join(" ".join(c[2] for c in _spoken_lines(text)).split())


def spoken(text: str) -> Spoken:
    return Spoken([(m.group(), at + m.start()) for _, _, rest, at in _spoken_lines(text) for m in TOKEN.finditer(rest)])


# ---------------------------------------------------------------- operators


def _union(parts: list[tuple[str, DataFrame, str, str, bool]]) -> DataFrame:
    out = None
    for name, df, key, text, transcript in parts:
        rows = df.select(F.lit(name).alias("src_table"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"), F.lit(transcript).alias("transcript"))
        rows = rows.where("row_key IS NOT NULL AND text IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def _learnt(parts: list[tuple[str, DataFrame, str, str, bool]]):
    """The model of all texts of all parts, sent to all executors; its size is bounded as `learn` tells."""
    return parts[0][1].sparkSession.sparkContext.broadcast(learn(_union(parts).select("text", "transcript")))


def entities(parts: list[tuple[str, DataFrame, str, str, bool]]) -> DataFrame:
    """(src_table, row_key, pii_type, pii_value), one row per different value of a record.

    parts: (name of the table, rows, key column, text column, whether texts are noisy transcripts). Null keys and null
    and blank texts have no rows; of a key that stands several times all texts count.
    """
    model = _learnt(parts)

    def run(batches):
        for batch in batches:
            out: list[tuple[str, str, str, str]] = []
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for table, key, text, transcript in zip(*cols):
                t = spoken_text(text) if transcript else text
                seen = {(kind, plain(t[a:b])) for kind, a, b in model.value.find(t)}
                out += [(table, key, kind, value) for kind, value in sorted(seen)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], ["src_table", "row_key", "pii_type", "pii_value"])

    return _union(parts).mapInArrow(run, "src_table string, row_key string, pii_type string, pii_value string").distinct()


def is_seed(kind: str, value: str) -> bool:
    """Whether an entity has a form that started the bootstrap; all others were discovered."""
    low = value.lower()
    if kind == "person_name":
        return low.split()[0].strip(".,") in SEED_NAMES
    if kind == "phone":
        return low[0] == "+"
    if kind == "id_number":
        return value.translate(_FORM) in SEED_IDS
    return (MAIL if kind == "email" else SEED_ADDRESS).fullmatch(low) is not None


def routes(parts: list[tuple[str, DataFrame, str, str, bool]]) -> DataFrame:
    """(src_table, pii_type, route, n): how many entities have a seed's form, and how many were discovered."""
    model = _learnt(parts)

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for table, text, transcript in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                t = spoken_text(text) if transcript else text
                counts.update((table, kind, "seed" if is_seed(kind, t[a:b]) else "discovered") for kind, a, b in model.value.find(t))
            rows = list(counts)
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.string()) for i in range(3)), pa.array([counts[r] for r in rows], pa.int64())], ["src_table", "pii_type", "route", "n"])

    found = _union(parts).mapInArrow(run, "src_table string, pii_type string, route string, n bigint")
    return found.groupBy("src_table", "pii_type", "route").agg(F.sum("n").alias("n"))


def redact(text: str, model: Model, transcript: bool = False) -> str:
    """The text with each entity replaced by its type in brackets; everything else stays as it stands. In a transcript
    an entity that runs over several lines or past a sound gives its place to one placeholder where it begins."""
    view = spoken(text) if transcript else None
    holes: list[tuple[int, int, str]] = []
    for kind, a, b in model.find(view.text if view else text):
        for i, (x, y) in enumerate(view.spans(a, b) if view else [(a, b)]):
            holes.append((x, y, "" if i else f"[{kind.upper()}]"))
    out, at = [], 0
    for a, b, mark in sorted(holes):
        if a >= at:
            out += [text[at:a] if mark or text[at:a].strip() else "", mark]
            at = b
    return "".join(out) + text[at:]


def redacted(parts: list[tuple[str, DataFrame, str, str, bool]]) -> DataFrame:
    """(src_table, row_key, text): the texts with typed placeholders, otherwise unchanged.

    Null keys and texts have no rows; blank texts stay as they are.
    """
    model = _learnt(parts)

    def run(batches):
        for batch in batches:
            texts = [redact(t, model.value, s) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["src_table", "row_key", "text"])

    return _union(parts).mapInArrow(run, "src_table string, row_key string, text string")
