"""Problem 8: personal items in free text, by a skip-chain conditional random field.

Per document: wide candidate patterns (an automaton of name parts and street words, and patterns of numbers and addresses)
mark where an item could be; the tokens of and around the candidates are the nodes of a conditional random field. Neighbours
in a window are linked as a chain; capitalised words and numbers that read the same anywhere in the document are linked by skip
edges, and loopy message passing lets a clear place decide an unclear one. The field labels every token. A node does not know
whether a candidate keeps to a format, only its kind, the outline of its digits, words, shapes, endings and context.

An item is where the field's labels are: a candidate in a format is dropped where the field takes it for other text, and a run of
labels around a candidate in no format becomes an item with the run's borders if it is complete (a full name, seven digits).
Where a run covers a candidate in a format, the format's exact borders stand.

Node and chain weights are trained by likelihood on a bounded sample of documents, labelled by the formats, with a third of the
name parts and of the outlines hidden from the features; the skip weight is fitted piecewise, from how often linked tokens
agree. Documents are never shuffled, cut or sampled for the result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents and windows the model is trained on at most, of which every HELD-th window is held out; training rounds.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS, HELD, ROUNDS = 8_000, 4_000, 5, 15
#: Listed and combined name parts the gazetteer may have (it is broadcast); rounds of message passing; size of the feature table.
MAX_PARTS, MAX_COMBINED, SWEEPS, WIDTH = 200_000, 2_000_000, 3, 1 << 17
KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("other", *KINDS)
NUMBERS = ("phone", "id_number")
CONTEXT = 3
#: The form of candidates whose format is held back, to see whether the field finds them without it.
HELD_BACK = "loose, held back"
#: A candidate in a format is dropped where the field, over its tokens, is so sure of other text.
SURE = 0.9

#: Chosen by the author: words for streets, in front of a number's street name or behind it, and small words inside names.
STREETS = ("street", "st.", "st", "lane", "ln.", "avenue", "ave.", "ave", "road", "rd.", "rd", "close", "crescent", "drive", "square", "terrace", "court", "grove", "gardens", "mews", "boulevard", "blvd.", "blvd", "parade", "walk")
STREET_ENDS = ("straße", "strasse", "str.", "str", "allee", "gasse", "weg", "platz", "ufer", "damm", "ring", "steig")
STREET_STARTS = ("rue", "impasse", "bd", "bd.", "bld", "boulevard", "chemin", "place", "allée", "quai", "route", "cours", "sentier", "avenue", "av.")
CALLES = ("c/", "c.", "calle", "avenida", "avda.", "avda", "av.", "plaza", "pza.", "paseo", "camino", "ronda", "travesía", "carretera")
#: Chosen by the author: small words that are no part of a street's name in front of it, or of one behind its kind.
NO_STREET = ("at", "in", "to", "the", "of", "on", "near", "from", "by", "and", "ask", "lives", "live", "resident", "is", "was", "for", "a", "an", "with", "had", "has", "were", "der", "die", "das", "bei", "im", "zu", "since", "until", "or", "its", "which", "that", "moved", "office", "years", "it", "as", "between", "miles", "km", "acres")
NO_CALLE = ("desde", "depuis", "avait", "avaient", "tenía", "fut", "fue", "est", "es", "en", "que", "con", "dit", "dite", "llamado", "llamada", "hacia", "vers", "et", "y", "compte", "longe", "domine", "abrite")
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "du", "le", "la", "ter", "zu", "dos", "af", "av")

_NUM = r"(?:(?:no|nr|n\.?[º°o]|núm|num)\.?[ \u00a0]?)?(?<![\w.,-])\d{1,4}[ ]?(?:bis|ter|[a-z](?![\w]))?(?:[-–/]\d{1,4}[a-z]?)?(?![\d])"
#: Wide patterns of numbers: what may be a telephone or identity number, each with the formats it is held against.
NUMBER = re.compile(
    r"(?:\+[ ]?|\(\+?)?(?<![\w])\d(?:[ \u00a0().\-–/]{0,3}\d){6,17}(?:[ ]?[-.]?[ ]?[a-z]\b)?(?![\w])|\b[a-z]{2}[ ]?(?:\d\d[ ]?){3}[a-d]\b|\b[a-z]\d\d[ ]?[a-z]\d\d[ ]?\d{3,4}\b|\b[a-z][ ]?\d{7,8}[ ]?[a-z]?\b", re.I
)
PHONES = {
    "us": r"(?:\+1|001|1)?[ .\-–]?(?:\(\d{3}\)[ .\-–]?|\d{3}[ .\-–])\d{3}[ .\-–]\d{4}",
    "nanp": r"(?:(?:\+1|001)[ .\-–]?\(?[2-9]\d{2}\)?|\([2-9]\d{2}\)|(?<!\d)[2-9]\d{2})[ .\-–]?[2-9]\d{2}[ .\-–]?\d{4}",
    "spaced": r"(?:\d ){9,11}\d",
    "uk": r"(?:(?:\+44|0044)[ ]?(?:\(0\)[ ]?)?|\(?0)(?:7\d{3}|20|1\d{2,3}|2\d)\)?[ ]?\d{3,4}[ ]?\d{3,4}(?:[ ]?\d{2,3})?",
    "de": r"(?:(?:\+49|0049)[ ]?(?:\(0\)[ ]?)?\d{2,4}|\(0\d{2,4}\)|0\d{2,4})[ /\-–]{0,2}\d{3,6}(?:[ \-–]?\d{2,5})?",
    "fr": r"(?:(?:\+33|0033)[ ]?(?:\(0\)[ ]?)?[1-9]|0[1-9])(?:[ .\-–]?\d\d){4}",
    "es": r"(?:\(?(?:\+34|0034)\)?[ ]?)[5-9]\d{2}[ ]?\d{3}[ ]?\d{3}|(?<!\d)[6-9]\d{2}[ ]\d{3}[ ]\d{3}",
    "plus": r"\(?\+\d{1,3}\)?(?:[ .\-–/]?\(?\d{1,4}\)?){2,6}",
}
IDS = {
    "social": r"\d{3}[ \-–]\d{2}[ \-–]\d{4}",
    "nine": r"\d{9}",
    "insurance": r"[a-z]{2}[ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?[a-d]",
    "dni": r"\d{2}\.?\d{3}\.?\d{3}[ \-]?[a-z]|[xyz][ \-]?\d{7}[ \-]?[a-z]",
    "secu": r"[12378][ ]?\d\d[ ]?\d\d[ ]?\d[\dab][ ]?\d{3}[ ]?\d{3}(?:[ /]?\d\d)?",
    "card": r"[a-z]\d\d[ ]?[a-z]\d\d[ ]?\d{3,4}",
}
#: Every number worth a look has six digits in a row but for separators and single letters; this finds them fast.
DIGIT, LONG_NUMBER = re.compile(r"\d"), re.compile(r"\d(?:[ \u00a0().\-–/]{0,3}[A-Za-z]?\d){5}")
PHONE_RE = {k: re.compile(p, re.I) for k, p in PHONES.items()}
ID_RE = {k: re.compile(p, re.I) for k, p in IDS.items()}
_DOT = r"(?:\.|[ ]?[(\[{][ ]?dot[ ]?[)\]}][ ]?|[ ]+dot[ ]+)"
EMAIL_AT = re.compile(r"[@＠]|&#0*64;|&commat;|[(\[{][ ]?at[ ]?[)\]}]|(?<=[\w])[ ]+at[ ]+(?=[\w\-]+[ ]+dot[ ])", re.I)
EMAIL_RIGHT = re.compile(r"[ ]?(?:[\w\-]+" + _DOT + r")+[^\W\d_]{2,}(?![\w])", re.I)
_alternatives = lambda words: "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"
_WORD = rf"(?!(?:{'|'.join(NO_STREET)})(?![\w]))(?:[^\W\d_]{{1,3}}\.|[^\W\d_][\w'’\-]*)[ \u00a0]"
_STREET = _alternatives(STREETS) + r"(?![\w])"
_OF = r"(?:de l[ao]s?[ \u00a0]|de l['’]|del?[ \u00a0]|des[ \u00a0]|du[ \u00a0]|d['’]|l[ao]s?[ \u00a0])?"
_NOT = rf"(?!(?:{'|'.join(NO_CALLE)})(?![\w]))"
_SHORT = _NUM.replace(r"\d{1,4}[ ]?(?:bis", r"\d{1,3}(?!\d)[ ]?(?:bis")
#: Address forms: number before or after an English street, German, and French or Spanish ones.
ADDRESSES = {
    "before": re.compile(rf"{_NUM},?[ \u00a0](?:{_WORD}){{1,3}}{_STREET}", re.I),
    "after": re.compile(rf"(?<![\w])(?:{_WORD}){{1,3}}{_STREET},?[ \u00a0]{_NUM}(?![\w])", re.I),
    "german": re.compile(rf"(?<![\w\-])[^\W\d_][\w\-]*[ \u00a0]?{_alternatives(STREET_ENDS)},?[ \u00a0]{_SHORT}(?![\w])", re.I),
    "french": re.compile(rf"{_SHORT},?[ \u00a0]{_alternatives(STREET_STARTS)}[ \u00a0]{_OF}{_NOT}[^\W\d_][\w'’\-]*(?-i:[ \u00a0][A-ZÀ-Þ][\w'’\-]*)?", re.I),
    "behind": re.compile(rf"(?<![\w]){_alternatives(STREET_STARTS)}[ \u00a0]{_OF}{_NOT}[^\W\d_][\w'’\-]*,[ \u00a0]{_SHORT}(?![\w])", re.I),
    "spanish": re.compile(rf"(?<![\w]){_alternatives(CALLES)}[ \u00a0]?{_OF}{_NOT}[^\W\d_][\w'’\-]*(?:[ \u00a0]{_OF}{_NOT}[^\W\d_][\w'’\-]*)?,?[ \u00a0]{_SHORT}(?![\w])", re.I),
}
TOKEN = re.compile(r"[^\W\d_]+|\d+|_|[^\w\s]")


def inventory(parts: list[tuple[str, str]]) -> dict[str, str]:
    """Lower-case name parts and their kind; the list is completed by the stems and endings that it shows to be productive.

    A part is split where both sides occur most often with other partners; stems and endings that occur in at least four parts
    of a kind are combined. `given`/`family` are listed parts, `given+`/`family+` combined ones.
    """
    out: dict[str, str] = {}
    for kind in ("given", "family"):
        listed = {p.strip().lower() for p, k in parts if p and k == kind and len(p.strip()) > 1}
        stems, ends = defaultdict(set), defaultdict(set)
        splits = {p: [(p[:i], p[i:]) for i in range(2, len(p) - 1)] for p in listed}
        for p, s in splits.items():
            for a, b in s:
                stems[a].add(p)
                ends[b].add(p)
        good = {max(s, key=lambda x: min(len(stems[x[0]]), len(ends[x[1]]))) for s in splits.values() if s}
        a, b = Counter(x for x, _ in good), Counter(y for _, y in good)
        for s in [x for x, n in a.items() if n >= 4]:
            for e in [y for y, n in b.items() if n >= 4]:
                out.setdefault(s + e, kind + "+")
        if len(out) > MAX_COMBINED:
            raise ValueError(f"name parts combine to more than {MAX_COMBINED} entries")
        for p in listed:
            out[p] = kind
    return out


def lowered(text: str) -> str:
    """Lower case, character by character, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """Candidates of a text, by one automaton over name parts and anchors and one pattern of numbers; made once per task."""

    def __init__(self, names: dict[str, str], hold: tuple[str, ...] = ()):
        self.names, self.hold = names, hold
        self.automaton = ahocorasick.Automaton()
        for word, kind in names.items():
            self.automaton.add_word(word, ("n", len(word), kind))
        for word in {*STREETS, *STREET_ENDS, *STREET_STARTS, *CALLES} - names.keys():
            self.automaton.add_word(word, ("s", len(word), "end" if word in STREET_ENDS else ""))
        for word in ("@", "＠", "&#64;", "&commat;", "at)", "at]", "at}", " dot "):
            self.automaton.add_word(word, ("e", len(word), ""))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """Candidates (start, end, kind, form); of overlapping ones the earlier kind of KINDS and then the longer stays."""
        low = lowered(text)
        names, streets, mail = [], [], False
        for end, (what, n, kind) in self.automaton.iter(low):
            a, b = end - n + 1, end + 1
            if what == "e":
                mail = True
            elif what == "n":
                if not (a and low[a - 1].isalpha()) and not (b < len(low) and low[b].isalpha()):
                    names.append((a, b, kind))
            elif (kind or not (a and low[a - 1].isalpha())) and not (low[a:b].isalpha() and b < len(low) and low[b].isalpha()):
                streets.append((a, b))
        found: list[tuple[int, int, str, str]] = []
        if mail:
            found += self.emails(text)
        found += self.numbers(text)
        found += self.addresses(text, streets)
        found += self.full_names(text, names)
        rank = {k: i for i, k in enumerate(KINDS)}
        kept: list[tuple[int, int, str, str]] = []
        taken = []
        for s in sorted(found, key=lambda s: (s[3].startswith("loose"), rank[s[2]], s[0] - s[1], s[0])):
            if all(s[1] <= a or s[0] >= b for a, b in taken if a < s[1]):
                kept.append(s)
                taken.append(s[:2])
        return sorted((a, b, k, HELD_BACK if f.rstrip("?") in self.hold else f) for a, b, k, f in kept)

    @staticmethod
    def emails(text: str) -> list[tuple[int, int, str, str]]:
        out = []
        for m in EMAIL_AT.finditer(text):
            right = EMAIL_RIGHT.match(text, m.end())
            a = m.start() - (text[m.start() - 1 : m.start()] == " ")
            left = a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_")
            while left and a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.+-%"):
                a -= 1
            if right and left:
                while text[a] in ".+-%":
                    a += 1
                out.append((a, right.end(), "email", "at" if m[0] in "@＠" else "written"))
            elif left or m[0] in "@＠":
                out.append((m.start(), m.end(), "email", "loose"))
        return out

    @staticmethod
    def numbers(text: str) -> list[tuple[int, int, str, str]]:
        out, done = [], 0
        while near := LONG_NUMBER.search(text, done):
            lo, hi, m = max(done, near.start() - 8), near.end(), None
            while hi < len(text) and (m is None or m.end() == hi):  # until the number ends before the part looked at does
                hi = min(len(text), hi + 32)
                if (m := NUMBER.search(text, lo, hi)) is None:
                    break
            m = m or NUMBER.search(text, lo, hi)
            if m is None or m.start() >= near.end():
                done = near.end()
                continue
            a = m.start()
            s = m[0].rstrip(" .-–/(").replace("\u00a0", " ")
            if s[0] == "(" and ")" not in s:
                a, s = a + 1, s[1:]
            kind, form, n = Finder.number("".join(str(int(c)) if c.isdecimal() else c for c in s))
            if kind:
                out.append((a, a + n, kind, form))
            done = max(near.start() + 1, a + n)
        return out

    @staticmethod
    def number(s: str) -> tuple[str, str, int]:
        """Kind, form and length of the number that `s` is or, if it ran on into another number, begins with."""
        ids = [k for k, p in ID_RE.items() if p.fullmatch(s)]
        tel = [k for k, p in PHONE_RE.items() if p.fullmatch(s)]
        if ids and not (tel and s[0] in "+("):
            return "id_number", ids[0] + "?" * bool(tel), len(s)
        digits = sum(c.isdigit() for c in s)
        if tel and digits >= 9:
            return "phone", tel[0], len(s)
        begins = [(t.end(), kind, k) for kind, forms in (("phone", PHONE_RE), ("id_number", ID_RE)) for k, p in forms.items() if (t := p.match(s)) and sum(c.isdigit() for c in t[0]) >= 9 and t.end() < len(s) and not s[t.end()].isalnum()]
        if begins:
            n, kind, k = max(begins)
            return kind, k, n
        return ("phone" if s[0] in "+(0" else "id_number", "loose", len(s)) if digits >= 7 else ("", "", len(s))

    @staticmethod
    def addresses(text: str, streets: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
        out, done = [], -1
        for a, b in streets:
            if a < done:
                continue
            lo, hi = a, b  # the line's next words: more than any form reaches
            for _ in range(7):
                lo = max(0, text.rfind(" ", 0, max(0, lo - 1)) + 1)
                hi = text.find(" ", hi + 1) if hi < len(text) else hi
                hi = len(text) if hi < 0 else hi
            lo = max(lo, text.rfind("\n", lo, a) + 1)
            hi = hi if (end := text.find("\n", b, hi)) < 0 else end
            for form, p in ADDRESSES.items():
                for m in p.finditer(text, lo, hi):
                    if m.start() <= a < m.end():
                        out.append((m.start(), m.end(), "address", form))
        return out

    def full_names(self, text: str, parts: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
        """Full names around the parts found: given (initial) (small words) family, initial family, family given or initial."""
        out, at = [], {a: (b, k.rstrip("+")) for a, b, k in sorted(parts, key=lambda p: p[1] - p[0])}
        starts, used = sorted(at), -1
        for a in starts:
            if a < used:
                continue
            b, kind = at[a]
            got = None
            if kind == "given":
                got = self.after_given(text, b, at)
            if got is None and kind == "family":
                e = self.hyphened(text, b)
                m = re.match(r"(?:'''?|\]\])?,?[ \u00a0]+", text[e:])
                if m:
                    c = e + m.end()
                    if c in at and at[c][1] == "given" and self.after_given(text, at[c][0], at) is None:
                        got = at[c][0]
                        if i := re.match(r"[ ][^\W\d_]\.(?!\w)", text[got:]):
                            got += i.end()
                    elif "," in m[0] and (i := re.match(r"[^\W\d_]\.(?!\w)", text[c:])):
                        got = c + i.end()
                if i := re.search(r"(?<![\w.])([^\W\d_]\.[ ]?){1,2}(?:(?:%s)[ ])*$" % "|".join(PARTICLES), text[max(used, a - 24, 0) : a], re.I):
                    start = a - (len(text[max(used, a - 24, 0) : a]) - i.start())
                    out.append((start, e, "name", "initial"))
                    used = e
                    continue
            if got is not None:
                out.append((a, got, "name", kind))
                used = got
            else:
                out.append((a, b, "name", "loose " + kind))
        return out

    @staticmethod
    def hyphened(text: str, b: int) -> int:
        m = re.match(r"[-‐–][^\W\d_]{3,}", text[b:])
        return b + m.end() if m else b

    def after_given(self, text: str, b: int, at: dict[int, tuple[int, str]]) -> int | None:
        m = re.match(r"(?:[ \u00a0]+[^\W\d_]\.)*(?:[ \u00a0]+(?:%s)(?=[ ]))*[ \u00a0]+" % "|".join(PARTICLES), text[b:], re.I)
        c = b + m.end() if m else -1
        if c in at and at[c][1] == "family":
            return self.hyphened(text, at[c][0])
        return None


def outline(number: str) -> list[str]:
    """Features of a whole number: its digits as 0 and letters as x, its groups, how many digits it has and how it begins."""
    whole = "".join("0" if c.isdecimal() else "x" if c.isalpha() else c for c in number)
    groups = [g for g in re.split(r"[^0x]+", whole) if g]
    return ["k=" + whole, "kg=" + "-".join(map(str, map(len, groups))), f"kn={whole.count('0')}{'x' * whole.count('x')}", "kb=" + re.sub(r"\d", "0", number[:2]) + number[:1]]


def shape(w: str) -> str:
    s = "".join("0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in w[:6])
    return re.sub(r"(.)\1+", r"\1\1", s) + str(min(len(w), 9)) * w[0].isdigit()


class Window:
    """Tokens of and around candidates: their positions, features and the candidate (or -1) that each lies in."""

    __slots__ = ("tokens", "features", "inside", "forms")

    def __init__(self, text: str, lo: int, hi: int, cands: list[tuple[int, tuple[int, int, str, str]]], names: dict[str, str], hide: float = 0.0):
        toks = [m.span() for m in TOKEN.finditer(text, lo, hi)]
        self.tokens = toks
        self.inside = [-1] * len(toks)
        words = [text[a:b] for a, b in toks]
        low = [w.lower() for w in words]
        self.forms = [x if len(x) > 2 and not w.islower() else "" for w, x in zip(words, low)]
        own: list[list[str]] = []
        for t, (w, x) in enumerate(zip(words, low)):
            f = ["w=" + ("0" * min(len(x), 4) if x[0].isdigit() else x), "s=" + shape(w)]
            if x[0].isalpha():
                f += ["p=" + x[:3], "e=" + x[-3:], "e4=" + x[-4:]]
                if (k := names.get(x)) and not (hide and crc32(x.encode()) % 1000 < hide * 1000):
                    f.append("g=" + k)
                if x in PARTICLES:
                    f.append("small")
            own.append(f)
        for k, (a, b, kind, form) in cands:
            for t, (p, q) in enumerate(toks):
                if p >= a and q <= b and self.inside[t] < 0:
                    self.inside[t] = k
                    own[t].append("c=" + kind)
                    if kind in NUMBERS and not (hide and crc32(b"%d" % a) % 3 == 0):
                        own[t] += outline(text[a:b])
        feats = []
        for t in range(len(toks)):
            f = ["b", *own[t]]
            for d in (-2, -1, 1, 2):
                if 0 <= t + d < len(toks):
                    f += [f"{d}{x}" for x in own[t + d] if x[:2] in ("w=", "g=", "s=")]
                else:
                    f.append(f"{d}edge")
            feats.append([crc32(x.encode()) % WIDTH for x in f])
        self.features = feats


def windows(text: str, cands: list[tuple[int, int, str, str]], names: dict[str, str], hide: float = 0.0) -> list[Window]:
    """Windows of CONTEXT words (at most 40 characters) around the candidates; those that meet are one."""
    out: list[tuple[int, int, list]] = []
    for k, c in enumerate(cands):
        left = text[max(0, c[0] - 40) : c[0]]
        cut_at = [m.start() for m in TOKEN.finditer(left)]
        lo = c[0] - len(left) + (cut_at[-CONTEXT] if len(cut_at) >= CONTEXT else 0)
        right = [m.end() for m in TOKEN.finditer(text[c[1] : c[1] + 40])]
        hi = c[1] + (right[min(CONTEXT, len(right)) - 1] if right else 0)
        if out and lo < out[-1][1] and len(out[-1][2]) < 12:
            out[-1] = (out[-1][0], max(hi, out[-1][1]), [*out[-1][2], (k, c)])
        else:
            out.append((lo, hi, [(k, c)]))
    return [Window(text, lo, hi, cs, names, hide) for lo, hi, cs in out]


def node_scores(ws: list[Window], weights: np.ndarray) -> list[np.ndarray]:
    flat = [f for w in ws for f in w.features]
    if not flat:
        return [np.zeros((0, len(LABELS))) for _ in ws]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    ids = np.fromiter((x for f in flat for x in f), np.int64, int(sizes.sum()))
    sums = np.add.reduceat(weights[ids], np.append(0, np.cumsum(sizes)[:-1]), axis=0)
    return np.split(sums, np.cumsum([len(w.features) for w in ws])[:-1])


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, rows))
    x, mask = np.zeros((len(rows), n, len(LABELS))), np.zeros((len(rows), n), bool)
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
        mask[k, : len(r)] = True
    return x, mask


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def chain_marginals(nodes: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log marginals of padded chains by forward and backward messages; also both messages and log Z."""
    n, t, k = nodes.shape
    fwd, bwd = np.zeros((n, t, k)), np.zeros((n, t, k))
    fwd[:, 0] = nodes[:, 0]
    for i in range(1, t):
        step = nodes[:, i] + _lse(fwd[:, i - 1][:, :, None] + trans[None], 1)
        fwd[:, i] = np.where(mask[:, i, None], step, fwd[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = _lse(trans[None] + (nodes[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
        bwd[:, i] = np.where(mask[:, i + 1, None], step, bwd[:, i])
    z = _lse(fwd[:, -1], 1)
    return fwd + bwd - z[:, None, None], fwd, bwd, z


def skip_links(ws: list[Window], docs: list[int]) -> list[tuple[int, int]]:
    """Pairs of token numbers (over all windows) with the same form in one document, each linked to its next occurrence."""
    last: dict[tuple[int, str], int] = {}
    out, at = [], 0
    for w, d in zip(ws, docs):
        for form in w.forms:
            if form:
                if (d, form) in last:
                    out.append((last[d, form], at))
                last[d, form] = at
            at += 1
    return out


def decide(ws: list[Window], docs: list[int], model: tuple[np.ndarray, np.ndarray, float], skip: bool = True) -> list[np.ndarray]:
    """Log marginals of every window's tokens, after SWEEPS rounds of messages along chains and (not without `skip`) skip links."""
    if not ws:
        return []
    weights, trans, agree = model
    rows = node_scores(ws, weights)
    links = np.array(skip_links(ws, docs) if skip else [], np.int64).reshape(-1, 2)
    sizes = [len(r) for r in rows]
    total, k = sum(sizes), len(LABELS)
    to_b, to_a = np.zeros((len(links), k)), np.zeros((len(links), k))
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(sizes)
    for sweep in range(SWEEPS if len(links) else 1):
        add = np.zeros((total, k))
        np.add.at(add, links[:, 1], to_b)
        np.add.at(add, links[:, 0], to_a)
        out = np.zeros((total, k))
        for block in np.array_split(order, max(1, len(order) // 512)):
            x, mask = _padded([rows[i] + add[ends[i] - sizes[i] : ends[i]] for i in block])
            m = chain_marginals(x, mask, trans)[0]
            for j, i in enumerate(block):
                out[ends[i] - sizes[i] : ends[i]] = m[j, : sizes[i]]
        if sweep + 1 < SWEEPS and len(links):
            a, b = out[links[:, 0]] - to_a, out[links[:, 1]] - to_b  # without what came over this link
            to_b, to_a = (np.logaddexp(0, np.log(np.expm1(agree)) + x - _lse(x, 1)[:, None]) for x in (a, b))
    return np.split(out, ends[:-1])


def train(samples: list[tuple[int, list[list[int]], list[int], list[str]]], rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(node weights, chain weights, skip weight) from (document, features, labels, forms) of windows.

    Node and chain weights maximise the chains' conditional likelihood by AdaGrad; the skip weight is the log of how much
    more often than by chance linked tokens have one label (piecewise training). No samples give weights of zero.
    """
    k = len(LABELS)
    weights, trans = np.zeros((WIDTH, k)), np.zeros((k, k))
    gw, gt = np.full((WIDTH, k), 1e-3), np.full((k, k), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(rounds if samples else 0):
        for block in np.array_split(rng.permutation(len(samples)), max(1, len(samples) // 64)):
            feats = [samples[i][1] for i in block]
            flat = [f for fs in feats for f in fs]
            sizes = np.fromiter(map(len, flat), np.int64, len(flat))
            ids = np.fromiter((x for f in flat for x in f), np.int64, int(sizes.sum()))
            tok = np.repeat(np.arange(len(flat)), sizes)
            score = np.add.reduceat(weights[ids], np.append(0, np.cumsum(sizes)[:-1]), axis=0)
            x, mask = _padded(np.split(score, np.cumsum([len(f) for f in feats])[:-1]))
            m, fwd, bwd, z = chain_marginals(x, mask, trans)
            gold = np.concatenate([samples[i][2] for i in block])
            diff = -np.exp(m)[mask]
            diff[np.arange(len(gold)), gold] += 1
            uniq, inv = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(uniq), k))
            np.add.at(grad, inv, diff[tok])
            gw[uniq] += grad**2
            weights[uniq] += 0.3 * grad / np.sqrt(gw[uniq]) - 1e-4 * weights[uniq]
            gt_now = np.zeros((k, k))
            for i in range(1, x.shape[1]):
                on = mask[:, i]
                if on.any():
                    pair = fwd[on, i - 1][:, :, None] + trans[None] + (x[on, i] + bwd[on, i])[:, None, :] - z[on][:, None, None]
                    gt_now -= np.exp(pair).sum(0)
            for i in block:
                y = np.array(samples[i][2])
                np.add.at(gt_now, (y[:-1], y[1:]), 1)
            gt += gt_now**2
            trans += 0.3 * gt_now / np.sqrt(gt)
    last: dict[tuple[int, str], int] = {}
    same, seen, share = 0, 0, np.zeros(k)
    for doc, _, labels, forms in samples:
        for y, form in zip(labels, forms):
            if form:
                share[y] += 1
                if (doc, form) in last:
                    seen += 1
                    same += last[doc, form] == y
                last[doc, form] = y
    chance = float(((share / max(1, share.sum())) ** 2).sum()) or 1.0
    agree = float(np.log(np.clip((same + 1) / (seen + 2) / chance, 1.2, 6.0)))
    return weights, trans, agree


#: Chosen by the author: words before a number that make it a catalogue's, not a person's, in training.
CATALOGUE = re.compile(r"(?:\bisbn|\bissn|\bcatalogue|\boclc|\bdoi|\bvol\.?|\bpp?\.|\bid=|\brevision|\brelease)[ :#]*[\w.\-, ]{0,8}$", re.I)


def strict(text: str, c: tuple[int, int, str, str]) -> int | None:
    """The label that a candidate's format gives in training: its kind, or 0 for one in no format or in a catalogue's context.

    None, and no part in training, for a candidate of a format that is held back.
    """
    if c[3] == HELD_BACK:
        return None
    return 0 if c[3].startswith("loose") or CATALOGUE.search(text[max(0, c[0] - 30) : c[0]]) else LABELS.index(c[2])


def _gazetteer(names: DataFrame) -> dict[str, str]:
    rows = names.where("name_part IS NOT NULL").select("name_part", "part_kind").distinct().orderBy("part_kind", "name_part").limit(MAX_PARTS + 1).collect()
    if len(rows) > MAX_PARTS:
        raise ValueError(f"the list of name parts has more than {MAX_PARTS} entries")
    return inventory([(r[0], r[1]) for r in rows])


def training_windows(documents: DataFrame, names: dict[str, str], hold: tuple[str, ...] = ()) -> list[tuple[int, list[list[int]], list[int], list[str]]]:
    """Labelled windows of at most SAMPLE_DOCUMENTS documents, at most SAMPLE_WINDOWS, in a fixed pseudorandom order.

    A third of the name parts is hidden from the gazetteer features, so that endings and contexts have to be learned.
    """
    total = documents.count()
    draw = documents.select("doc_id", "text").where("text IS NOT NULL")
    if total > SAMPLE_DOCUMENTS:
        draw = draw.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.lit(int(1e6 * SAMPLE_DOCUMENTS / total)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(names, hold)
        for df in batches:
            out = []
            for doc, text in zip(df["doc_id"], df["text"]):
                cands = finder.spans(text)
                for w in windows(text, cands, names, hide=0.33):
                    y = [strict(text, cands[i]) if i >= 0 else 0 for i in w.inside]
                    if None not in y:
                        out.append((doc, [" ".join(map(str, f)) for f in w.features], y, w.forms))
            yield pd.DataFrame(out, columns=["doc_id", "features", "labels", "forms"])

    rows = draw.mapInPandas(run, "doc_id long, features array<string>, labels array<int>, forms array<string>")
    got = rows.orderBy(F.xxhash64("doc_id", "labels", "features")).limit(SAMPLE_WINDOWS).collect()
    return [(r[0], [[int(x) for x in f.split()] for f in r[1]], list(r[2]), list(r[3])) for r in got if r[1]]


def fit(documents: DataFrame, names: dict[str, str], hold: tuple[str, ...] = ()) -> tuple[tuple[np.ndarray, np.ndarray, float], dict[str, float]]:
    """The model and its share of right labels on the held-out windows, in all and of those that are no `other`."""
    samples = training_windows(documents, names, hold)
    held = samples[::HELD]
    model = train([s for k, s in enumerate(samples) if k % HELD])
    right, total, hit, real = 0, 0, 0, 0
    for _, feats, labels, _ in held:
        x = np.array([model[0][f].sum(0) for f in feats])[None]
        guess = chain_marginals(x, np.ones(x.shape[:2], bool), model[1])[0][0].argmax(1)
        for g, y in zip(guess, labels):
            right, total = right + (g == y), total + 1
            hit, real = hit + (g == y and y > 0), real + (y > 0)
    return model, {"accuracy": right / max(1, total), "recall": hit / max(1, real)}


def complete(text: str, kind: str, toks: list[tuple[int, int]]) -> bool:
    """Whether a run of labels is a whole item: a full name in capitals, a number of seven digits, a street with a number."""
    words = [text[a:b] for a, b in toks]
    if kind == "name":
        parts = [w for w in words if w[0].isalpha() and w.lower() not in PARTICLES]
        return len(parts) >= 2 and max(map(len, parts)) > 2 and all(w[0].isupper() for w in parts) and all(w[0].isalpha() or w in ".,'-" for w in words) and "\n" not in text[toks[0][0] : toks[-1][1]]
    if kind in NUMBERS:
        return sum(c.isdecimal() for w in words for c in w) >= 7 and sum(w[0].isalpha() for w in words) <= 2
    return kind == "address" and any(w[0].isdecimal() for w in words) and any(len(w) > 2 and w[0].isalpha() for w in words)


def items(text: str, cands: list[tuple[int, int, str, str]], ws: list[Window], marginals: list[np.ndarray]) -> list[tuple[int, int, str]]:
    """The items of a text by the field's labels.

    A candidate in a format is an item unless, over its tokens, the field is SURE that it is other text; its format gives
    the borders and the kind, but for a number that fits both kinds of numbers. Any other run of equal labels
    that holds a candidate is an item with the run's borders if it is `complete` and touches no item.
    """
    sums, n = np.zeros((len(cands), len(LABELS))), np.zeros(len(cands))
    runs: list[tuple[int, int, str]] = []
    for w, m in zip(ws, marginals):
        p = np.exp(m)
        best = p.argmax(1)
        for t, k in enumerate(w.inside):
            if k >= 0:
                sums[k] += p[t]
                n[k] += 1
        t = 0
        while t < len(best):
            e = t + 1
            while e < len(best) and best[e] == best[t]:
                e += 1
            if best[t] and max(w.inside[t:e]) >= 0:
                toks = w.tokens[t:e]
                while toks and not text[toks[-1][0]].isalnum() and text[toks[-1][0]] != ".":
                    toks = toks[:-1]
                while toks and not text[toks[0][0]].isalnum() and text[toks[0][0]] not in "(+":
                    toks = toks[1:]
                if toks and complete(text, LABELS[best[t]], toks):
                    runs.append((toks[0][0], toks[-1][1], LABELS[best[t]]))
            t = e
    out = []
    for k, (a, b, kind, form) in enumerate(cands):
        if n[k] and not form.startswith("loose") and sums[k][0] <= SURE * n[k]:
            either = [LABELS.index(x) for x in NUMBERS]
            out.append((a, b, LABELS[max(either, key=lambda y: sums[k][y])] if form.endswith("?") else kind))
    formats = [c[:2] for c in cands if not c[3].startswith("loose")]
    for r in runs:
        if all(r[1] <= a or r[0] >= b for a, b in formats) and all(r[1] <= a or r[0] >= b for a, b, _ in out):
            out.append(r)
    return sorted(out)


def detect(documents: DataFrame, names: DataFrame, redact: bool = False, field: str = "skip", hold: tuple[str, ...] = ()) -> DataFrame:
    """The personal items of every document's text, or with `redact` every document with typed placeholders.

    Items: `doc_id`, `kind`, `start_pos` (0-based, in code points), `end_pos`. Redacted: `doc_id`, `text`, where each item is
    replaced by its kind in brackets and all else stays; a null text stays null. Null and empty texts have no items;
    repeated rows give repeated results; an empty table gives none. Other columns are not read. For comparison, `field` may
    also be `chain` (no skip links) or `none` (every candidate that keeps to a format), and the formats of `hold` may be held back,
    in training and from the result, so that only the field can find what they would.
    """
    spark = documents.sparkSession
    gazetteer = _gazetteer(names)
    model, _ = fit(documents, gazetteer, hold)
    shared = spark.sparkContext.broadcast((gazetteer, (model[0].astype(np.float32), model[1], model[2])))  # WIDTH x labels numbers
    schema = "doc_id long, text string" if redact else "doc_id long, kind string, start_pos int, end_pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_, model_ = shared.value
        finder = Finder(names_, hold)
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                ids, texts = (part.column(k).to_pylist() for k in (0, 1))
                found = [finder.spans(t) if t else [] for t in texts]
                ws, docs = [], []
                for k, (t, cands) in enumerate(zip(texts, found)):
                    if cands:
                        own = windows(t, cands, names_)
                        ws += own
                        docs += [k] * len(own)
                marg = decide(ws, docs, model_, field == "skip")
                by = defaultdict(list)
                for w, d, m in zip(ws, docs, marg):
                    by[d].append((w, m))
                rows = []
                for k, (i, t) in enumerate(zip(ids, texts)):
                    if field == "none":
                        got = [c[:3] for c in found[k] if not c[3].startswith("loose")]
                    else:
                        got = items(t, found[k], *zip(*by[k])) if k in by else []
                    if redact:
                        for a, b, kind in reversed(got):
                            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
                        rows.append((i, t))
                    else:
                        rows += [(i, kind, a, b) for a, b, kind in got]
                cols = list(zip(*rows)) or [()] * (2 if redact else 4)
                types = (pa.int64(), pa.string()) if redact else (pa.int64(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in schema.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, schema)
