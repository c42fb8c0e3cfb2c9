"""Personal data in free text: names, email addresses, phone numbers, identity numbers and street addresses.

A transducer rewrites disguises (look-alike letters, wide and invisible
characters, spelled digits, "at" and "dot") and keeps, for every character it
emits, where it came from.  Detectors read the rewritten text; their spans are
mapped back, so that positions and replacements refer to the source as it is.

Names are told by a model of the people table: given names, and family names as
stems and endings that several people share, so that families the table lacks
are known too if their halves are; and, whoever is in the table, by given names
that are common in many countries before a capitalized word that is no ordinary
one.  The people table may have any size: what is made of it, and broadcast, are
its different given names and family parts, which are few however many people
there are, and whose number is checked against `PARTS`.

Null, empty and blank contents have nothing; repeated rows count once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread

PARTS = 200_000
KINDS = ("name", "email", "phone", "id_number", "address")

# --- Disguises -------------------------------------------------------------------------------------------------------
# Cyrillic and Greek letters and the Latin ones they look like.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijsdhqwABEKMHOPCTXIJSABEZHIKMNOPTYXo"))
_WIDE = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_INVISIBLE = "​‌‍⁠﻿­"
_ODD = re.compile(f"[{_INVISIBLE}！-～]|[A-Za-z0-9@.][Ѐ-ԯΑ-ω]|[Ѐ-ԯΑ-ω][A-Za-z0-9@]")
_TOKEN = re.compile(r"[^\s<>()\[\]{},;:\"']+")
_DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0", "nil": "0"}
_SPELLED = re.compile(rf"(?i)\b(?:(?:double |triple )?(?:{'|'.join(_DIGIT_WORDS)})\b[ ,.-]{{0,2}}){{6,}}")
_AT = re.compile(r"(?i)(?<=[\w+-])\s*(?:[\[({<]\s*(?:at|@|arroba|ät)\s*[\])}>]|\s(?:at|arroba)\s(?=[\w-]+(?:\s*[\[({]?\s*(?:dot|punkt|point|punto)\b)))\s*(?=\w)|(?<=[\w+-])\s?@\s?(?=[\w-]+\s+dot\s)")
_DOT = re.compile(r"(?i)(?<=\w)(?:\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto)\s+)(?=\w)")


_SUSPECT = re.compile(f"[{_INVISIBLE}！-～Ѐ-ԯΑ-ω]")
_AT_HINTS = ("[at", "(at", "{at", "<at", "[ at", "( at", " dot ", "[dot", "(dot", "[@", "(@", "[ @", "( @", "arroba", "ät]", "ät)", "punkt", "punto")
_LABEL = re.compile(r"[\w-]+")
_LOCAL_CHAR = re.compile(r"[\w.+-]")
_DOT_BEFORE = re.compile(r"(?i)(?<=\w)(?:\s+dot\s+|\s*[\[(]\s*dot\s*[\])]\s*)\Z")


def _edits(text: str, low: str) -> list[tuple[int, int, str]]:
    """What the transducer replaces: (start, end, new text), in order."""
    out: list[tuple[int, int, str]] = []
    if not text.isascii() and _SUSPECT.search(text) and _ODD.search(text):
        for m in re.finditer(f"[{_INVISIBLE}]", text):
            out.append((m.start(), m.end(), ""))
        for m in re.finditer("[！-～]", text):
            out.append((m.start(), m.end(), _WIDE[m[0]]))
        for m in _TOKEN.finditer(text):
            # Only within words that are Latin otherwise.
            if not m[0].isascii() and re.search("[A-Za-z0-9@]", m[0]):
                out += [(m.start() + i, m.start() + i + 1, _LOOKALIKE[c]) for i, c in enumerate(m[0]) if c in _LOOKALIKE]
    if any(h in low for h in _AT_HINTS):
        for m in _AT.finditer(text):
            out.append((m.start(), m.end(), "@"))
            at = m.end()
            # Dots are words only in the domain that follows and in the local part before.
            while (d := _LABEL.match(text, at)) and (x := _DOT.match(text, d.end())):
                out.append((x.start(), x.end(), "."))
                at = x.end()
            end = m.start()
            while True:
                while end and _LOCAL_CHAR.match(text[end - 1]):
                    end -= 1
                if not (x := _DOT_BEFORE.search(text, max(0, end - 40), end)):  # a disguise, however long the name before it
                    break
                out.append((x.start(), x.end(), "."))
                end = x.start()
    if sum(low.count(w) for w in _DIGIT_WORDS) >= 6:
        for m in _SPELLED.finditer(text):
            digits, times = "", 1
            for w in re.findall(r"[A-Za-z]+", m[0]):
                w = w.lower()
                if w in ("double", "triple"):
                    times = 2 if w == "double" else 3
                else:
                    digits += _DIGIT_WORDS[w] * times
                    times = 1
            out.append((m.start(), m.start() + len(m[0].rstrip(" ,.-")), digits))
    out.sort()
    return out


class Normalized:
    """A rewritten text and the way back to its source."""

    def __init__(self, text: str, low: str | None = None):
        self.source, parts, at, n = text, [], 0, 0
        self.spelled: list[tuple[int, int]] = []  # runs of spelled digits
        self.marks, self.shifts = [0], [(0, 0, 1)]  # where a stretch begins; its source start, and end of a replaced stretch
        last = -1
        for a, b, new in _edits(text, text.lower() if low is None else low):
            if a < last:
                continue
            parts += [text[at:a], new]
            n += a - at
            self.marks.append(n)
            self.shifts.append((a, b, 0))
            n += len(new)
            self.marks.append(n)
            self.shifts.append((b, b, 1))
            at = last = b
            if b - a > 3 * len(new) > 18 and new.isdigit():
                self.spelled.append((n - len(new), n))
        self.text = "".join(parts) + text[at:] if parts else text
        self.plain = not parts

    def start(self, i: int) -> int:
        if self.plain:
            return i
        k = bisect_right(self.marks, i) - 1
        a, _, moves = self.shifts[k]
        return a + (i - self.marks[k]) * moves

    def end(self, i: int) -> int:
        """Source position behind the character before i."""
        if self.plain:
            return i
        k = bisect_right(self.marks, i - 1) - 1
        a, b, moves = self.shifts[k]
        return a + (i - self.marks[k]) if moves else b


# --- Names -----------------------------------------------------------------------------------------------------------
# Particles of family names, and titles.
_PARTICLES = "af|av|de|da|di|del|della|dos|du|la|le|van|van der|van den|von|von der|ter|ten|zu"
_LETTER = r"[^\W\d_]"


def _name_parts(name: str) -> tuple[str, list[str]] | None:
    """The given name and the parts of the family name of a person's name; none of what isn't one."""
    if not name or not re.fullmatch(rf"{_LETTER}[\w'’. -]*", name) or re.search(r"\d|bot$", name):
        return None
    w = name.split()
    return (w[0], w[-1].split("-")) if len(w) > 1 else None


class People:
    """Given names and families of a people table."""

    def __init__(self, names: list[str]):
        split = [x for n in names if (x := _name_parts(n))]
        self._learn({g for g, _ in split}, {p for _, f in split for p in f})

    @classmethod
    def of_parts(cls, given: set[str], parts: set[str]) -> People:
        out = cls([])
        out._learn(given, parts)
        return out

    def _learn(self, given: set[str], family_parts: set[str]) -> None:
        self.given = sorted((g for g in given if len(g) > 1 and g[0].isupper()), key=lambda g: (-len(g), g))
        parts = sorted(p for p in family_parts if len(p) > 2 and p[0].isupper())
        stems, ends = Counter(), Counter()
        for p in parts:
            for i in range(3, len(p) - 1):
                stems[p[:i]] += 1
                ends[p[i:]] += 1
        good: Counter = Counter()
        tails: Counter = Counter()
        for p in parts:
            best = max(((min(stems[p[:i]], ends[p[i:]]), ends[p[i:]], i) for i in range(3, len(p) - 1)), default=(0, 0, 0))
            if best[0] >= 3:
                good[p[:best[2]]] += 1
                tails[p[best[2]:]] += 1
        alt = lambda xs: "|".join(map(re.escape, sorted(xs, key=lambda x: (-len(x), x))))
        made = f"(?:{alt(s for s, n in good.items() if n > 1)})(?:{alt(t for t, n in tails.items() if n > 1)})" if good else ""
        rest = [p for p in parts if not (made and re.fullmatch(made, p))]
        one = "|".join(x for x in (made, alt(rest)) if x)
        self.one_family = re.compile(f"(?i:{one})\\Z") if one else None
        self.find = self.hint = None
        if self.given and one:
            family = rf"(?:(?:{_PARTICLES})[  \n])?(?:{one})(?:-(?:{one}))?"
            first = rf"(?:(?:{alt(self.given)})(?:-(?:{alt(self.given)}))?|{_LETTER}\.)(?:[  ]?{_LETTER}\.)?"
            self.hint = re.compile("|".join(sorted({y for x in parts for y in (x[:3], x[:3].upper())})))
            self.find = re.compile(rf"(?i)(?<![\w@.+/-])(?:{first}[  \n]{family}|{family},[  \n]{first})(?![\w@]|[.+-]\w)")


    def spans(self, text: str):
        """Names, found around what may begin a family name."""
        if self.find is None:
            return
        done = 0
        for h in self.hint.finditer(text):
            if h.start() < done:
                continue
            m = self.find.search(text, max(done, h.start() - 60), h.start() + 100)
            if m and m.start() <= h.start() + 40:
                done = m.end()
                if _cased(m[0]):
                    yield m.span()


def _cased(name: str) -> bool:
    """Whether a name is written as one: capitals at the beginnings, or all capitals."""
    words = re.findall(rf"{_LETTER}+", name)
    if all(w.isupper() for w in words):
        return True
    return all(w[0].isupper() or w.lower() in "af av de da di del della dos du la le van der den von ter ten zu".split() for w in words) and not any(w.isupper() and len(w) > 1 for w in words)


# Given names that are common in many countries and are no ordinary words of a text.
_COMMON = frozenset("""Ahmed Aisha Akira Alejandro Aleksandra Alessandro Amina Ananya Andrei Anjali Antonio Arjun Bogdan Carlos Chiara Chidi Chioma Deepak Dmitri Dmitry Ekaterina Emeka Fatima Fernando Francesca Giovanni Giulia
Giuseppe Guillermo Haruka Hassan Hiroshi Ibrahim Isabella Ivan Jamal Jorge José Juan Kavita Kenji Khadija Krzysztof Kwame Lakshmi Leila Luca Magdalena Małgorzata Mariana Mehmet Mei Mohamed Mohammed Muhammad Mustafa Natalia
Nikolai Ngozi Nguyen Olga Oluwaseun Omar Pablo Paolo Priya Rahul Rajesh Ravi Roberto Sanjay Sergei Sergey Sofía Sunita Svetlana Takeshi Tatiana Thabo Vikram Vladimir Wei Wojciech Xiao Yuki Yusuf Zainab""".split())
# Words that stand behind a given name without being a family's.
_NOT_FAMILIES = frozenset("And Or The A An Is Was Has Had Will Can Team Service Cluster Server Group Project Street Road Avenue Lane Drive On In At For From To With By Of As If But Not When Then This That Please Thanks Hi Hello".split())
_COMMON_NAME = re.compile(rf"(?<![\w@.+/-])({'|'.join(sorted(_COMMON, key=lambda x: (-len(x), x)))})[  ]((?:(?:{_PARTICLES})[  ])?[A-ZÀ-ÖØ-ÞŁŚŻŹČŠŽ][^\W\d_]+(?:-[A-ZÀ-ÖØ-ÞŁŚŻŹČŠŽ][^\W\d_]+)?)(?![\w@]|[.+-]\w)")


def _common_names(t: str):
    for m in _COMMON_NAME.finditer(t):
        if m[2] not in _NOT_FAMILIES and not m[2].isupper():
            yield m.span()


# --- The other kinds -------------------------------------------------------------------------------------------------

_LOCAL = frozenset("0123456789_.%+'-") | frozenset(chr(c) for c in range(0x250) if chr(c).isalpha())
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w@-])")
_SAYS_MAIL = re.compile(r"(?i)(?:mailto|e-?mail|mail|cc|to|from|contact|sender|author|reply-to|bcc|by|write|at|address|addr):\Z")
_IN_ADDRESS = re.compile(r"[\w$}%]:\Z")


def _emails(t: str):
    """One pass: the word that an address stands in, and whether a "://" is in it, are carried on from address to address."""
    i, read, word, scheme = t.find("@"), 0, 0, -1
    while i >= 0:
        m = _DOMAIN.match(t, i + 1)
        a = i
        while a > read and t[a - 1] in _LOCAL:
            a -= 1
        while a < i and t[a] in ".'-%+":
            a += 1
        if m and a < i and t[i - 1] not in ".%'" and t[a:i].strip("._%+'-"):
            for k in range(a - 1, read - 1, -1):
                if t[k].isspace():
                    word = k + 1
                    break
            scheme = max(scheme, t.rfind("://", max(0, read - 3), a))
            left = t[max(word, a - 16):a]
            remote = t[a:i] == "git" and t[m.end():m.end() + 1] in (":", "/")
            in_address = scheme >= word or _IN_ADDRESS.search(left) and not _SAYS_MAIL.search(left)
            read = a
            if not remote and not in_address:
                yield a, m.end()
        i = t.find("@", i + 1)


_PHONE = re.compile(
    r"(?<![\w./:@#-])(?<![\d+(] )(?<!\d,)(?:"
    r"\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?(?:\d{1,5}[ ./-]?){1,6}\d{2,}"
    r"|\(\+\d{1,3}\)[ .-]?(?:\(\d{1,5}\)[ .-]?)?(?:\d{1,5}[ ./-]?){1,6}\d{2,}"
    r"|00[1-9]\d{0,2}[ .]\(?\d{1,5}\)?(?:[ .-]?\d{1,8}){1,5}"
    r"|(?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}([ .-])\d{3}\1\d{4}"
    r"|0\d{1,4}/\d{3,8}(?:[ -]\d{1,6})?|\(0\d{2,4}\)[ /-]?\d{3,8}(?:[ -]\d{1,6})?"
    r"|0\d([ .-])\d{2}\2\d{2}\2\d{2}\2\d{2}|0\d{2,4} \d{3,4} \d{3,4}|0\d{4} \d{6})"
    r"(?: ?(?:ext\.?|x|#|Durchwahl|DW) ?\d{1,5}\b)?(?![\w@]|[./-]\d| \d{2}:)"
)


_PHONE_HINT = re.compile(r"\+\d|\(\+?\d|0\d|1[ .-]\(|\d{3}[ .-]\d{3}[ .-]\d{4}")
_NOT_PHONE = re.compile(r"(?i)\b(?:order|part(?: no)?|build|invoice|ticket|sku|serial|commit|trace|version|isbn|ref)\.?:? *\Z")


def _phones(t: str):
    done = 0
    for h in _PHONE_HINT.finditer(t):
        if h.start() < done or not (m := _PHONE.match(t, h.start())):
            continue
        done = m.end()
        digits = sum(map(str.isdigit, re.split(r"(?i)ext|x", m[0])[0]))
        if 9 <= digits <= 15 and not _NOT_PHONE.search(t[max(0, m.start() - 16):m.start()]):
            yield m.span()


_ID_LABEL = r"(?i:passport|ssn|social security|dni|nie|nif|pesel|tax[ -]?id|tin|identity|personal id|id card|national (?:id|insurance)|nino|national insurance|personnummer|steuer-?id|ausweis|id number|ident)"
_ID = re.compile(
    r"(?<![\w.+/@#-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{7}|[XYZ]?\d{7,8}-?[A-Z]|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{11})(?![\w@]|[.-]\d)"
)
_LABELLED = re.compile(rf"\b{_ID_LABEL}\b[^\n]{{0,30}}\Z")


_ID_HINTS = ("passport", "ssn", "social", "dni", " nie", " nif", "pesel", "tax id", "tax-id", "taxid", " tin", "identi", "ident ", "ident:", "personal id", "id card", "id number", "national i", "nino", "personnummer", "steuer", "ausweis")


def _id_numbers(t: str):
    for m in _ID.finditer(t):
        if _LABELLED.search(t[max(0, m.start() - 60):m.start()]):
            yield m.span()


# Words that end, or begin, the name of a street.
_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŻŹČŠŽ][\w'’]*"
_TOWN = rf"(?:,\s(?:\d{{4,5}}\s)?{_CAP}(?:-{_CAP})*(?: (?:am|an der|sur|on|upon|de|del|la) {_CAP})?)?"
_FLAT = r"(?:,\s(?:Apt|Flat|Unit|Suite|Ste|Floor|Room)\.? ?\w+)?"
_ADDRESS = re.compile(
    r"(?<![\w./:@#-])(?:"
    rf"\d{{1,5}}[a-z]?,? (?:{_CAP} ){{1,3}}(?:Street|Str|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Way|Close|Court|Ct|Crescent|Cres|Row|Place|Pl|Terrace|Square|Sq|Boulevard|Blvd|Hill|Gardens|Walk|Mews|Parade|Grove|Highway|Parkway)\b\.?{_FLAT}{_TOWN}"
    rf"|(?:Rue|Avenue|Boulevard|Place|Chemin|Quai|Allée)(?: (?:de la|de l[’']|du|des|de|d[’']))? ?(?:{_CAP}[ -]?)+,? ?\d{{1,4}}[a-z]?\b{_TOWN}"
    rf"|(?:{_CAP} )?{_CAP}(?:gatan|vägen|gränd|torget|gade|veien|vej|straat|laan|kade|plein|gracht|dijk|katu) \d{{1,4}}(?: ?[a-zA-Z])?\b{_TOWN}"
    rf"|\d{{1,5}}(?: ?(?:bis|ter|[a-z]))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours)(?: (?:de la|de l[’']|du|des|de|d[’'])){{0,1}} ?(?:{_CAP}[ -]?)+{_TOWN}"
    rf"|(?:{_CAP}[ -])?{_CAP}(?<=[a-zäöüß])?(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|steig) \d{{1,4}}(?: ?[a-z])?\b{_TOWN}"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Rua|Via|Viale|Piazza|ul\.|al\.|ulica|aleja|plac)(?: (?:de|del|la|las|los|da|do|dos))* (?:{_CAP} ?)+,? ?(?:n[.º°]? ?)?\d{{1,4}}[a-z]?\b{_TOWN}"
    r")"
)
_STREETS = ("Street", "Str", " St ", " St.", " St,", "Avenue", " Ave", "Road", " Rd", "Lane", " Ln", "Drive", " Dr", "Way", "Close", "Court", " Ct", "Cres", "Row", "Place", " Pl", "Terrace", "Square", " Sq", "Boulevard", "Blvd", "Hill", "Gardens", "Walk", "Mews", "Parade", "Grove", "Highway", "Parkway", "straße", "strasse", "str.", "weg ", "allee ", "platz ", "gasse ", "ring ", "damm ", "ufer ", "steig ", " rue", " avenue", " boulevard", " place", "chemin", "impasse", "allée", " quai", " route", " cours", "Calle", "Avenida", "Plaza", "Paseo", "Rua ", "Via ", "Viale", "Piazza", "ul.", "al.", "ulica", "aleja", "plac ", "Rue ", "Chemin", "Quai ", "Allée ", "gatan ", "vägen ", "gränd ", "torget ", "gade ", "veien ", "vej ", "straat ", "laan ", "kade ", "plein ", "gracht ", "dijk ", "katu ")


def _addresses(t: str):
    for m in _ADDRESS.finditer(t):
        yield m.span()


def find(content: str | None, people: People) -> list[tuple[str, int, int]]:
    """(kind, start, end) in source positions, in order; of spans that overlap, the first kind of the list below stays."""
    if not content or content.isspace():
        return []
    low = content.lower()
    n = Normalized(content, low)
    t, spans = n.text, []
    if "@" in t:
        spans += [("email", a, b) for a, b in _emails(t)]
    if any(h in t for h in _STREETS):
        spans += [("address", a, b) for a, b in _addresses(t)]
    if any(h in low for h in _ID_HINTS):
        spans += [("id_number", a, b) for a, b in _id_numbers(t)]
    spans += [("phone", a, b) for a, b in _phones(t)]
    spans += [("phone", a, b) for a, b in n.spelled if 9 <= b - a <= 15]
    spans += [("name", a, b) for a, b in people.spans(t)]
    spans += [("name", a, b) for a, b in _common_names(t)]
    out: list[tuple[str, int, int]] = []
    starts: list[int] = []  # of the spans that stay, in order, and their ends
    ends: list[int] = []
    for kind, a, b in spans:
        k = bisect_right(starts, a)
        if (k == 0 or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b):
            starts.insert(k, a), ends.insert(k, b)
            out.append((kind, n.start(a), n.end(b)))
    return sorted(out, key=lambda x: x[1:])


def redact(content: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if content is None or not spans:
        return content
    out, at = [], 0
    for kind, a, b in spans:
        out += [content[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + content[at:]


def people_of(users: DataFrame, name_col: str = "name") -> People:
    """The model of a people table of any size with at most `PARTS` different given names and family parts (else it raises)."""
    def run(batches):
        for b in batches:
            seen = {x for n in b.column(0).to_pylist() if (p := _name_parts(n)) for x in [("g", p[0]), *(("f", y) for y in p[1])]}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.string())], ["kind", "part"])

    rows = users.select(F.col(name_col).alias("name")).where(F.col(name_col).isNotNull()).distinct().mapInArrow(run, "kind string, part string").distinct().limit(PARTS + 1).collect()
    if len(rows) > PARTS:
        raise ValueError(f"more than {PARTS} different given names and family parts: that is no table of people")
    return People.of_parts({r[1] for r in rows if r[0] == "g"}, {r[1] for r in rows if r[0] == "f"})


def find_personal_data(df: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct (tbl, rec_id, kind, start_pos, end_pos) of `df` (tbl, rec_id, content); positions in code points from 0."""
    people = people_of(users)

    def run(batches):
        for b in batches:
            at, kinds, starts, ends = [], [], [], []
            for i, t in enumerate(b.column(2)):
                for k, s, e in find(t.as_py(), people):
                    at.append(i), kinds.append(k), starts.append(s), ends.append(e)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["tbl", "rec_id", "kind", "start_pos", "end_pos"])

    return spread(df.select("tbl", "rec_id", "content")).mapInArrow(run, "tbl string, rec_id string, kind string, start_pos bigint, end_pos bigint").distinct()


def replace_personal_data(df: DataFrame, users: DataFrame) -> DataFrame:
    """(tbl, rec_id, replaced, n_values): the content with typed placeholders; null stays null."""
    people = people_of(users)

    def run(batches):
        for b in batches:
            texts, counts = [], []
            for t in b.column(2):
                t = t.as_py()
                spans = find(t, people)
                texts.append(redact(t, spans)), counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["tbl", "rec_id", "replaced", "n_values"])

    return spread(df.select("tbl", "rec_id", "content")).mapInArrow(run, "tbl string, rec_id string, replaced string, n_values int")
