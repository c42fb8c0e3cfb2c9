"""Text decoded with a wrong character encoding: find it and restore it.

Every maximal run of non-ASCII characters is mapped back to the bytes that each
legacy code page would have read, a byte-structure automaton picks the maximal
well-formed multibyte spans, and only those spans are decoded.  The step is
repeated on its own result until nothing changes (a step always shortens the
text), so text that was damaged however often comes back as well.  Lines whose
characters are the pairs of an East Asian page go through that page's automaton
and count only as text of its language.  Damage that leaves no multibyte
structure (a single-byte page read as another one, bytes replaced by U+FFFD) is
told by its letters.

A decoded span is read again the wrong way and must give the source; what looks
damaged but fits no page stays as it is, with `whole` false.

Nulls and empty texts are never damaged and come out as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread

# Code pages that UTF-8 is commonly misread as.
UTF8_MISREAD_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859_2", "cp1254", "koi8_r", "cp866")
# Fixed values: (true page, page it was read as) of single-byte mix-ups.
CYRILLIC_SWAPS = (("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859_5", "cp1251"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"))

_RUN = re.compile("[^\x00-\x7f]+")
# The automaton of well-formed UTF-8 (RFC 3629, table 3-7), multibyte forms only.
_WELL_FORMED = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)


def _page(codec: str) -> dict[str, int]:
    """Character to byte; bytes that the page leaves open stand for the control character of the same number."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        table.setdefault(chr(b), b)
    return table


_PAGES = {c: _page(c) for c in UTF8_MISREAD_AS}
_BOX = re.compile("[─-╿]")


_USUAL_SIGNS = frozenset("‐‑‒–—―‘’‚‛“”„†‡•…‰′″‹›€№™←↑→↓↔−≈≠≤≥√∞★✓✔")


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250:
        return "latin"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x2000 <= o < 0x2c00 or 0xfb00 <= o < 0xfb07:
        return "sign"
    if 0x3000 <= o < 0xa000 or 0xac00 <= o < 0xd7a4 or 0xff00 <= o < 0xfff0:
        return "east"
    return "emoji" if o >= 0x1f000 else "other"


def _plausible(span: str, codec: str, text: str, before: str, after: str) -> bool:
    """Whether `span`, in its place between `before` and `after`, is a misreading of `text` rather than correct text."""
    if any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") and not ("\x80" <= c <= "\x9f") for c in text):
        return False
    kinds = {_script(c) for c in text}
    if codec in ("cp1251", "koi8_r", "cp866"):
        # Ordinary Cyrillic maps to well-formed bytes now and then: what comes out must be letters or signs in use.
        if not all(c in _USUAL_SIGNS or "А" <= c <= "я" or c in "ёЁіїєґІЇЄҐ" or 0xC0 <= ord(c) < 0x180 or "\x80" <= c <= "\xbf" for c in text) and not (kinds == {"east"} and len(text) > 2):
            return False
        in_latin = before.isascii() and before.isalpha() or after.isascii() and after.isalpha()
        if in_latin and kinds <= {"latin", "sign"}:
            return True
        if codec != "cp1251" or all(c.isalpha() and (c.islower() or c.isupper()) and "А" <= c <= "я" for c in span):
            # Letters alone, as in any word: a whole word must come out in better order.
            return len(text) > 2 and kinds == {"cyrillic"} and _ru_score([text]) > 0.3 > _ru_score([span])
        if len(span) == 2:
            return span[0] in "ВГ" and not span[1].isalpha() and span[1] not in "»“”„‚’‘–—…«"
        return not ("latin" in kinds and len(text) < 2) or len(span) > 2
    if codec in ("cp437", "cp850"):
        if all(_BOX.match(c) or c in "█▄▌▐▀░▒▓" for c in span):
            if _BOX.match(before) or _BOX.match(after):
                return False
            return any(c.isalpha() and ord(c) < 0x250 for c in before + after) or span[0] in "┬" and span[1] in "░▒▓"
        return True
    if codec == "mac_roman":
        if kinds == {"cyrillic"}:
            return len(text) >= 2
        return not (kinds & {"other"} and len(text) < 3)
    if codec in ("cp1252", "iso8859_2", "cp1250", "cp1254"):
        if len(span) == 2 and span[1] in "“”’‘»«–—…›‹„‚™©®¡¿ªº°·§":
            # A capital with its closing mark ("AÇÃO Ã”") or a heading in capitals: only real letters come out of words.
            alone = not before.isalpha() and not after.isalpha()
            if before.isupper() and not after.islower():
                return False
            if alone and text not in "éàèùâêîôûäöüßçñãõáíóúÀÉÈÂÊÔÎÛÄÖÜÇÑÃÕÁÍÓÚ" and kinds != {"latin"}:
                return False
            return text[0].isalpha() or span[0] in "ÂĂ"
        if kinds & {"other"} and len(text) < 3:
            return False
    return True


def _comes_back(span: str, text: str, codec: str) -> bool:
    """Whether `text`, encoded and read by the page again, gives `span`; a byte that the page leaves open may stand as the
    control character of its number."""
    again = text.encode("utf-8")
    return len(again) == len(span) and all(_PAGES[codec].get(c) == b for c, b in zip(span, again))


#: Bytes that a page has a character of its own for: where the control character stands instead, another page was read.
_OWN = {codec: {b for c, b in table.items() if not "\x80" <= c <= "\x9f"} for codec, table in _PAGES.items()}


@lru_cache(maxsize=1 << 16)
def _readings(run: str, before: str, after: str, sure: str) -> dict[str, tuple[int, str, int, int]]:
    """By page, what the run's spans decode to where that is plausible: characters won, text, controls that stand for the
    page's own characters (counted negative) and letters in use.  For the pages in `sure` it need not be plausible."""
    out = {}
    for codec, table in _PAGES.items():
        data = bytes(table.get(c, 0) for c in run)
        parts, at, won, usual = [], 0, 0, 0
        for h in _WELL_FORMED.finditer(data):
            span, text = run[h.start():h.end()], h[0].decode("utf-8")
            if _comes_back(span, text, codec) and (codec in sure or _plausible(span, codec, text, run[h.start() - 1] if h.start() else before, run[h.end()] if h.end() < len(run) else after)):
                parts += [run[at:h.start()], text]
                at, won, usual = h.end(), won + len(span), usual + sum(10 * (c in _USUAL) + (c in _FREQUENT) for c in text)
        if won:
            out[codec] = won, "".join(parts) + run[at:], -sum("\x80" <= c <= "\x9f" and ord(c) in _OWN[codec] for c in run), usual
    return out


# --- Single-byte pages read as one another -------------------------------------------------------------------------
# Frequent Russian letter pairs (lower case), as published in letter statistics of the language.
_RU_PAIRS = frozenset("ст но ен то на ов ни ра во ко ро по пр ре ос ри го ер от ал ли ол ан ор ет те не ом та ти ос ль ил ка ла да ел ем за ве де до ит ин ид со ск сл об ом он их ые ый ая ия ие ий ть шл см кл сь ся чн яв ач аж ва ас ат ес ле ло ма ми мо об оп пе пу ру си се тр ту ут уч ча че чт ши щи эт".split())
# Fixed values: (true page, page it was read as) of Western and Central European mix-ups.
WESTERN_SWAPS = (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"))
# Letters and signs that the European languages really use.
_USUAL = frozenset("éèêëàâçùûüôîïœæáíóúñãõäößåøòìýąćęłńśźżčďěňřšťůžľĺŕăâîșțşţőűğıÉÈÊÀÂÇÙÛÔÎŒÁÍÓÚÑÃÕÄÖÜÅØĄĆĘŁŃŚŹŻČŘŠŽŐ’‘“”„–—…€¿¡°ºª«»×±µ→≈")
_QUIET = frozenset("’‘“”„–—…«»‹›\u00ad\u00a0\u200b\u200c\u200d\u2060\ufeff·‐‑→←−º°")
# Signs and letters that correct text has, but not between two Latin letters; quotes that enclose something are left alone.
_BETWEEN = frozenset("“”„«»‹›·º°µ")
_ENCLOSED = re.compile("“[^“”]*”|„[^„“]*“|«[^«»]*»|»[^«»]*«|‹[^‹›]*›|›[^‹›]*‹")
# The letters that are frequent in languages with many speakers; where several pages explain a sentence equally
# well, the one with more of them is taken.
_FREQUENT = frozenset("éäöüßáãçñøåæàè")
_LONE = frozenset("óûùöìîíëôòúƒ")
_CYR_WORD = re.compile("[Ѐ-џҐґ╔╦]{3,}")
_LATIN1_RUN = re.compile("[À-ÿ\u0080-\u009f‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]{5,}")
_PART = re.compile(r"(?<=[.!?:;])(\s+)")


def _ru_score(words: list[str]) -> float:
    pairs = [w[i:i + 2] for w in map(str.lower, words) for i in range(len(w) - 1)]
    return sum(p in _RU_PAIRS for p in pairs) / max(1, len(pairs))


@lru_cache(maxsize=1 << 16)
def _swap_char(c: str, true: str, read: str) -> str:
    try:
        return c.encode(read).decode(true)
    except UnicodeError:
        try:
            return bytes([ord(c)]).decode(true) if 0x80 <= ord(c) < 0xA0 else c
        except UnicodeError:
            return c


def _swap(text: str, true: str, read: str) -> str:
    return "".join(_swap_char(c, true, read) if c > "\x7f" else c for c in text)


@lru_cache(maxsize=1 << 14)
def _cyrillic_part(part: str) -> str:
    """The sentence with Cyrillic read back from the wrong Cyrillic or Western page, or the sentence itself."""
    words = _CYR_WORD.findall(part)
    if words:
        flipped = sum(w[0].islower() and w[1:].isupper() for w in words)
        now = _ru_score(words)
        if not flipped and now > 0.25:
            return part
        pages = [p for p in CYRILLIC_SWAPS if p[1] != "cp1252"]
    elif sum(1 for w in _LATIN1_RUN.findall(part) if sum(map(str.isalpha, w)) >= 5) >= 2:
        now, pages = 0.0, [p for p in CYRILLIC_SWAPS if p[1] == "cp1252"]
    else:
        return part
    best = max(((_ru_score(_CYR_WORD.findall(s := _swap(part, t, r))), s) for t, r in pages), key=lambda x: x[0])
    return best[1] if best[0] > max(0.3, now + 0.15) else part


def _latin(c: str) -> bool:
    return c.isalpha() and ord(c) < 0x250


def _dotted(text: str, i: int) -> bool:
    """Whether the middle dot at `i` is one of Catalan (l·l), of units (kW·h) or of syllables (syl·la·ble)."""
    a, b = i, i + 1
    while a and (_latin(text[a - 1]) or text[a - 1] == "·"):
        a -= 1
    while b < len(text) and (_latin(text[b]) or text[b] == "·"):
        b += 1
    return text[i - 1:i + 2].lower() == "l·l" or max(i - a, b - i - 1) < 3 or text.count("·", a, b) > 1


def _odd(text: str) -> int:
    """How many characters stand where no European spelling has them."""
    n = 0
    enclosing = {k for m in _ENCLOSED.finditer(text) for k in (m.start(), m.end() - 1)}
    for m in _RUN.finditer(text):
        s, e = m.span()
        if _latin(text[s - 1:s] or " ") and _latin(text[e:e + 1] or " ") and all(c in "÷▀ⁿ" for c in m[0]):
            n += e - s  # ö, ß and ü of the Western page read as a PC page
            continue
        for i in range(s, e):
            c, p, q = text[i], text[i - 1:i] if i else " ", text[i + 1:i + 2] or " "
            if c in _BETWEEN and _latin(p) and _latin(q):
                n += i not in enclosing and not (c == "·" and _dotted(text, i))
                continue
            if c in _QUIET:
                continue
            if "\x80" <= c <= "\x9f":
                n += 1
            elif c.isalpha() and c != "ˆ":
                greek = "Α" <= c <= "ω"
                if greek and (p.isascii() and p.isalpha() or q.isascii() and q.isalpha() or (p + q).strip(" .,:") == ""):
                    n += 1
                elif c.isupper() and p.islower() and ord(c) < 0x250:
                    n += 1
                elif c in _LONE and p in " \n" and q in " \n" or c == "ì" and p in " \n" and q.isalpha():
                    n += 1
                elif c.islower() and ord(c) < 0x250 and p.isupper() and q.isupper() and c not in "ßµºéïê":
                    n += 1
            elif (c == "ˆ" or unicodedata.category(c)[0] in "SNP") and c not in "€×±µ©®™":
                word = p.isalpha() and ord(p) < 0x250
                if word and (q.isalpha() and ord(q) < 0x250) or ((word or q.isascii() and q.isalpha()) and c in "¸·˙ˆ‰¾▀▄≤⌠⌡÷³¹¿ﬂ" and (q if word else p).isspace() and not (c in "¿·‰³¹" and not word)):
                    n += 1
            elif c in "±©®™×" and p.isalpha() and q.isalpha():
                n += 1
    return n


@lru_cache(maxsize=1 << 14)
def _western_part(part: str) -> str:
    """The sentence read back from the wrong European page where that leaves no oddity, or the sentence itself."""
    odd = _odd(part)
    if not odd:
        return part
    best = (0, part)
    for true, read in WESTERN_SWAPS:
        s = _swap(part, true, read)
        if s == part:
            continue
        changed = [b for a, b in zip(part, s) if a != b]
        good = sum(b in _USUAL for b in changed)
        if good < 0.8 * len(changed):
            continue
        score = 3 * (odd - _odd(s)) + good / len(changed) + 1e-3 * sum(b in _FREQUENT for b in changed) / len(changed)
        if odd > 2 * _odd(s) and score > best[0]:
            best = (score, s)
    return best[1]


# Double-byte pages of East Asia: the automaton of their well-formed pairs, where lead and trail may be ASCII.
_EAST_PAGES = {
    "euc_jp": re.compile(rb"(?:[\xa1-\xf4][\xa1-\xfe]|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2})+"),
    "cp932": re.compile(rb"(?:[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])+"),
    "cp949": re.compile(rb"(?:[\xa1-\xfd][\xa1-\xfe])+"),
    "gbk": re.compile(rb"(?:[\xa1-\xf7][\xa1-\xfe])+"),
    "big5": re.compile(rb"(?:[\xa1-\xf9][\x40-\x7e\xa1-\xfe])+"),
}
_KANA = re.compile("[぀-ヿ、。]")
_THREE = re.compile(rb"(?:\x8f[\xa1-\xfe]{2})+\Z")
_HANGUL = re.compile("[가-힣]")
# The most frequent characters of Chinese text, simplified and traditional.
_HAN = {"gbk": frozenset("的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可里后小么心多天而能好都然没"), "big5": frozenset("的一是不了在人有我他這中大來上國個到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可裡後小麼心多天而能好都然沒")}


def _reads_as(page: str, text: str, data: bytes) -> bool:
    """Whether what a page's pairs decode to is text of its language."""
    if page in ("euc_jp", "cp932"):
        kana = len(_KANA.findall(text))
        return len(text) >= 3 and kana >= 0.25 * len(text) or len(text) >= 2 and kana == len(text) and not data.isascii() or page == "euc_jp" and _THREE.match(data) is not None
    if page == "cp949":
        return len(text) >= 2 and len(_HANGUL.findall(text)) >= 0.9 * len(text)
    return len(text) >= 4 and sum(c in _HAN[page] for c in text) >= 0.1 * len(text)


def _bytes_of(part: str) -> bytes | None:
    table = _PAGES["cp1252"]
    if any(c > "\x7f" and c not in table and ord(c) > 0xFF for c in part):
        return None
    return bytes(ord(c) if ord(c) < 0x80 else table.get(c, ord(c)) for c in part)


def _east(part: str) -> str:
    """Double-byte text shown as Western characters, decoded where its pairs are whole and read as the page's language."""
    # Most pairs have no ASCII byte; of katakana in cp932, which may, the lead byte is one of two.
    if sum(len(r) for r in _RUN.findall(part) if len(r) > 1) < 3 and sum(map(part.count, "ƒ\x83‚\x82")) < 2 or (data := _bytes_of(part)) is None:
        return part
    best = (0, part)
    for page, automaton in _EAST_PAGES.items():
        out, at, won, tried = [], 0, 0, 0
        for m in automaton.finditer(data):
            try:
                text = m[0].decode(page)
            except UnicodeDecodeError:
                continue
            tried += len(m[0])
            if text.encode(page, "replace") == m[0] and _reads_as(page, text, m[0]):
                out += [part[at:m.start()], text]
                at, won = m.end(), won + len(m[0])
        # Words of Korean and Chinese are short: the line's other spans must read alike.
        if page in ("cp949", "gbk", "big5") and (won < 8 or won < 0.8 * tried):
            continue
        if won > best[0]:
            best = (won, "".join(out) + part[at:])
    return best[1]


def _pair_class(codec: str) -> str:
    """A pattern of a page's characters for a byte that leads a sequence and one that goes on with it."""
    of = lambda low, high: "".join(re.escape(c) for c, b in _PAGES[codec].items() if low <= b <= high)
    return f"[{of(0xC2, 0xF4)}][{of(0x80, 0xBF)}]"


_ANY_PAIR = re.compile("|".join(map(_pair_class, UTF8_MISREAD_AS)))


@lru_cache(maxsize=1 << 17)
def _well_formed(run: str) -> tuple[tuple[str, int], ...]:
    """By page, how many of a run's characters stand in well-formed spans, where any do."""
    if not _ANY_PAIR.search(run):
        return ()
    found = ((codec, sum(len(m[0]) for m in _WELL_FORMED.finditer(bytes(table.get(c, 0) for c in run)))) for codec, table in _PAGES.items())
    return tuple(x for x in found if x[1])


def _utf8_shares(line: str) -> dict[str, float]:
    """By page, the share of a line's characters above ASCII that stand in well-formed spans, for pages that have any."""
    n, out = 0, {}
    for run in _RUN.findall(line):
        n += len(run)
        if len(run) > 1:
            for codec, k in _well_formed(run):
                out[codec] = out.get(codec, 0) + k
    return {codec: k / n for codec, k in out.items()}


def _suspect(line: str) -> bool:
    """Whether a line that was decoded looks damaged still."""
    return any("\x80" <= c <= "\x9f" for c in line) or sum(c > "\x7f" for c in line) >= 4 and max(_utf8_shares(line).values(), default=0) >= 0.9


_LINES = re.compile(r"(\n)")


def _unread(text: str) -> list[str]:
    """Runs of Western letters that no Western word has: pairs of a page that none of the rules reads."""
    return [m[0] for m in _LATIN1_RUN.finditer(text) if sum("À" <= c <= "ÿ" and c not in "×÷" for c in m[0]) >= 4 and len(set(m[0])) > 2]


def _line(x: str) -> tuple[str, bool]:
    """A line with its multibyte spans decoded, of UTF-8 again and again, and whether nothing is left in it; a line that
    doesn't come out clean stays as it is."""
    if x.isascii():
        return x, True
    # Pairs of an East Asian page have some well-formed bytes by chance; of UTF-8 all are.
    shares = _utf8_shares(x)
    if max(shares.values(), default=0) < 0.9:
        if (y := _east(x)) != x:
            return y, True
        if not _CYR_WORD.search(x) and (y := _cyrillic_part(x)) != x:
            return y, True
        if any(max((k for _, k in _well_formed(r)), default=0) < len(r) for r in _unread(x)):
            return x, False
        if not shares:
            return x, True
    y = x
    while (z := _decode_spans(y)) != y:
        y = z
    if y == x:
        return x, True
    if not y.isascii():
        y = z if (z := _east(y)) != y or _CYR_WORD.search(y) else _cyrillic_part(y)
    return (x, False) if _suspect(y) else (y, True)


def _pages_swapped(text: str) -> str:
    out = []
    for x in _PART.split(text):
        if not x.isascii():
            y = _cyrillic_part(x)
            x = y if y != x or _unread(x) else _western_part(x)
        out.append(x)
    return "".join(out)


def _decode_spans(line: str) -> str:
    """One step: every run by the page that explains most of it, and among those by the page that explains most of the line."""
    runs = list(_RUN.finditer(line))
    n = sum(len(m[0]) for m in runs)
    shares = _utf8_shares(line)
    if not shares:
        return line
    # No correct text in Cyrillic is well-formed throughout: then what comes out may be anything, damaged text as well.
    sure = " ".join(c for c, share in shares.items() if share == 1 and n >= (12 if c == "cp866" else 6)) if n >= 6 else ""
    read = [_readings(m[0], line[m.start() - 1:m.start()], line[m.end():m.end() + 1], sure) if _well_formed(m[0]) else {} for m in runs]
    total = {c: [sum(r[c][k] for r in read if c in r) for k in (0, 2, 3)] for c in _PAGES}
    out, at = [], 0
    for m, r in zip(runs, read):
        if r:
            best = max(r, key=lambda c: (r[c][0], *total[c], -UTF8_MISREAD_AS.index(c)))  # noqa: B023
            out += [line[at:m.start()], r[best][1]]
            at = m.end()
    return "".join(out) + line[at:]


# Single characters that no rule above objects to, wherever they stand: a shortcut, not a rule.
_HARMLESS = frozenset("’–—…€→éïê") - _BETWEEN


def repair(text: str | None) -> tuple[bool, str | None, bool]:
    """(damaged, text with every restorable span restored, whether nothing damaged is left in it)."""
    if not text or text.isascii() or _HARMLESS.issuperset(_RUN.findall(text)):
        return False, text, True
    lines = [_line(x) for x in _LINES.split(text)]
    now = _pages_swapped("".join(x for x, _ in lines))
    lost = "\ufffd" in text or not all(clean for _, clean in lines) or bool(_unread(now))
    return lost or now != text, now, not lost


def repair_mojibake(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct damaged row of `df`: its id, `restored` text, and `whole`, false where damage is left: characters that
    are lost for good, or that no page explains.

    Rows with null or empty text never come out.  A row that occurs twice comes out once.  Other columns of `df` are
    not read.  The scan is a single narrow stage; only damaged rows are shuffled (for the distinct)."""
    kind = df.schema[id_col].dataType

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            take, new, whole = [], [], []
            for i, t in enumerate(texts):
                bad, r, w = repair(t)
                if bad:
                    take.append(i), new.append(r), whole.append(w)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), pa.array(new, pa.string()), pa.array(whole, pa.bool_())], [id_col, "restored", "whole"])

    rows = spread(df.select(F.col(id_col), F.col(text_col))).where(F.col(text_col).rlike("[^\\x00-\\x7F]"))
    out = rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, restored string, whole boolean")
    return out.dropDuplicates([id_col, "restored"])
