"""Personal information inside free text: found, and replaced by typed placeholders with linked pseudonyms."""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from datetime import date
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most name forms that a lexicon may have to be sent to every task.
LEXICON_BOUND = 200_000

KINDS = ("email", "phone", "id_number", "address", "person")

_GAP = r"(?:[^\S\n]{1,3})"  # blanks of any kind within a line
_LETTER = r"(?:[^\W\d_][\u0300-\u036f]*)"
_WORD = rf"(?:{_LETTER}+(?:['’]{_LETTER}+)?)"
_EDGE = r"(?<![\w\u0300-\u036f])"

# An address at a host: local part, sign, host. The sign and the dots may be spelled out.
_AT = r"(?:@|[^\S\n]@[^\S\n]|[^\S\n]?[\[(](?:at|arroba|chez)[\])][^\S\n]?)"
_DOT = r"(?:\.|[^\S\n]?[\[(](?:dot|punkt|point|punto)[\])][^\S\n]?)"
EMAIL = re.compile(rf"(?<![\w.+\-@])[\w+][\w.+\-]*(?<=[\w+]){_AT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+", re.I)

# Telephone numbers, by country. The last form takes any number with a country code.
_D = r"[ .\-/   ]"
_NO_DIGIT = r"(?<![\w+])(?<!\d[.,:/\-])"
_ENDS = r"(?![\d])(?![.,:/\-]\d)"
_EXT = rf"(?i:[^\S\n]?,?[^\S\n]?(?:ext|x|poste|Durchwahl|DW)\.?[^\S\n]?\d{{1,6}})?"
PHONE = re.compile(
    rf"{_NO_DIGIT}(?:"
    rf"(?:\+44|0044){_D}?(?:\(0\){_D}?)?\d{{2,5}}(?:{_D}?\d{{3,8}}){{1,2}}"
    rf"|0\d{{4}}{_D}\d{{6}}"
    rf"|(?:\+?1{_D})?(?:(?<=\()\d{{3}}\){_D}?|\(\d{{3}}\){_D}?|\d{{3}}{_D})\d{{3}}{_D}\d{{4}}"
    rf"|(?:\+33|0033){_D}?(?:\(0\){_D}?)?[1-9](?:{_D}?\d\d){{4}}"
    rf"|0[1-9](?:{_D}\d\d){{4}}|0[1-9]\d\d(?:{_D}\d\d){{3}}"
    rf"|(?:\+49|0049){_D}?(?:\(0\){_D}?)?\d{{2,5}}{_D}?\d{{3,9}}(?:{_D}\d{{1,5}})?"
    rf"|0\d{{2,4}}/\d{{5,9}}(?:-\d{{1,5}})?"
    rf"|(?:\+34|0034){_D}?\d{{3}}(?:{_D}?\d{{2,3}}){{2,3}}|[6-9]\d\d(?:{_D}\d\d){{3}}|[6-9]\d\d(?:{_D}\d{{3}}){{2}}"
    rf"|\+\d{{1,3}}(?:{_D}?\(?\d{{1,6}}\)?){{2,6}}"
    rf"){_ENDS}{_EXT}"
)

# Identity numbers follow what they are: the kind of document, then the number.
_ID_CUE = (
    r"ID|I\.D\.|identity[^\S\n]card|identity|social[^\S\n]security|national[^\S\n]insurance|SSN|tax|TIN|passport|driving[^\S\n]licen[cs]e|driver'?s[^\S\n]licen[cs]e"
    r"|Ausweis|Personalausweis|Ausweisnummer|Personalausweisnummer|Sozialversicherung|Sozialversicherungsnummer|Steuernummer|Steuer-ID|Steuer-Identifikationsnummer|Reisepass|Reisepassnummer|Pass|Führerschein|Führerscheinnummer|Führerschein"
    r"|identité|identité|carte[^\S\n]d['’]identité|sécurité[^\S\n]sociale|sécurité[^\S\n]sociale|fiscal|passeport|permis[^\S\n]de[^\S\n]conduire|permis"
    r"|identidad|DNI|NIE|NIF|seguridad[^\S\n]social|fiscal|pasaporte|permiso[^\S\n]de[^\S\n]conducir|carné[^\S\n]de[^\S\n]conducir|carnet[^\S\n]de[^\S\n]conducir"
)
_ID_LINK = r"(?:[^\S\n]?(?:no|nr|num|number|nummer|numéro|numero|número|card|n)\.?[º°]?(?!\w))?(?:[^\S\n]?[:=]|[^\S\n](?:is|lautet|ist|est|es)(?!\w))?"
ID_NUMBER = re.compile(
    rf"{_EDGE}(?:{_ID_CUE})(?!\w){_ID_LINK}[^\S\n]{{0,3}}(?P<value>(?:[A-Z]{{1,3}}[ -]?)?\d(?:[ .\-]?\d+)*(?:-?[A-Z](?![\w]))?)", re.I
)

# Street addresses, by the way in which street, number and town follow each other.
_TOWN = rf"{_WORD}(?:-{_WORD})?"
_POST = rf"(?:,?{_GAP}\d{{4,5}}{_GAP}{_TOWN})?"
_STREET_ENDS = ("str.", "straße", "strasse", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer", "markt")
#: Each form of address, after words in lower case of which a text must hold one, or a pattern that it must hold; None
#: stands for the ends of German street names before a number.
ADDRESSES = (
    (
        re.compile(r"[^\S\n](?:Road|Lane|Street|Avenue|Drive|Court|Boulevard|St|Rd|Ave)(?!\w)", re.I),
        re.compile(
            rf"{_EDGE}(?:(?:Flat|Apt\.?|Apartment|Unit|Suite){_GAP}\d+[a-z]?,{_GAP})?\d{{1,4}}[a-z]?{_GAP}(?P<street>{_WORD}(?:[- ]{_WORD})?){_GAP}"
            rf"(?:(?:Road|Lane|Street|Avenue|Drive|Court|Boulevard)(?!\w)|(?:St|Rd|Ave)(?:\.|(?!\w)))"
            rf"(?:(?:,{_GAP}\d{{4,5}}{_GAP}|(?<=Lane),{_GAP}|(?<=LANE),{_GAP}|(?<=lane),{_GAP}){_TOWN})?",
            re.I,
        ),
    ),
    (
        ("rue", "avenue", "boulevard", "place", "chemin", "all", "impasse", "quai", "route", "cours"),
        re.compile(
            rf"{_EDGE}\d{{1,4}}(?:{_GAP}(?:bis|ter|quater))?,?{_GAP}(?:rue|avenue|boulevard|place|chemin|all(?:é|e\u0301|e)e|impasse|quai|route|cours){_GAP}"
            rf"(?:(?:de{_GAP}la|des|de|du){_GAP}|d['’]|de{_GAP}l['’])?{_WORD}(?:-{_WORD})*{_POST}",
            re.I,
        ),
    ),
    (
        ("calle", "c/", "avda", "av.", "avenida", "plaza", "paseo"),
        re.compile(
            rf"{_EDGE}(?:Calle|C/|Avda\.|Av\.|Avenida|Plaza|Paseo){_GAP}?(?:(?:de{_GAP}la|de{_GAP}los|del|de){_GAP})?{_WORD}(?:[ -]{_WORD}){{0,2}}?,?{_GAP}"
            rf"(?:n\.?[º°]?{_GAP}?)?\d{{1,4}}[a-z]?(?:,{_GAP}\d{{1,2}}\.?[º°ª]{_GAP}?[A-Z]?(?!\w))?{_POST}",
            re.I,
        ),
    ),
    (
        None,
        re.compile(
            rf"{_EDGE}(?:Am|An{_GAP}der|Im|In{_GAP}der|Zum|Zur|Auf{_GAP}der|Auf{_GAP}dem){_GAP}{_WORD}{_GAP}(?:Platz|Weg|Ring|Allee|Markt|Ufer|Damm|Straße|Strasse)"
            rf"{_GAP}\d{{1,4}}(?:[a-z](?!\w))?{_POST}",
            re.I,
        ),
    ),
    (
        None,
        re.compile(rf"{_EDGE}{_WORD}(?:str\.|straße|strasse|weg|platz|allee|gasse|ring|damm|ufer){_GAP}?\d{{1,4}}(?:[a-z](?!\w))?{_POST}", re.I),
    ),
)

#: Words that stand before a name and are no part of one, and others that end like given names.
NO_GIVEN = frozenset(
    "the der die das den dem des la le les el los las un una une eine ein una premio empresa sociedad compañía casa société prix firma preis "
    "notre unser nuestro our her his para pour für von van de du di del und et y e and a o zu con avec mit in im il elle "
    "sra sr mme mlle herr frau don doña señora señor dottor dottore el escuela biblioteca museo vecino".split()
)
NO_FAMILY = frozenset("mardi inhabituelle nouvelle laquelle quelle belle elle annuelle actuelle habituelle".split())
_SMALL = frozenset("the on in of at by to for from and or near behind between a an is was der die das auf in bei la le les de du el los en".split())
_TITLES = frozenset("dr prof mr mrs ms miss sir herr frau mme mlle m sr sra don doña herrn fräulein maître".split())
_PARTICLES = frozenset("von van de der den di da del du la le zu ten ter af".split())
_CAPITAL = rf"(?:[^\W\d_a-zß-öø-ÿ][\u0300-\u036f]*{_LETTER}+)"
_TITLED_NAME = re.compile(
    rf"{_EDGE}(?:Dr|Prof|Mr|Mrs|Ms|Miss|Herrn?|Frau|Mme|Mlle|Sra?)\.?{_GAP}(?:Dr\.?{_GAP}|Prof\.?{_GAP})*(?P<name>(?:{_CAPITAL}\.?{_GAP}|(?:von|van|de|del|di|da){_GAP}){{0,2}}{_CAPITAL}(?:-{_CAPITAL})?)(?!\w)"
)
_ORGANISATION = re.compile(
    rf"(?:[^\S\n]?-|[^\S\n]+)(?:&|Preis|prize|award|GmbH|Ltd|Inc|AG|KG|SA|SL|SARL|Institut|Institute|Stiftung|foundation|company|und[^\S\n]Partner|et[^\S\n]associés|y[^\S\n]asociados)(?![\w])", re.I
)


class Found(NamedTuple):
    start: int
    end: int
    kind: str


def endings(forms: Iterable[str], shortest: int, longest: int, support: int) -> list[str]:
    """Endings that names share: for each form, of those with enough support, the one that the most forms have, weighted by its length."""
    forms = {f.lower() for f in forms}
    counts = Counter(f[-n:] for f in forms for n in range(shortest, longest + 1) if len(f) > n + 1)
    kept: set[str] = set()
    for f in forms:
        own = [f[-n:] for n in range(shortest, longest + 1) if len(f) > n + 1 and counts[f[-n:]] >= support]
        if own:
            kept.add(max(own, key=lambda e: (counts[e] * (len(e) - shortest + 1), len(e))))
    return sorted(kept, key=lambda e: (-len(e), e))


class Finder:
    """Finds personal information. ``lexicon`` gives some names in use as ``(form, kind)`` with kind ``given`` or ``family``.

    Names that the lexicon lacks are known by endings that its names share. A family name counts as a person only
    together with a given name, an initial or a title, which keeps firms, prizes and places out.
    """

    def __init__(self, lexicon: Iterable[tuple[str, str]]):
        rows = [(_nfc(f).lower(), k) for f, k in lexicon if f and k]
        self.family = frozenset(f for f, k in rows if k == "family")
        self.given = frozenset(f for f, k in rows if k == "given")
        self.family_ends = tuple(endings(self.family, 3, 6, max(3, len(self.family) // 50)))
        self.other_families = tuple(sorted(f for f in self.family if not f.endswith(self.family_ends)))
        self.given_ends = tuple(endings(self.given, 1, 4, max(2, len(self.given) // 50)))

    def _given_like(self, word: str, any_case: bool) -> bool:
        if not any_case and not word[0].isupper():
            return False
        w = _nfc(word).lower()
        if w in self.given:
            return True
        # Without capitals to go by, an ending of one letter says too little.
        ends = tuple(e for e in self.given_ends if len(e) > 1) if any_case else self.given_ends
        return len(w) >= 4 and w not in NO_GIVEN and w not in self.family and bool(ends) and w.endswith(ends)

    def _family_like(self, word: str, any_case: bool) -> bool:
        if not any_case and not word[0].isupper():
            return False
        w = _nfc(word).lower()
        return w in self.family or (len(w) >= 5 and w not in NO_FAMILY and bool(self.family_ends) and w.endswith(self.family_ends))

    def persons(self, text: str, taken: list[Found]) -> list[Found]:
        any_case = not any(c.isupper() for c in text)
        words = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
        out: list[Found] = []
        free = 0
        for i, (begin, end, word) in enumerate(words):
            if begin < free or not self._family_like(word, any_case):
                continue
            if _inside(taken, begin, end):
                continue
            last = i
            # A double family name, joined by a hyphen.
            if i + 1 < len(words) and text[end : words[i + 1][0]] == "-" and self._family_like(words[i + 1][2], any_case):
                last = i + 1
            stop = words[last][1]
            if _ORGANISATION.match(text, stop):
                continue
            start = self._start(text, words, i, free, any_case)
            if start is None and last + 1 < len(words) and re.fullmatch(rf",{_GAP}", text[stop : words[last + 1][0]]):
                nb, ne, nw = words[last + 1]
                if self._given_like(nw, any_case) and not _inside(taken, nb, ne) and not self._family_follows(text, words, last + 1, any_case):
                    start, stop = begin, ne
                    more = re.compile(rf"{_GAP}{_LETTER}\.").match(text, ne)
                    stop = more.end() if more and not more.group()[-2].islower() else stop
                elif len(_nfc(nw)) == 1 and text[ne : ne + 1] == ".":
                    start, stop = begin, ne + 1
            if start is None and self._titled(text, words, i):
                start = begin
            if start is not None and not _inside(taken, start, stop):
                out.append(Found(start, stop, "person"))
                free = stop
        if not any_case:
            # A title tells a name that neither the lexicon nor its endings know.
            for m in _TITLED_NAME.finditer(text):
                begin, stop = m.span("name")
                if not _inside(taken, begin, stop) and not _inside(out, begin, stop) and not _ORGANISATION.match(text, stop):
                    out.append(Found(begin, stop, "person"))
        return out

    def _family_follows(self, text: str, words: list, i: int, any_case: bool) -> bool:
        return i + 1 < len(words) and bool(re.fullmatch(_GAP, text[words[i][1] : words[i + 1][0]])) and self._family_like(words[i + 1][2], any_case)

    def _start(self, text: str, words: list, i: int, free: int, any_case: bool) -> int | None:
        """Where the name before a family name begins, if there is one."""
        at, start, initials, particles = i, None, 0, 0
        while at > 0:
            b, e, w = words[at - 1]
            between = text[e : words[at][0]]
            if b < free:
                break
            n = len(_nfc(w))
            if n == 1 and re.fullmatch(rf"\.{_GAP}?", between) and (any_case or w[0].isupper()) and initials < 3:
                initials, start = initials + 1, b
            elif re.fullmatch(_GAP, between) and w.lower() in _PARTICLES and not initials and particles < 3 and start is None:
                particles += 1
            elif re.fullmatch(_GAP, between) and self._given_like(w, any_case):
                # A second given name may stand before it.
                if at > 1 and re.fullmatch(_GAP, text[words[at - 2][1] : b]) and _nfc(words[at - 2][2]).lower() in self.given and words[at - 2][0] >= free and (any_case or words[at - 2][2][0].isupper()):
                    return words[at - 2][0]
                return b
            else:
                break
            at -= 1
        return start

    @staticmethod
    def _titled(text: str, words: list, i: int) -> bool:
        return i > 0 and words[i - 1][2].lower() in _TITLES and bool(re.fullmatch(rf"\.?{_GAP}", text[words[i - 1][1] : words[i][0]]))

    @staticmethod
    def _street(name: str, any_case: bool) -> bool:
        """A street's own name: capitalised words where the text has capitals at all, and no small words."""
        parts = re.split(r"[- ]", name)
        return all((any_case or p[0].isupper()) and p.lower() not in _SMALL for p in parts)

    def find(self, text: str, dates: bool = False) -> list[Found]:
        """All findings in a text, in order, without overlaps. Positions count code points."""
        out: list[Found] = []
        if not text:
            return out
        any_case = not any(c.isupper() for c in text)
        if any(c in text for c in "@[("):
            out += [Found(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
        lower = text.lower()
        numbers = [m.start() for m in _DIGITS.finditer(text)]
        if numbers:
            for m in ID_NUMBER.finditer(text):
                begin, end = m.span("value")
                if sum(c.isdigit() for c in text[begin:end]) >= 5 and not _inside(out, begin, end):
                    out.append(Found(begin, end, "id_number"))
            german = len(lower) != len(text) or any(lower[max(0, i - 10) : i].rstrip().endswith(_STREET_ENDS) for i in numbers)
            for words, pattern in ADDRESSES:
                if not (german if words is None else words.search(text) if isinstance(words, re.Pattern) else any(w in lower for w in words)):
                    continue
                for m in pattern.finditer(text):
                    street = m.groupdict().get("street")
                    if (street is None or self._street(street, any_case)) and not _inside(out, *m.span()):
                        out.append(Found(m.start(), m.end(), "address"))
            for m in PHONE.finditer(text):
                begin, end = m.span()
                begin += text[begin] == "("
                if not _inside(out, begin, end):
                    out.append(Found(begin, end, "phone"))
            if dates:
                out += [Found(m.start(), m.end(), "date") for m in DATE.finditer(text) if not _inside(out, *m.span())]
        if any(e in lower for e in self.family_ends) or any(f in lower for f in self.other_families) or not text.isascii() or _TITLED_NAME.search(text):
            out += self.persons(text, out)
        return sorted(out)


_ASCII_DIGITS = frozenset("0123456789")
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(rf"{_LETTER}+")


def _nfc(x: str) -> str:
    return unicodedata.normalize("NFC", x)


def _inside(taken: list[Found], begin: int, end: int) -> bool:
    return any(f.start < end and begin < f.end for f in taken)


def _rounds(key: bytes, tweak: str, side: int, half: int, modulus: int) -> int:
    data = f"{tweak}|{side}|{half}".encode()
    return int.from_bytes(hmac.new(key, data, hashlib.sha256).digest()[:16], "big") % modulus


def feistel(value: int, size: int, key: bytes, tweak: str, backwards: bool = False) -> int:
    """A keyed permutation of ``0..size-1``: ten unbalanced rounds over two halves, walked again while outside the range."""
    if size < 2:
        return value
    left = max(2, int(size**0.5))
    right = -(-size // left)
    steps = range(9, -1, -1) if backwards else range(10)
    while True:
        a, b = divmod(value, right)
        for i in steps:
            sign = -1 if backwards else 1
            if i % 2:
                b = (b + sign * _rounds(key, tweak, i, a, right)) % right
            else:
                a = (a + sign * _rounds(key, tweak, i, b, left)) % left
        value = a * right + b
        if value < size:
            return value


# ---------------------------------------------------------------- pseudonyms that keep the format


def _permuted(digits: str, lowest: Sequence[int], counts: Sequence[int], key: bytes, tweak: str, backwards: bool = False) -> str:
    """Digits permuted within a number plan: at each place so many digits from the lowest on may stand."""
    n = 0
    for c, low, count in zip(digits, lowest, counts):
        n = n * count + int(c) - low
    n = feistel(n, math.prod(counts), key, tweak, backwards)
    out = []
    for low, count in zip(reversed(lowest), reversed(counts)):
        n, r = divmod(n, count)
        out.append(str(r + low))
    return "".join(reversed(out))


def _plain_digits(digits: str, key: bytes, kind: str, backwards: bool = False) -> str:
    """Any digits: leading zeros stay, and the first digit after them stays none."""
    zeros = len(digits) - len(digits.lstrip("0"))
    rest = digits[zeros:]
    if not rest:
        return digits
    return digits[:zeros] + _permuted(rest, [1] + [0] * (len(rest) - 1), [9] + [10] * (len(rest) - 1), key, f"{kind}|d{len(rest)}", backwards)


#: Country codes of one and two digits; all others have three (fixed values of the public numbering plan).
_SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NATIONAL = re.compile(r"(?:\+|(?<![0-9])00)[ .\-/]?([0-9]{1,3})")
_NORTH_AMERICAN = re.compile(r"[2-9][0-9]{2}[2-9][0-9]{6}")
_EXTENSION = re.compile(r"(?i)(?:ext|x|poste|durchwahl|dw)\.?\s?([0-9]{1,6})$")


def pseudonym_phone(value: str, key: bytes, backwards: bool = False) -> str:
    """A telephone number of the same country and form: country code, trunk zeros and punctuation stay.

    A number that is valid in the plan of its country code 1, or is written like one, gives a valid one. The national
    digits are permuted alike with and without a country code, so one number in several spellings stays one. An
    extension is permuted by itself.
    """
    more = _EXTENSION.search(value)
    body, tail = (value[: more.start(1)], value[more.start(1) :]) if more else (value, "")
    fixed, country = 0, ""
    code = _NATIONAL.match(body)
    if code:
        digits = code.group(1)
        country = next((digits[:n] for n in (1, 2) if digits[:n] in _SHORT_CODES), digits)
        fixed = code.start(1) + len(country)
    elif re.match(r"1[ .\-/](?:\(?[2-9])", body):
        fixed, country = 1, "1"
    national = "".join(c for c in body[fixed:] if c in _ASCII_DIGITS)
    if country in ("", "1") and _NORTH_AMERICAN.fullmatch(national):
        new = _permuted(national, [2, 0, 0, 2, 0, 0, 0, 0, 0, 0], [8, 10, 10, 8, 10, 10, 10, 10, 10, 10], key, "phone|1", backwards)
    else:
        new = _plain_digits(national, key, "phone", backwards)
        while country in ("", "1") and _NORTH_AMERICAN.fullmatch(new):
            new = _plain_digits(new, key, "phone", backwards)
    tail_new = _plain_digits(tail, key, "extension", backwards) if tail else ""
    left = iter(new)
    return body[:fixed] + "".join(next(left) if c in _ASCII_DIGITS else c for c in body[fixed:]) + tail_new


#: Check letters of Spanish identity numbers, by the remainder (fixed values).
_SPANISH = "TRWAGMYFPDXBNJZSQVHLCKE"
_FOREIGN = str.maketrans("XYZ", "012")


def _steuer_check(digits: str) -> str:
    """Check digit of a German tax number's first ten digits (ISO 7064, mod 11,10)."""
    p = 10
    for c in digits:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return str((11 - p) % 10)


def _social_security(digits: str) -> int | None:
    """The place of a US social security number among the valid ones, or None."""
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    return ((area - 1 - (area > 666)) * 99 + group - 1) * 9_999 + serial - 1


def _valid_as(bare: str, written_as_us: bool) -> str | None:
    """The kind of identity number, if any, whose check ``bare`` passes."""
    if re.fullmatch(r"[XYZ0-9][0-9]{7}[A-Z]", bare) and _SPANISH[int(bare[:8].translate(_FOREIGN)) % 23] == bare[8]:
        return "es"
    if re.fullmatch(r"[12][0-9]{14}", bare) and int(bare[13:]) == 97 - int(bare[:13]) % 97:
        return "fr"
    if re.fullmatch(r"[1-9][0-9]{10}", bare) and _steuer_check(bare[:10]) == bare[10]:
        return "de"
    if written_as_us and _social_security(bare) is not None:
        return "us"
    return None


def _any_form(bare: str, key: bytes, backwards: bool) -> str:
    """Digits permuted as one number, and letters as another."""
    digits, letters = "".join(c for c in bare if c.isdigit()), "".join(c for c in bare if not c.isdigit())
    left = iter(_permuted(digits, [0] * len(digits), [10] * len(digits), key, f"id|d{len(digits)}", backwards)) if digits else iter("")
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 65
    n, out = feistel(n, 26 ** len(letters), key, f"id|l{len(letters)}", backwards), []
    for _ in letters:
        n, r = divmod(n, 26)
        out.append(chr(65 + r))
    right = iter(reversed(out))
    return "".join(next(left) if c.isdigit() else next(right) for c in bare)


def pseudonym_id(value: str, key: bytes, backwards: bool = False) -> str:
    """An identity number of the same form. One that is valid gives a valid one: its check digits are made anew.

    Known are Spanish identity numbers (check letter), French social security numbers (two check digits), German tax
    numbers (check digit) and US social security numbers (ranges). All others, and what does not pass its check, have
    digits and letters permuted until the result does not pass one either; blanks, marks and case stay, and the same
    number with others gets the same digits.
    """
    bare = "".join(c for c in value if c.isascii() and c.isalnum()).upper()
    us = re.fullmatch(r"[0-9]{3}([ -])[0-9]{2}\1[0-9]{4}", value) is not None
    kind = _valid_as(bare, us)
    if kind == "es":
        first = bare[0] if bare[0] in "XYZ" else ""
        digits = bare[len(first) : 8]
        new = first + _permuted(digits, [0] * len(digits), [10] * len(digits), key, f"es|{bool(first)}", backwards)
        new += _SPANISH[int(new.translate(_FOREIGN)) % 23]
    elif kind == "fr":
        new = _permuted(bare[:13], [1] + [0] * 12, [2] + [10] * 12, key, "fr", backwards)
        new += f"{97 - int(new) % 97:02d}"
    elif kind == "de":
        new = _permuted(bare[:10], [1] + [0] * 9, [9] + [10] * 9, key, "de", backwards)
        new += _steuer_check(new)
    elif kind == "us":
        at, serial = divmod(feistel(_social_security(bare), 898 * 99 * 9_999, key, "us", backwards), 9_999)
        area, group = divmod(at, 99)
        new = f"{area + 1 + (area + 1 >= 666):03d}{group + 1:02d}{serial + 1:04d}"
    else:
        new = _any_form(bare, key, backwards)
        while new != bare and _valid_as(new, us):
            new = _any_form(new, key, backwards)
    made = iter(new)
    return "".join((lambda d: d.lower() if c.islower() else d)(next(made)) if c.isascii() and c.isalnum() else c for c in value)


_DAYS = (date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal())
DATE = re.compile(r"(?<![0-9./-])(?:([0-9]{4})(-)([0-9]{2})-([0-9]{2})|([0-9]{1,2})([./])([0-9]{1,2})\6([0-9]{4}))(?![0-9])(?![./-][0-9])")


def pseudonym_date(value: str, key: bytes, backwards: bool = False) -> str:
    """A date of the same form, from 1900 to 2099; what is no date stays as it is."""
    m = DATE.fullmatch(value)
    if not m:
        return value
    y, mo, d = (m[1], m[3], m[4]) if m[2] else (m[8], m[7], m[5])
    try:
        at = date(int(y), int(mo), int(d)).toordinal() - _DAYS[0]
    except ValueError:
        return value
    if not 0 <= at < _DAYS[1] - _DAYS[0]:
        return value
    new = date.fromordinal(feistel(at, _DAYS[1] - _DAYS[0], key, "date", backwards) + _DAYS[0])
    return f"{new:%Y-%m-%d}" if m[2] else f"{new:%d}{m[6]}{new:%m}{m[6]}{new:%Y}"


#: First of the 16,384 ideographs that codes are written in. They are letters, and no change of case or form alters them.
_CODE_FIRST = 0x4E00


def linked_code(value: str, key: bytes, kind: str) -> str:
    """Six characters that equal values of free form share: a keyed hash of the value without case, marks and blanks.

    Each character bears 14 bits, so that different values stay distinct: a billion values of a kind have about
    3e-8 colliding pairs to expect.
    """
    plain = unicodedata.normalize("NFKD", value).casefold()
    plain = "".join(c for c in plain if c.isalnum())
    n = int.from_bytes(hmac.new(key, f"{kind}|{plain}".encode(), hashlib.sha256).digest(), "big")
    return "".join(chr(_CODE_FIRST + (n >> 14 * i) % 2**14) for i in range(6))


def masked(text: str, found: list[Found], key: bytes) -> str:
    """The text with a typed placeholder for each finding and everything else as it was."""
    out, at = [], 0
    for f in found:
        value = text[f.start : f.end]
        if f.kind == "id_number":
            code = pseudonym_id(value, key)
        elif f.kind == "phone":
            code = pseudonym_phone(value, key)
        elif f.kind == "date":
            code = pseudonym_date(value, key)
        else:
            code = linked_code(value, key, f.kind)
        out += [text[at : f.start], f"[{f.kind.upper()} {code}]"]
        at = f.end
    return "".join([*out, text[at:]])


def _lexicon(names: DataFrame) -> list[tuple[str, str]]:
    rows = names.select(F.col("name_form").cast("string"), F.col("kind").cast("string")).dropna().distinct().limit(LEXICON_BOUND + 1).collect()
    if len(rows) > LEXICON_BOUND:
        raise ValueError(f"a lexicon of more than {LEXICON_BOUND} forms is too large to send to every task")
    return [(r[0], r[1]) for r in rows]


def find_personal(docs: DataFrame, names: DataFrame, key: str, dates: bool = False) -> DataFrame:
    """Find and replace email addresses, phone numbers, identity numbers, street addresses and names in whole texts.

    ``docs`` has ``doc_id BIGINT, text STRING``; ``names`` has ``name_form, kind`` and at most ``LEXICON_BOUND`` rows.
    Returns ``doc_id, masked STRING, found ARRAY<STRUCT<kind, start_pos, end_pos>>``, one row per row of ``docs``.

    In ``masked`` each finding is a placeholder such as ``[PHONE +49 40 118377]``. Numbers are pseudonyms of the same
    form and, if they are valid, again valid ones, made by a keyed Feistel permutation, so equal numbers stay linked
    across documents; emails, addresses and names carry a keyed code instead, which links them likewise. With ``dates``
    dates are found and permuted as well. All other text is unchanged. Whoever has ``key`` can undo the numbers, so it
    is a secret: there is no default, and an empty one is an error.

    A null text gives null and an empty list, an empty one the same text. Texts are handled row by row in Arrow
    batches in one narrow pass, so nothing is shuffled, and length, repeats and empty tables need no care. Extra columns are
    ignored.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    lexicon = _lexicon(names)
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [finder.find(t, dates) if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([masked(t, f, secret) if f else t for t, f in zip(texts, found)], pa.string()),
                    pa.array([[{"kind": x.kind, "start_pos": x.start, "end_pos": x.end} for x in f] for f in found], kind),
                ],
                names=["doc_id", "masked", "found"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, masked string, found array<struct<kind: string, start_pos: bigint, end_pos: bigint>>"
    )
