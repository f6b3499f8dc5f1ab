"""Personal data in free text by anchor expansion.

One Aho-Corasick pass over a text (lower case, every digit read as 0) finds anchors: at-signs and
their spelled forms, number shapes, labels of identity numbers, street words and parts of names.
A local parser for each kind of anchor then expands it to both sides, fixes the boundaries and
validates what it has read. Where spans overlap, the kind listed first in ``KINDS`` holds.

Parts of names come from a list. As no list is complete, it is widened by its own word formation:
a beginning and an ending that each occur in many listed parts of one kind make a part together.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.durable import spread
from gridloom.llm.tokenizer import text_chunks

KINDS = ("email", "id_number", "phone", "account_number", "street_address", "person_name")

# Forms of the at-sign, labels of numbers of persons, and words for streets.
AT = ("@", "(at)", "[at]", "{at}", "<at>", " at ")
ID_LABELS = (
    "ssn", "social security", "soc. sec", "civil number", "civil registration", "personal id", "personal number", "id no", "id number",
    "identity number", "national id", "passport", "reisepass", "passnummer", "passeport", "pasaporte", "passaporte", "ausweis",
    "tax number", "tax id", "tin", "steuer-id", "steueridentifikationsnummer", "steuernummer", "numéro fiscal", "dni", "nif", "nie", "cpf", "nir",
    "documento", "insurance no", "insurance number", "national insurance", "ni number", "versicherungsnummer", "sozialversicherungsnummer",
    "numéro de sécurité sociale", "n° de sécurité sociale", "sécurité sociale", "seguridad social", "personnummer", "cpr",
)
STREETS_AFTER = ("street", "st", "road", "rd", "avenue", "ave", "boulevard", "blvd", "lane", "ln", "close", "drive", "dr", "court", "ct", "place", "pl", "terrace", "crescent", "square", "sq", "parade", "mews", "highway", "hwy", "parkway", "pkwy")
STREETS_BEFORE = ("rue", "avenue", "boulevard", "bd", "chemin", "impasse", "quai", "allée", "place", "route", "cours", "square")
STREETS_FIRST = ("calle", "c/", "avda", "avenida", "av", "plaza", "pza", "paseo", "camino", "ronda", "rua", "travessa", "praça", "largo", "alameda", "via", "piazza", "viale")
STREET_ENDINGS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer")
LINKING = ("de", "del", "da", "do", "dos", "das", "di", "du", "van", "von", "der", "den", "la", "le", "y", "e")

_WORD = "\\p{L}\\p{M}"
_GLUE = r"(?:\.|\s?[(\[{<]\s?(?:dot|punkt|punto|point|ponto)\s?[)\]}>]\s?| dot )"
_DOMAIN = regex.compile(rf"[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])?(?:{_GLUE}[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])?)+", regex.I)
_GLUED = regex.compile(_GLUE, regex.I)

_SPACE = "[    ]"
_SEP = f"(?:{_SPACE}|[-.‐‑–/])"
_PHONES = [
    # International: + or 00, then groups of digits, a trunk (0) among them.
    regex.compile(rf"(?:\+|00)\d{{1,5}}(?:{_SEP}?\(\d{{1,4}}\))?(?:{_SEP}?\d{{1,7}}){{1,7}}"),
    # Trunk 0 in or without brackets.
    regex.compile(rf"\(0\d{{1,4}}\)(?:{_SEP}?\d{{2,7}}){{1,4}}|0\d{{1,4}}(?:{_SEP}\d{{2,7}}){{1,4}}"),
    # Three, three and four digits, the area code in or without brackets, a leading 1 or none.
    regex.compile(rf"(?:1{_SEP})?(?:\(\d{{3}}\){_SPACE}?\d{{3}}{_SEP}\d{{4}}|\d{{3}}(?P<s>[-.]|{_SPACE})\d{{3}}(?P=s)\d{{4}})"),
    # Nine digits in a Spanish grouping.
    regex.compile(rf"[6789]\d{{2}}{_SPACE}\d{{2}}{_SPACE}\d{{2}}{_SPACE}\d{{2}}|[6789]\d{{2}}{_SPACE}\d{{3}}{_SPACE}\d{{3}}(?=\s*(?:ext|$|[;,|)]))"),
]
_PHONE_SHAPES = ("+0", "00", "(0", "0-000-", "0.000.", "0 000 ", "0 000", "0 (000", "0/000", "00.00.00", "00 00 00")

_NUMBER_OF_PERSON = regex.compile(
    r"\d{3}-\d{2}-\d{4}|\d{6}[-+]\d{4}|\d{2}\.?\d{3}\.?\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,2}\d{6,8}[A-Z]?"
    r"|\d{2} \d{3} \d{3} \d{3}|\d{3}\.\d{3}\.\d{3}-\d{2}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?|\d{3} \d{2} \d{4}|\d{2,3}(?: \d{3}){2,3}|\d{8,13}|[A-Z0-9]{9,11}(?<=\d[A-Z0-9]*)"
)
_AFTER_LABEL = regex.compile(r"[ \t]*(?:security)?[ \t]*(?:(?:no|nr|num|number|nummer|n[º°]|id|#)\b\.?|número|numéro)?[ \t]*(?:is|ist|es|est|é)?[ \t]*[.:#=]?[ \t]*", regex.I)
# Numbers that are told by their form alone, at or just before their anchor's start.
_BARE_ID = [regex.compile(r"\d{3}-\d{2}-\d{4}"), regex.compile(r"\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])-\d{4}"), regex.compile(r"[A-Z]{2} ?\d{2} \d{2} \d{2} ?[A-D]")]
_ACCOUNT_SHAPES = ("00 ", "00-", "0000")
_BARE_SHAPES = ("000-00-0000", "000000-0000", "00 00 00 ")

# Account numbers: two capitals and two digits, then groups of capitals and digits; or groups of digits.
_IBAN = regex.compile(r"[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}")
_CARD = regex.compile(r"\d{4}(?:[ -]?\d{2,4}){2,4}[ -]?\d{1,4}|\d{13,19}")

_EN_NUMBER = regex.compile(r"(?<![\w.,/-])\d{1,5}(?:-?[A-Z])?,? \Z")
_NAME_CHAR = regex.compile(rf"[{_WORD}'’-]")
_EN_NAME = regex.compile(rf"\d{{1,5}}(?:-?[A-Z])?,? (?:\p{{Lu}}[{_WORD}'’-]* )+\Z")
_FR_NUMBER = regex.compile(r"(?<![\w.,/-])\d{1,4}(?: ?(?:bis|ter|quater)| ?[A-Za-z])?,? \Z", regex.I)
_NAMED = rf"\p{{Lu}}[{_WORD}]*(?:['’-][{_WORD}]+)*"
_FR_NAME = regex.compile(rf" (?:(?:de la|de l['’]|des|du|de|d['’]) ?)?{_NAMED}(?:(?: (?:de la|des|du|de|et|sur|en))? {_NAMED}){{0,3}}")
_HOUSE = regex.compile(r",? (?:n[º°]\.? ?)?(\d{1,4}(?: ?[a-z](?![\w]))?)(?![\w])", regex.I)
_ES_NAME = regex.compile(rf"\.? ?(?:(?:de los|de las|de la|del|de|da|do|dos|das) )?{_NAMED}(?:(?: (?:de la|del|de|y|da|do|dos))? {_NAMED}){{0,3}}")
_LETTER = regex.compile(rf"[{_WORD}]")
_DE_HOUSE = regex.compile(r" \d{1,4}(?: ?[a-z](?![\w]))?(?![\w])")

_INITIAL = rf"\p{{Lu}}\.(?:[ -]?\p{{Lu}}\.){{0,2}}"
_BEFORE_INITIAL = regex.compile(rf"(?<![{_WORD}\p{{N}}.@]){_INITIAL} ?\Z")
_AFTER_INITIAL = regex.compile(rf" {_INITIAL}")
_INVERTED_INITIAL = regex.compile(rf", {_INITIAL}(?![{_WORD}])")
_LINK = regex.compile(rf" (?:(?:{'|'.join(LINKING)}) ){{1,3}}")


def widen(parts: Sequence[tuple[str, str]], least: int = 5) -> tuple[dict[str, set[str]], set[str]]:
    """Kinds (``given``, ``family``) of each part in lower case, listed or formed like many listed ones.

    A beginning and an ending of two letters or more form a part if each occurs with at least
    ``least`` other ends among the listed parts of the kind. Also returns the listed parts that
    aren't formed so; these may be ordinary words.
    """
    kinds: dict[str, set[str]] = defaultdict(set)
    odd: set[str] = set()
    by_kind: dict[str, set[str]] = defaultdict(set)
    for part, kind in parts:
        if part and kind:
            by_kind[kind].add(part.lower())
    for kind, known in by_kind.items():
        ends, starts = defaultdict(set), defaultdict(set)
        for w in known:
            for i in range(2, len(w) - 1):
                ends[w[:i]].add(w[i:])
                starts[w[i:]].add(w[:i])
        good_ends = {e for e, s in starts.items() if len(s) >= least}
        # A beginning counts by the common endings it takes, so that chance beginnings fall away.
        good_starts = {s for s, e in ends.items() if len(e & good_ends) >= least}
        formed = {s + e for s in good_starts for e in good_ends}
        odd |= known - formed
        for w in known | formed:
            kinds[w].add(kind)
    return dict(kinds), odd


def _lower(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer stay as they are
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low


class Finder:
    """Finds personal data in one text after another."""

    def __init__(self, parts: Sequence[tuple[str, str]]):
        self.kinds, self.odd = widen(parts)
        automaton = ahocorasick.Automaton()
        cues: dict[str, list[str]] = defaultdict(list)
        for kind, words in (
            ("at", AT), ("id", ID_LABELS), ("bare", _BARE_SHAPES), ("phone", _PHONE_SHAPES), ("account", _ACCOUNT_SHAPES), ("after", STREETS_AFTER), ("before", STREETS_BEFORE),
            ("first", STREETS_FIRST), ("ending", STREET_ENDINGS), ("name", list(self.kinds)),
        ):
            for w in words:
                cues[w].append(kind)
        for w, k in cues.items():
            automaton.add_word(w, (len(w), tuple(k), w))
        automaton.make_automaton()
        self.automaton = automaton
        self.digits = str.maketrans("123456789", "000000000")

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Spans (start, end, kind) in order, without overlaps."""
        low = _lower(text)
        anchors: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for end, (n, kinds, word) in self.automaton.iter(low.translate(self.digits)):
            for k in kinds:
                anchors[k].append((end + 1 - n, end + 1))
        taken: list[tuple[int, int, str]] = []
        covered = bytearray(len(text))

        def take(start: int, end: int, kind: str) -> None:
            if start < end and not any(covered[start:end]):
                covered[start:end] = b"\1" * (end - start)
                taken.append((start, end, kind))

        for a, b in anchors["at"]:
            if span := self.email(text, a, b):
                take(*span, "email")
        for a, b in anchors["id"]:
            if span := self.labelled(text, a, b):
                take(*span, "id_number")
        for a, b in anchors["bare"]:
            if span := self.bare_id(text, a, b):
                take(*span, "id_number")
        # An international account number is told by its check digits; a card number only where no phone is.
        for kind, anchor, parse in (("account_number", "account", self.account), ("phone", "phone", self.phone), ("account_number", "account", self.card)):
            done = -1
            for a, _ in sorted(anchors[anchor]):
                if a > done and (span := parse(text, a)):
                    take(*span, kind)
                    done = span[1] - 1
        for parse, kind in ((self.street_after, "after"), (self.street_before, "before"), (self.street_first, "first"), (self.street_ending, "ending")):
            for a, b in anchors[kind]:
                if span := parse(text, a, b):
                    take(*span, "street_address")
        for span in self.names(text, low, anchors["name"], covered):
            take(*span, "person_name")
        return sorted(taken)

    # Each parser gets the anchor's place and returns the span or None.

    def email(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        sign, left, right = text[a:b], a, b
        if sign != "@":
            while left and text[left - 1] == " " and sign[0] != " ":
                left -= 1
            while right < len(text) and text[right] == " " and sign[0] != " ":
                right += 1
            if a - left > 1 or right - b > 1:
                return None
        start = self.local_part(text, left)
        d = _DOMAIN.match(text, right)
        if start is None or not d:
            return None
        labels = _GLUED.split(d[0])
        if sign == " at " and "." in d[0]:
            return None  # words around a plain "at" are an address only if the dots are spelled too
        while len(labels) > 1 and not (labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24):
            return None
        return start, d.end()

    @staticmethod
    def local_part(text: str, end: int) -> int | None:
        """Where the part before the sign begins: the whole run of its characters, from a letter or digit on."""
        i = end
        while i and (text[i - 1].isalnum() or text[i - 1] in "._%+-"):
            i -= 1
        while i < end and not text[i].isalnum():
            i += 1
        return i if i < end and text[end - 1] not in ".%" else None

    def labelled(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        if a and (text[a - 1].isalnum() or text[a - 1] == "_"):
            return None
        m = _AFTER_LABEL.match(text, b)
        at = m.end()
        if at == b and text[b : b + 1].isalnum():
            return None
        n = _NUMBER_OF_PERSON.match(text, at)
        if not n or not self.alone(text, at, n.end()) or not self.some_number(n[0]):
            return None
        return at, n.end()

    @staticmethod
    def some_number(text: str) -> bool:
        """Whether any digit is not 0; numbers of nothing but zeros stand for no person."""
        return any(c.isdigit() and c != "0" for c in text)

    def account(self, text: str, a: int) -> tuple[int, int] | None:
        """An international account number whose remainder by 97 is 1."""
        m = _IBAN.match(text, a - 2) if a >= 2 and text[a - 1].isupper() else None
        if m and self.alone(text, m.start(), m.end()):
            bare = re.sub(r"[ -]", "", m[0])
            if 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                return m.span()
        return None

    def card(self, text: str, a: int) -> tuple[int, int] | None:
        """A card number of 13 to 19 digits whose weighted digit sum ends in 0."""
        if a and text[a - 1].isdigit():
            return None
        m = _CARD.match(text, a)
        if m and self.alone(text, m.start(), m.end()) and self.some_number(m[0]):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
                return m.span()
        return None

    def bare_id(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        for start in (a, a - 2, a - 3):
            for p in _BARE_ID if start >= 0 else ():
                m = p.match(text, start)
                if m and m.end() >= b - 1 and self.alone(text, start, m.end()) and self.some_number(m[0]):
                    return start, m.end()
        return None

    @staticmethod
    def alone(text: str, a: int, b: int) -> bool:
        """Whether no letter, digit or joined number touches the span."""
        before, after = text[max(0, a - 2) : a], text[b : b + 2]
        if before and (before[-1].isalnum() or before[-1] in "_+@#" or before[-1] in "-./" and before[:-1].isalnum()):
            return False
        return not (after and (after[0].isalnum() or after[0] in "_@" or after[0] in "-/.:" and after[1:].isalnum()))

    def phone(self, text: str, a: int) -> tuple[int, int] | None:
        for start in (a, a - 1, a - 2, a - 3):
            if start < 0 or text[start] not in "+(0123456789":
                continue
            if start and (text[start - 1].isalnum() or text[start - 1] in "+_#=$€" or text[start - 1] in ".-/" and start > 1 and text[start - 2].isalnum()):
                continue
            for i, p in enumerate(_PHONES):
                m = p.match(text, start)
                if not m:
                    continue
                end = m.end()
                n = sum(c.isdigit() for c in m[0])
                least, most = ((8, 15), (9, 12), (10, 11), (9, 9))[i]
                if least <= n <= most and self.alone(text, start, end) and self.some_number(m[0]) and (i or m[0][0] == "+" or any(c in " -./ " for c in m[0])):
                    return start, end
        return None

    def street_after(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        if not text[a].isupper() or text[b : b + 1].isalnum() or text[a - 1 : a] != " ":
            return None
        # Up to three words before the street word, then the house number.
        at, m = a, None
        for _ in range(3):
            i = at - 1
            while i > 0 and _NAME_CHAR.match(text, i - 1):
                i -= 1
            if i <= 0 or i == at - 1 or text[i - 1] != " ":
                break
            at = i
            if n := _EN_NUMBER.search(text, max(0, at - 12), at):  # the number is shorter than this
                m = n
        if not m or not _EN_NAME.fullmatch(text, m.start(), a):
            return None
        word, rest = text[a:b].lower(), text[b : b + 3]
        if rest[:1] == "." and word in ("st", "rd", "ave", "blvd", "ln", "dr", "ct", "pl", "sq", "hwy", "pkwy"):
            # The stop belongs to the abbreviation unless it may end the sentence as well.
            goes_on = rest[1:2] in tuple(".,;:|)('\"’") or rest[1:2] == " " and (rest[2:3].islower() or rest[2:3] in tuple("(|,;"))
            if word == "rd" or rest[1:2] and goes_on:
                b += 1
        return m.start(), b

    def street_before(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        m = _FR_NUMBER.search(text, max(0, a - 16), a)  # the number is shorter than this
        n = _FR_NAME.match(text, b) if m else None
        return (m.start(), n.end()) if m and n else None

    def street_first(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        if not text[a].isupper() or a and (text[a - 1].isalnum() or text[a - 1] in "_/"):
            return None
        n = _ES_NAME.match(text, b)
        if not n or (text[b : b + 1].isalnum() and text[b - 1] != "/"):
            return None
        h = _HOUSE.match(text, n.end())
        return (a, h.end()) if h else None

    def street_ending(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        h = _DE_HOUSE.match(text, b)
        if not h:
            return None
        i = a
        while i and (text[i - 1] == "-" or _LETTER.match(text, i - 1)):
            i -= 1
        # The first part of the joined word that begins with a capital.
        while i < a and not (text[i].isupper() and (i == 0 or not _LETTER.match(text, i - 1))):
            i += 1
        return (i, h.end()) if i < a or text[a].isupper() else None

    def names(self, text: str, low: str, anchors: list[tuple[int, int]], covered: bytearray) -> Iterator[tuple[int, int]]:
        """Full, inverted and initialled names and lone given names around parts of names."""
        whole: dict[int, int] = {}
        for a, b in anchors:  # the longest part at each place, with the case of a name
            if covered[a] or a and (text[a - 1].isalnum() or text[a - 1] in "_@") or text[b : b + 1].isalnum() or text[b : b + 1] in ("_", "@"):
                continue
            word = text[a:b]
            if word[0].isupper() and (word[1:].islower() or word.isupper()):
                whole[a] = max(b, whole.get(a, 0))
        runs: list[list[tuple[int, int]]] = []  # hyphened parts are one unit
        for a in sorted(whole):
            if runs and a == runs[-1][-1][1] + 1 and text[a - 1] in "-‐‑":
                runs[-1].append((a, whole[a]))
            elif not runs or a >= runs[-1][-1][1]:
                runs.append([(a, whole[a])])
        units = [(r[0][0], r[-1][1], frozenset(k for a, b in r for k in self.kinds[low[a:b]]), all(low[a:b] in self.odd for a, b in r)) for r in runs]
        i = 0
        while i < len(units):
            a, b, kinds, odd = units[i]
            nxt = units[i + 1] if i + 1 < len(units) else None
            start, end, used = a, b, 1
            m = _BEFORE_INITIAL.search(text, max(0, a - 12), a)  # three initials are shorter than this
            if m and not covered[m.start()]:
                # A lone given name has no initial, and a full one none before it: "M." is a title there.
                titled = text[m.start() : m.start() + 2] == "M." and ("given" in kinds or m[0].count(".") > 1)
                start = m.start() + (3 if titled else 0)
                start = start if start < a else a
            initials = start < a
            if "given" in kinds or initials:
                at = b
                if not initials and (x := _AFTER_INITIAL.match(text, b)):
                    at = x.end()
                if nxt and (text[at : nxt[0]] == " " or _LINK.fullmatch(text, at, nxt[0])) and ("family" in nxt[2] or "given" in nxt[2]):
                    end, used = nxt[1], 2
                    after = units[i + 2] if i + 2 < len(units) else None
                    if after and "given" in nxt[2] and "family" not in nxt[2] and "family" in after[2] and (text[end : after[0]] == " " or _LINK.fullmatch(text, end, after[0])):
                        end, used = after[1], 3
                    yield start, end
                elif initials and nxt and text[b : nxt[0]] == ", " and "given" in nxt[2] and text[start : start + 3] == "M. ":
                    end, used = nxt[1], 2
                    yield a, end
                elif initials and not (odd and self.common_use(text, end)):
                    yield start, end
                elif "given" in kinds and not odd:
                    if nxt and "family" in kinds and text[b : nxt[0]] == ", " and "given" in nxt[2]:
                        end, used = nxt[1], 2
                    yield start, end
            elif nxt and text[b : nxt[0]] == ", " and "given" in nxt[2] and "family" in kinds:
                end, used = nxt[1], 2
                if x := _AFTER_INITIAL.match(text, end):
                    end = x.end()
                yield start, end
            elif "family" in kinds and (x := _INVERTED_INITIAL.match(text, b)) and not odd:
                yield a, x.end()
            i += used

    @staticmethod
    def common_use(text: str, end: int) -> bool:
        """Whether an ordinary word after an initial goes on like a list or a heading."""
        return bool(re.match(r" [a-z]+s\b", text[end : end + 12]))


def placeholder(kind: str) -> str:
    return f"[{kind.upper()}]"


def replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], placeholder(kind)]
        at = b
    return "".join([*out, text[at:]])


def _scan(df: DataFrame, id_col: str, text_col: str, parts: Sequence[tuple[str, str]], emit, columns: list[T.StructField]) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(list(parts))
    cache: dict[int, Finder] = {}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = cache.get(0) or cache.setdefault(0, Finder(shared.value))
        for batch in batches:
            for b in text_chunks(batch, 1):
                yield emit(finder, b)

    slim = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id")
    return slim.mapInArrow(scan, T.StructType([slim.schema["id"], *columns]))


def find_pii(df: DataFrame, id_col: str, text_col: str, parts: Sequence[tuple[str, str]], kinds: Sequence[str] = KINDS) -> DataFrame:
    """Each distinct piece of personal data of each text: ``id_col``, ``pii_kind``, ``pii_text``; of the ``kinds`` asked for.

    ``parts``: parts of names with their kind, ``given`` or ``family``; a list of fixed size. Kinds
    are those of ``KINDS``; the piece is written as in the text. Null, empty and blank texts have
    none. Rows with the same identifier are read as one text's pieces.
    """
    wanted = frozenset(kinds)
    fields = [T.StructField("pii_kind", T.StringType()), T.StructField("pii_text", T.StringType())]

    def emit(finder: Finder, b: pa.RecordBatch) -> pa.RecordBatch:
        rows, kinds, pieces = [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            for kind, piece in dict.fromkeys((k, text[a:e]) for a, e, k in finder.find(text) if k in wanted) if text else ():
                rows.append(i)
                kinds.append(kind)
                pieces.append(piece)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(pieces, pa.string())], ["id", "pii_kind", "pii_text"])

    return _scan(df, id_col, text_col, parts, emit, fields).distinct().withColumnRenamed("id", id_col)


def redact(df: DataFrame, id_col: str, text_col: str, parts: Sequence[tuple[str, str]]) -> DataFrame:
    """Every row's text with a typed placeholder such as ``[EMAIL]`` for each piece: ``id_col``, ``text``, ``n_pieces``.

    Null stays null (0 pieces), everything outside the pieces stays as it is.
    """
    fields = [T.StructField("text", T.StringType()), T.StructField("n_pieces", T.IntegerType())]

    def emit(finder: Finder, b: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        for text in b.column(1).to_pylist():
            spans = finder.find(text) if text else []
            texts.append(replace(text, spans) if spans else text)
            counts.append(len(spans))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["id", "text", "n_pieces"])

    return _scan(df, id_col, text_col, parts, emit, fields).withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
