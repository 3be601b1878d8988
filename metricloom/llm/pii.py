"""Keyed, type-consistent surrogates for personal data.

Entities found in a text are brought to a normal form, split into characters by class (digits, vowels, consonants,
letters of a script) and read as a number in mixed radix. A keyed Feistel permutation of the numbers below the product of
the radices, walked until it meets the entity's own constraints (check digits, address ranges), gives the surrogate. A
permutation never maps two entities to one, and always maps an entity alike: distinctness and coreference hold across all
documents and machines without any table. Given names permute within a list by gender. A person who is named with a title
is found again in the same text without it, by the whole name or by a part. Each worker also checks its pairs.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import extended, map_batches, slices_of

DIGITS, VOWELS, CONSONANTS, HEX = "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789abcdef"
CYRILLIC, GREEK = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
# Given names by gender and script.
NAMES = {
    ("f", "latin"): "anna maria emma laura julia sarah lisa sophie claire elena carmen lucia marta helen alice emily grace ingrid petra nadia".split(),
    ("m", "latin"): "peter paul john david thomas martin james robert michael daniel carlos juan pedro luis pierre jean karl hans stefan marco".split(),
    ("f", "cyrillic"): "анна мария елена ольга наталья татьяна ирина светлана юлия екатерина".split(),
    ("m", "cyrillic"): "иван пётр сергей алексей дмитрий андрей николай михаил олег борис".split(),
}
# Titles.
TITLES = "mr mrs ms miss herr frau mme mlle monsieur madame señor señora dr prof г-н г-жа".split()
GIVEN = {name: key for key, names in NAMES.items() for name in names}

# Each pattern begins at a character that texts seldom hold, or at a word's start, so a scan passes text quickly.
AT = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])")
IP4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")
CARD = re.compile(r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\.?\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]\d|\d)")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IBAN_SMALL = re.compile(r"(?<!\w)[a-z]{2}\d{2}[a-z0-9]{10,30}(?!\w)")
SECRET = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|api[_-]?key)["']?\s*[=:]\s*["']?([A-Za-z0-9_\-+/]{16,})""")
# Tokens that tell themselves by how they begin: web tokens, cloud and code-hosting keys, and private keys between marks.
TOKEN = re.compile(r"(?<![\w-])(?:eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,})(?![\w-])")
PRIVATE = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s+([A-Za-z0-9+/=\s]{16,}?)\s+-----END")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
BORN = re.compile(r"(?i)(?<!\w)(?:born(?: on)?|date of birth|dob|geboren am|née? le|nacid[oa] el)[:\s]+((?:19|20)\d\d-\d\d-\d\d|\d\d[./-]\d\d[./-](?:19|20)\d\d)(?!\d)")
SSN_SAID = re.compile(r"(?i)(?<!\w)(?:ssn|social security(?: number)?)(?: is| no\.?)?[:#\s]*(\d{9})(?!\d)")
# Small words within surnames, which stay as they are.
PARTICLES = "van von der den de del della di da du la le bin al".split()
UPPER = "A-ZА-ЯÀ-Ý"
#: A name: Quill, Jean-Pierre, O'Brien; what follows an apostrophe in small letters is no part of it.
NAME = rf"[{UPPER}](?:[\wÀ-ÿ]+|['’][{UPPER}][\wÀ-ÿ]+)(?:-[\wÀ-ÿ]+|['’][{UPPER}][\wÀ-ÿ]+)*"
PERSON = re.compile(rf"(?<!\w)({'|'.join(t.capitalize() for t in TITLES)})\.? ({NAME}(?:(?: (?:{'|'.join(PARTICLES)}))* {NAME})?)")


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    return -sum(int(d) if i % 2 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits))) % 10


def mod97(country: str, account: str) -> int:
    """The two check digits of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def born(text: str) -> tuple[datetime.date, str] | None:
    """A date and its form, day before month unless the year stands first; None if there is no such day."""
    form = "%Y-%m-%d" if text[4:5] == "-" else f"%d{text[2]}%m{text[5]}%Y"
    try:
        return datetime.datetime.strptime(text, form).date(), form
    except ValueError:
        return None


def is_ip6(text: str) -> bool:
    try:
        return ipaddress.ip_address(text).version == 6 and sum(map(bool, text.split(":"))) > 2
    except ValueError:
        return False


def mentions(text: str, names: list[str]) -> Iterator[tuple[int, int, str]]:
    """Where persons are named again without a title: by the whole name, by the surname, by the given name.

    Names are looked up by their first word, the longest one first, so the text is passed once however many there are.
    """
    wanted: dict[str, str] = {}
    for name in names:
        given, _, surname = name.partition(" ")
        wanted[name] = "person"
        last = surname.rpartition(" ")[2]
        for part, kind in ((surname or given, "surname" if surname else "person"), (last, "surname"), (given, "given")):
            if len(part) > 2:
                wanted.setdefault(part, kind)
    by_word: dict[str, list[str]] = {}
    for name in sorted(wanted, key=len, reverse=True):
        by_word.setdefault(WORD.match(name)[0], []).append(name)
    at = 0
    for m in WORD.finditer(text):
        for name in by_word.get(m[0], ()) if m.start() >= at else ():
            end = m.start() + len(name)
            if text.startswith(name, m.start()) and not WORD.match(text[end : end + 1]):
                yield m.start(), end, wanted[name]
                at = end
                break


WORD = re.compile(r"\w+")


class Spans:
    """Spans that don't overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.found: list[tuple[int, int, str]] = []

    def add(self, start: int, end: int, kind: str) -> None:
        """The span, unless one that is there overlaps it."""
        i = bisect_left(self.starts, end)  # only the last one that begins before its end can
        if i and self.found[i - 1][1] > start:
            return
        self.starts.insert(i, start)
        self.found.insert(i, (start, end, kind))


def entities(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of what is found, without overlaps; where kinds meet the one named first stands."""
    out = Spans()

    def add(kind: str, spans: Iterator[tuple[int, int]], ok: Callable[[str], bool] = lambda x: True) -> None:
        for s, e in spans:
            if ok(text[s:e]):
                out.add(s, e, kind)

    spans = lambda pattern, group=0: (m.span(group) for m in pattern.finditer(text))
    digits = lambda x: re.sub(r"\D", "", x)
    if "@" in text:
        add("email", spans(AT))
    if "=" in text or ":" in text:
        add("secret", spans(SECRET, 1))
    add("secret", spans(TOKEN))
    if "PRIVATE KEY" in text:
        add("secret", spans(PRIVATE, 1))
    if any(d in text for d in DIGITS):
        if ":" in text:
            add("ip6", spans(IP6), is_ip6)
        add("born", spans(BORN, 1), lambda x: born(x) is not None)
        add("iban", spans(IBAN), lambda x: mod97(x[:2], re.sub(r"\s", "", x)[4:]) == int(x[2:4]))
        add("iban", spans(IBAN_SMALL), lambda x: mod97(x[:2], x[4:]) == int(x[2:4]))
        add("ip", spans(IP4))
        add("card", spans(CARD), lambda x: luhn(digits(x)[:-1]) == int(digits(x)[-1]))
        add("ssn", spans(SSN))
        add("ssn", spans(SSN_SAID, 1))
        add("phone", spans(PHONE), lambda x: 8 <= len(digits(x)) <= 15)
    add("person", spans(PERSON, 2))
    names = sorted({text[s:e] for s, e, kind in out.found if kind == "person"})
    if names:
        for s, e, kind in mentions(text, names):
            out.add(s, e, kind)
    return out.found


class Surrogates:
    """Replacements under one key."""

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.back: dict[tuple[str, str], str] = {}

    def _round(self, tweak: str, i: int, value: int, bits: int) -> int:
        size = -(-bits // 8)
        data, out = f"{tweak}|{i}|{value}".encode(), b""
        while len(out) < size:
            out += hmac.digest(self.key, data + bytes([len(out) // 32]), hashlib.sha256)
        return int.from_bytes(out[:size], "big") & (1 << bits) - 1

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A keyed permutation of the numbers below ``size``: Feistel rounds, walked until within."""
        half = max(1, -(-(size - 1).bit_length() // 2))
        mask = (1 << half) - 1
        while True:
            a, b = value >> half, value & mask
            for i in range(8):
                a, b = b, a ^ self._round(tweak, i, b, half)
            value = a << half | b
            if value < size:
                return value

    def letters(self, text: str, tweak: str, ok: Callable[[str], bool] = lambda x: True) -> str:
        """Characters of known classes change within their class, others stay; walked until ``ok`` and not the same."""
        sets = [next((s for s in (DIGITS, VOWELS, CONSONANTS, CYRILLIC, GREEK) if c in s), c) for c in text]
        return self.mixed(text, sets, f"{tweak}|{''.join(s[0] if len(s) > 1 else s for s in sets)}", ok)

    def mixed(self, text: str, sets: list[str], tweak: str, ok: Callable[[str], bool]) -> str:
        size, value = 1, 0
        for c, s in zip(text, sets, strict=True):
            value, size = value * len(s) + s.index(c), size * len(s)
        if size < 2:
            return text
        while True:  # ends at the entity itself at the latest, for which ``ok`` holds
            value = self.permute(value, size, tweak)
            rest, out = value, []
            for s in reversed(sets):
                rest, at = divmod(rest, len(s))
                out.append(s[at])
            new = "".join(reversed(out))
            if ok(new):
                return new

    def normal(self, kind: str, text: str) -> str:
        """What mentions of one entity have in common."""
        if kind in ("card", "ssn"):
            return re.sub(r"\D", "", text)
        if kind == "phone":
            return re.sub(r"\D", "", text)[-10:]
        if kind == "iban":
            return re.sub(r"\s", "", text).upper()
        if kind == "ip6":
            return ipaddress.ip_address(text).exploded
        if kind == "born":
            return born(text)[0].isoformat()
        return text if kind in ("secret", "ip") else text.lower()

    def replace(self, kind: str, text: str) -> str:
        new = getattr(self, f"_{kind}")(text)
        own, other = self.normal(kind, text), self.normal(kind, new)
        if self.back.setdefault((kind, other), own) != own:
            raise ValueError(f"two {kind} entities have one surrogate")
        if len(self.back) > 200_000:
            self.back.clear()
        return new

    @staticmethod
    def _filled(pattern: str, digits: str) -> str:
        """The pattern with its digits replaced in turn."""
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in pattern)

    @staticmethod
    def _cased(pattern: str, text: str) -> str:
        return "".join(t.upper() if p.isupper() else t for p, t in zip(pattern, text, strict=True))

    def _email(self, text: str) -> str:
        local, _, domain = text.lower().partition("@")
        host, _, top = domain.rpartition(".")
        return self._cased(text, f"{self.letters(local, 'local')}@{self.letters(host, 'host')}.{top}")

    def _ip(self, text: str) -> str:
        value = int.from_bytes(map(int, text.split(".")), "big")
        public = lambda v: 0 < v >> 24 < 224 and v >> 24 not in (10, 127)
        own = public(value)
        while True:
            value = self.permute(value, 1 << 32, "ip")
            if public(value) == own:
                return ".".join(map(str, value.to_bytes(4, "big")))

    def _card(self, text: str) -> str:
        digits = re.sub(r"\D", "", text)
        body = self.letters(digits[:-1], "card", lambda x: x[0] != "0" or digits[0] == "0")
        return self._filled(text, body + str(luhn(body)))

    def _phone(self, text: str) -> str:
        digits = re.sub(r"\D", "", text)
        return self._filled(text, digits[:-10] + self.letters(digits[-10:], "phone"))

    def _ssn(self, text: str) -> str:
        return self._filled(text, self.letters(re.sub(r"\D", "", text), "ssn"))

    def _iban(self, text: str) -> str:
        own = re.sub(r"\s", "", text).upper()
        account = self.letters(own[4:].lower(), "iban" + own[:2]).upper()
        left = iter(f"{own[:2]}{mod97(own[:2], account):02d}{account}")
        new = "".join(c if c.isspace() else next(left) for c in text)
        return new.lower() if text == text.lower() else new

    def _secret(self, text: str) -> str:
        low = text.lower()
        for hexes, form in ((HEX, low), (HEX.upper(), text.upper())):
            if text == form and set(text) <= set(hexes):  # of digits alone: as in lower case
                return self.mixed(text, [hexes] * len(text), f"hex{len(text)}", lambda x: not x.isdigit() or text.isdigit())
        case = "".join("U" if c.isupper() else "l" for c in text)
        hexlike = lambda x: {*self._cased(text, x)} <= {*HEX} or {*self._cased(text, x)} <= {*HEX.upper()}
        return self._cased(text, self.letters(low, "secret" + case, lambda x: not hexlike(x)))

    def _part(self, part: str, role: str) -> str:
        """One name: a listed one within its list, any other among those not listed, whatever the title."""
        known = GIVEN.get(part)
        if known:
            names = NAMES[known]
            return names[self.permute(names.index(part), len(names), f"given{known}")]
        return self.letters(part, role, lambda x: x not in GIVEN)

    def _name(self, text: str, role: str) -> str:
        """Each part between hyphens and spaces by itself, written as the original is; small words within surnames stay."""
        out = []
        for part in re.split(r"([-\s])", text):
            new = part if not part or part in "- " or part in PARTICLES else self._part(part.lower(), role)
            out.append(new if new == part else self._cased(part, new) if len(new) == len(part) else new.capitalize())
        return "".join(out)

    def _surname(self, text: str) -> str:
        return self._name(text, "name")

    def _given(self, text: str) -> str:
        return self._name(text, "given")

    def _person(self, text: str) -> str:
        given, _, surname = text.partition(" ")
        return f"{self._given(given)} {self._surname(surname)}" if surname else self._surname(given)

    def _ip6(self, text: str) -> str:
        """The first two bytes, which tell the kind of address, stay."""
        value = int(ipaddress.ip_address(text))
        new = ipaddress.ip_address(value >> 112 << 112 | self.permute(value & (1 << 112) - 1, 1 << 112, "ip6"))
        return new.compressed if "::" in text else new.exploded

    def _born(self, text: str) -> str:
        """Another day of the same century's, in the same form."""
        day, form = born(text)
        first, days = datetime.date(day.year // 100 * 100, 1, 1), 36524 if day.year < 2000 else 36525
        return (first + datetime.timedelta(days=self.permute((day - first).days, days, f"born{first.year}"))).strftime(form)


def replaced(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and start, end, kind and surrogate of each entity of the original."""
    parts, at, found = [], 0, []
    for s, e, kind in entities(text):
        new = surrogates.replace(kind, text[s:e])
        parts += [text[at:s], new]
        found.append((s, e, kind, new))
        at = e
    return ("".join([*parts, text[at:]]) if found else text), found


def surrogate(df: DataFrame, secret: bytes, text: str = "text", spans: str | None = "entities") -> DataFrame:
    """All columns, with surrogates in ``text``, and ``spans``: start, end, kind and surrogate of each entity found.

    ``spans`` None leaves that column out; a column of its name is replaced. Null and empty texts stay as they are. Rows
    stay, repeated ones alike. ``secret`` is the key; without it surrogates can't be traced back.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = df.drop(spans) if spans else df
    schema = extended(kept, **{spans: "array<struct<start: int, end: int, kind: string, surrogate: string>>"}) if spans else kept.schema
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Surrogates(secret)
        for batch in slices_of(batches):
            column = batch.column(text)
            texts, found = column.to_pylist(), []
            for i, x in enumerate(texts):
                new, spots = replaced(x, own) if x else (x, [])
                texts[i] = new
                found.append([{"start": s, "end": e, "kind": k, "surrogate": n} for s, e, k, n in spots])
            batch = batch.set_column(batch.schema.get_field_index(text), batch.schema.field(text), pa.array(texts, column.type))
            columns = [*batch.columns, pa.array(found, fields.field(spans).type)] if spans else batch.columns
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*batch.schema, fields.field(spans)]) if spans else batch.schema)

    return kept.mapInArrow(run, schema)


def collisions(df: DataFrame, secret: bytes, text: str = "text") -> DataFrame:
    """``kind, surrogate, originals``: surrogates that stand for several entities of the corpus, of which there are none.

    Entities are compared by their hashes in normal form, so the originals do not appear.
    """

    def run(batch: pa.RecordBatch) -> dict:
        own, rows = Surrogates(secret), set()
        for x in batch.column(text).to_pylist():
            for s, e, kind, new in replaced(x or "", own)[1]:
                rows.add((kind, own.normal(kind, new), hashlib.sha256(own.normal(kind, x[s:e]).encode()).hexdigest()))
        return dict(zip(("kind", "surrogate", "original"), zip(*rows, strict=True) if rows else ([],) * 3, strict=True))

    return map_batches(df.select(text), run, "kind string, surrogate string, original string").groupBy("kind", "surrogate").agg(F.countDistinct("original").alias("originals")).where("originals > 1")
