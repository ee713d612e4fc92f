"""Personal information in free text (problem 8): detection, placeholders and keyed surrogates.

Mentions are found by form (e-mail, phone, identity number, address), by context (titles, words that introduce or
follow a name in four languages) and by common given names and Cyrillic family endings in any sentence. Within a text,
mentions of one person are brought to one entity. Every distinct entity of the corpus gets one surrogate: drawn by a
keyed hash, of the same kind, gender, script and format, and by checks over all entities neither another entity's
surrogate nor another real entity. Found mentions are those that got a surrogate; texts get placeholders or surrogates.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factspan.session import staged

KINDS = ["email", "phone", "id_number", "address", "name"]

# The words that introduce or follow what is looked for.
_TITLE = r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Mme|Mlle|Monsieur|Madame|Herr|Frau|Sr|Sra|Srta|Señora?|Dott|Ing)\.?(?:\s+(?:Dr|Prof)\.?)*"
_BEFORE = (
    r"Operator|Operador|Opérateur|Bediener|Visitor\s+record:|Correspondence:|Correspondance\s*:|Correspondencia:|Signed\s+off\s+by|Signed\s+by|Approved\s+by"
    r"|Freigabe\s+durch|note\s+from|Messung\s+von|Mesure\s+refaite\s+par|Medición\s+de|Medida\s+repetida\s+por|Rückfragen\s+bitte\s+an"
    r"|Questions\s+about\s+(?:\S+\s+){1,5}go\s+to|Consultas:|appeler|contacter|llamar\s+a|at\s+the\s+request\s+of|a\s+la\s+atención\s+de|attention\s+of|à\s+l['’]attention\s+de"
    r"|z\.\s?Hd\.(?:\s+von)?|Contact:|Kontakt:|Author:"
)
_AFTER = r"\s+(?:repeated\s+the|wiederholte|a\s+répété|repitió)\b"
_T = r"(?:\p{Lu}(?:['’]\p{Lu})?[\p{L}]+(?:['’-]\p{Lu}[\p{L}]+)*)"
_FAMILY = r"(?:(?:van|von|de|del|di|da|der|den|la|le)\s+)*" + _T
_I = r"\p{Lu}\."
_NAME = rf"(?:{_T}|{_I})(?:\s+{_I}|-{_I})*\s+{_FAMILY}|{_T},\s+(?:{_T}|{_I})(?:\s+{_I})*"
_ONE = rf"(?:(?P<title>{_TITLE})\s+(?:(?:{_NAME})|{_FAMILY})|(?P<name>{_NAME}))"
_WORDS_NOT_NAMES = {
    "the", "we", "all", "no", "fig", "figure", "table", "sample", "series", "flat", "calle", "avda", "plaza", "am", "and", "butler", "volmer",
    "tafel", "nernst", "set", "parser", "extraction", "values", "error", "holding", "impedance", "after", "between", "ship", "delivery", "passport",
    "reisepass", "ssn", "orcid", "nif", "steuer", "social", "id", "staff", "badge", "personnel", "tax", "national",
}

_STREET_EN = r"(?:Street|Road|Lane|Terrace|Close|Crescent|Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Way|Court|Place|Square|Row|Gardens|Grove|Hill|Park|Parade|Quay|Walk|Mews|St\.|Rd\.)"
_CAP = r"[A-ZÀ-ÖØ-Þ][\p{L}'’-]+"
_TOWN = r"[A-ZÀ-ÖØ-Þ][\p{L}'’]+(?:-(?:[\p{L}'’]+))*"
_ADDRESS = [
    rf"(?:(?:Flat|Apt\.?|Unit|FLAT)\s+\d+[A-Za-z]?,\s+)?\d+[A-Za-z]?\s+(?:{_CAP}\s+){{1,4}}(?:{_STREET_EN}|(?i:{_STREET_EN})),\s+(?:{_TOWN})",
    rf"\d+(?:\s?(?:bis|ter)|[A-Za-z])?,?\s+(?i:rue|avenue|impasse|boulevard|bd|place|chemin|allée|quai|cours|route|square|passage)\s+[\p{{L}}'’ -]{{2,45}}?,\s+\d{{5}}\s+{_TOWN}",
    rf"(?:(?:{_CAP}\s+)?[A-ZÄÖÜ][\p{{L}}-]*(?i:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|hof)|(?i:Am|An\s+der|Auf\s+dem|Im|Zum|Zur)\s+{_CAP})\s+\d+\s?[a-zA-Z]?,\s+\d{{5}}\s+{_TOWN}",
    rf"(?i:Calle|Plaza|Avda\.|Avenida|Paseo|Camino|Ronda|C/)\s+[\p{{L}} ]{{2,40}}?\s+\d+\s?[a-zA-Z]?,\s+\d{{5}}\s+{_TOWN}",
]
_EMAIL = [
    r"(?<![\w.%+-])[\w.%+-]++@[\p{L}\d-]+(?:\.[\p{L}\d-]+)*\.\p{L}{2,}",
    r"(?<![\w.%+-])[\w.%+-]++\s?[(\[{]\s?(?i:at|a|arroba|@)\s?[)\]}]\s?[\p{L}\d-]+(?:(?:\.|\s?[(\[{]\s?(?i:dot|punkt|point|punto|\.)\s?[)\]}]\s?)[\p{L}\d-]+)*(?:\.|\s?[(\[{]\s?(?i:dot|punkt|point|punto|\.)\s?[)\]}]\s?)\p{L}{2,}",
    r"(?<![\w.%+-])[\w.%+-]++\s++(?i:at)\s+[\p{L}\d-]+(?:\s+(?i:dot)\s+[\p{L}\d-]+)*\s+(?i:dot)\s+\p{L}{2,}",
]
_PHONE = [
    r"(?<![\w+])\+\d{1,3}[ .\xa0-]?(?:\(0\)[ \xa0]?)?\d(?:[ .\xa0-]?\d){6,12}(?!\d)",
    r"(?<![\w.+-])00\d{2}[ .\xa0-]\(?\d\)?(?:[ .\xa0-]?\d){6,12}(?![\w-])",
    r"(?<![\w+])\(\d{3}\)[ \xa0]?\d{3}[-. ]\d{4}(?![\w-])",
    r"(?<![\w.+-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])",
    r"(?<![\w.+-])0\d{2}[ \xa0]\d{4}[ \xa0]\d{4}(?![\w-])",
    r"(?<![\w.+-])0\d([ .\xa0])\d{2}(?:\1\d{2}){3}(?![\w-])",
    r"(?<![\w.+-])0\d{1,3}-\d{3}[ \xa0]\d{3}[ \xa0]\d{2}(?![\w-])",
    r"(?<![\w.+-])0\d{2,4}[ /-]\d{4,8}(?![\w-])(?=\D|$)(?<=(?i:tel|phone|call|on|unter|tél|fon)\S{0,3}\s\S{1,6}[ /-]\S{4,8})",
]
_ID_WORD = (
    r"(?i:SSN|social\s+security(?:\s+(?:no\.?|number))?|national\s+(?:identity|insurance|id)(?:\s+(?:no\.?|number|card))?|ID\s+card(?:\s+(?:no\.?|number))?|identity\s+(?:card|number)"
    r"|passport(?:\s+(?:no\.?|number))?|Reisepass(?:-?nr\.?|nummer)?|passeport(?:\s+n[°o]\.?)?|pasaporte(?:\s+n[°ºo.]*)?|staff\s+(?:ID|no\.?|number)|badge(?:\s+(?:no\.?|number))?"
    r"|personnel\s+(?:no\.?|number)|Personal(?:nummer|-?nr\.?)|employee\s+(?:ID|no\.?|number)|matricule|tax\s+(?:ID|no\.?|number)|Steuer-?ID(?:nr\.?)?|Steuernummer|NIF|NIE|DNI|TIN|ORCID(?:\s+iD)?|Ausweis(?:-?nr\.?)?"
    r"|researcher\s+(?:ID|no\.?|number))"
)
_ID_VALUE = r"(?=[\w -]{0,4}\d)[A-Z]{0,3}-?\d(?:[\d]|[ \xa0-](?=\d{2,})|X(?!\w))*[A-Z]?(?!\w)|[A-Z]\d{7,8}[A-Z]?|\d{8}-?[A-Z]"
_ID = [rf"{_ID_WORD}\s*[:#]?\s*(?:https?://orcid\.org/)?(?P<v>{_ID_VALUE})", r"(?<![\d-])(?P<v>\d{4}-\d{4}-\d{4}-\d{3}[\dX])(?![\d-])"]


# Beginnings of the words above, in lower case; searches start where one of them stands.
_ID_STARTS = (
    "ssn", "social", "national", "id card", "identity", "passport", "reisepass", "passeport", "pasaporte", "staff", "badge", "personnel", "personal",
    "employee", "matricule", "tax", "steuer", "nif", "nie", "dni", "tin", "orcid", "ausweis", "researcher",
)
_LEAD_STARTS = (
    "operator", "operador", "opérateur", "bediener", "visitor", "correspond", "signed", "approved", "freigabe", "note from", "messung von", "mesure refaite",
    "medición de", "medida repetida", "rückfragen", "questions", "consultas", "appeler", "contacter", "llamar", "at the request", "a la atención", "attention of",
    "à l", "z.", "contact:", "kontakt:", "author:",
)
_AFTER_WORDS = ("repeated", "wiederholte", "répété", "repitió")
_THANKS_WORDS = ("thank", "danken", "remercions", "agradecemos")
# Common given names of the four languages and of Cyrillic texts that are no words of their own.
FEMALE = (
    "Maria Anna Emma Sophie Sofia Laura Julia Sarah Lisa Lena Hannah Katharina Christine Sabine Monika Petra Claudia Susanne Ursula Ingrid Heike Anke "
    "Elizabeth Margaret Jennifer Jessica Emily Rebecca Rachel Catherine Helen Susan Linda Barbara Patricia Charlotte Olivia Amelia Chloé Camille Manon "
    "Marie Nathalie Isabelle Sylvie Valérie Céline Hélène Amélie Élodie Juliette Carmen Lucía Elena Isabel Pilar Mercedes Beatriz Cristina Raquel Marta "
    "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила"
).split()
MALE = (
    "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Joshua George Kevin Edward Brian Peter Simon "
    "Hans Klaus Jürgen Wolfgang Stefan Andreas Matthias Markus Tobias Sebastian Florian Johannes Friedrich Heinrich Karl Pierre Jean Jacques Philippe "
    "Nicolas Laurent François Antoine Julien Guillaume Étienne Carlos José Luis Juan Javier Miguel Pedro Pablo Manuel Fernando Diego Sergio Álvaro Andrés "
    "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел"
).split()
_GIVEN_NAMES = frozenset(FEMALE) | frozenset(MALE)
#: Cyrillic family names and patronymics end so.
_SLAVIC = r"(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ский|ская|цкий|цкая|енко|чук|ович|евич|овна|евна)"


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def places(low: str, words: tuple[str, ...]) -> list[int]:
    """Where any of the words stands, in order."""
    out = []
    for w in words:
        at = low.find(w)
        while at >= 0:
            out.append(at)
            at = low.find(w, at + 1)
    return sorted(out)


class Spans:
    """Intervals that do not overlap, in order; a new one is taken if it touches none."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.items: list[tuple[int, int, str, str]] = []

    def take(self, a: int, b: int, kind: str, hint: str = "") -> None:
        k = bisect_left(self.starts, a)
        if b <= a or (k and self.items[k - 1][1] > a) or (k < len(self.items) and self.items[k][0] < b):
            return
        self.starts.insert(k, a)
        self.items.insert(k, (a, b, kind, hint))


class Detector:
    """Finds the spans of one text; a small helper that tasks run on each text of a batch."""

    def __init__(self) -> None:
        c = regex.compile
        self.email = [(c(_EMAIL[0]), lambda t, low: "@" in t), (c(_EMAIL[1]), lambda t, low: any(x in t for x in "([{")), (c(_EMAIL[2]), lambda t, low: "dot" in low)]
        self.id, self.orcid = c(_ID[0]), c(_ID[1])
        self.phone = [c(p) for p in _PHONE]
        self.digits = c(r"\d[\d .()/\xa0-]{6}").search
        self.street, self.postcode = c(rf"(?i)\s{_STREET_EN},\s").search, c(r",\s+\d{5}\s").search
        self.address = [c(p) for p in _ADDRESS]
        self.lead = c(rf"(?i:(?<!\w)(?:{_BEFORE})\s*)(?<=\s)")
        self.one = c(_ONE)
        self.after = c(rf"{_ONE}(?i:{_AFTER})")
        self.titled = c(rf"(?<!\w)(?P<t>{_TITLE})\s+(?P<f>(?:(?:{_T}|{_I})\s+)?{_FAMILY})")
        short = r"(?<=\b(?:\p{Lu}|Dr|Prof|Mr|Mrs|Ms|Sr|Sra|Mme|Mlle))"
        self.thanks = c(rf"(?i:\b(?:We\s+thank|Wir\s+danken|Nous\s+remercions|Agradecemos\s+a))\s+(?P<all>(?:[^.;\n]|\n(?!\n)|{short}\.){{3,2000}}?)(?=\s+(?i:for|für|pour|por)\b|;|\n\n|{short.replace('(?<=', '(?<!', 1)}\.|$)")
        self.split = c(r",?\s+(?:and|und|et|y)\s+|,\s+", regex.I)
        self.token = c(r"(?<![\w.@-])\p{Lu}\p{Ll}+(?=[\s-])")
        self.full = c(rf"{_T}(?:\s+{_I})*\s+{_FAMILY}(?![\w@])")
        self.slavic = c(rf"(?<!\w)[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?\s+[А-ЯЁ][а-яё]+{_SLAVIC}(?!\w)|(?<!\w)[А-ЯЁ]\.\s?(?:[А-ЯЁ]\.\s?)?[А-ЯЁ][а-яё]+{_SLAVIC}(?!\w)")

    def _name(self, text: str, at: int) -> tuple[int, int, str] | None:
        m = self.one.match(text, at)
        if not m:
            return None
        start = m.end("title") if m.group("title") else m.start()
        while text[start].isspace():
            start += 1
        return start, m.end(), m.group("title") or ""

    def _thanked(self, text: str, at: int, end: int) -> Iterator[tuple[int, int, str]]:
        """The names of a list; a lone word before a comma turns a name (Family, Given)."""
        pieces, pos = [], at
        for cut in [*self.split.finditer(text, at, end), None]:
            pieces.append((pos, cut.start() if cut else end))
            pos = cut.end() if cut else end
        k = 0
        while k < len(pieces):
            a, b = pieces[k]
            if len(text[a:b].split()) == 1 and k + 1 < len(pieces) and len(text[pieces[k + 1][0] : pieces[k + 1][1]].split()) <= 2:
                b, k = pieces[k + 1][1], k + 1
            if (s := self._name(text, a)) and s[1] <= b:
                yield s
            k += 1

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), not overlapping, in order; longer and earlier kinds first."""
        return [s[:3] for s in self.hinted(text)]

    def hinted(self, text: str) -> list[tuple[int, int, str, str]]:
        """spans() with the title that stands before a name, '' if none."""
        low, taken = lowered(text), Spans()
        for p, gate in self.email:
            if gate(text, low):
                for m in p.finditer(text):
                    taken.take(*m.span(), "email")
        for at in places(low, _ID_STARTS):
            if m := self.id.match(text, at):
                taken.take(*m.span("v"), "id_number")
        if self.digits(text):
            for m in self.orcid.finditer(text):
                taken.take(*m.span("v"), "id_number")
            for p in self.phone:
                for m in p.finditer(text):
                    taken.take(*m.span(), "phone")
        if self.street(text):
            for m in self.address[0].finditer(text):
                taken.take(*m.span(), "address")
        if self.postcode(text):
            for p in self.address[1:]:
                for m in p.finditer(text):
                    taken.take(*m.span(), "address")
        if any(w in low for w in _THANKS_WORDS):
            for m in self.thanks.finditer(text):
                for a, b, title in self._thanked(text, *m.span("all")):
                    taken.take(a, b, "name", title)
        for a, b, title in self._names(text, low):
            words = [w.strip(".,").lower() for w in regex.split(r"[\s-]+", text[a:b])]
            if not any(w in _WORDS_NOT_NAMES for w in words):
                taken.take(a, b, "name", title)
        return taken.items

    def _names(self, text: str, low: str) -> Iterator[tuple[int, int, str]]:
        for at in places(low, _LEAD_STARTS):
            if (m := self.lead.match(text, at)) and (s := self._name(text, m.end())):
                yield s
        if any(w in low for w in _AFTER_WORDS):
            for m in self.after.finditer(text):
                start = m.end("title") if m.group("title") else m.start()
                end = m.end("name") if m.group("name") else m.end() - len(regex.search(rf"(?i:{_AFTER})$", m.group(0)).group(0))
                while text[start].isspace():
                    start += 1
                if regex.match(rf"{_I}\s+{_I}", text[start:end]):  # a unit ends the sentence before
                    start += 2
                    while text[start].isspace():
                        start += 1
                yield start, end, m.group("title") or ""
        for m in self.titled.finditer(text):
            yield *m.span("f"), m.group("t")
        if not text.isascii() and "\u0410" <= max(text):
            for m in self.slavic.finditer(text):
                yield *m.span(), ""
        if not _GIVEN_NAMES.isdisjoint(text.replace("-", " ").split()):
            for m in self.token.finditer(text):
                if m.group(0) in _GIVEN_NAMES and (f := self.full.match(text, m.start())):
                    yield *f.span(), ""


# --- entities: what a mention stands for ---------------------------------------------------------------------------

_AT = regex.compile(r"\s?[(\[{]\s?(?i:at|a|arroba|@)\s?[)\]}]\s?|@|\s+(?i:at)\s+")
_DOT = regex.compile(r"\s?[(\[{]\s?(?i:dot|punkt|point|punto|\.)\s?[)\]}]\s?|\s+(?i:dot)\s+")
_PARTICLES = {"van", "von", "de", "del", "di", "da", "der", "den", "la", "le"}


def name_parts(text: str) -> tuple[str, str]:
    """(given, family) of a name in lower case, however it is turned; given is an initial with its point, or ''."""
    words = " ".join(text.lower().split())
    if "," in words:
        family, _, given = words.partition(",")
        return given.strip().split(" ")[0], family.strip()
    ws = words.split(" ")
    given = ws[0] if len(ws) > 1 and ws[0] not in _PARTICLES else ""
    rest = [w for w in (ws[1:] if given else ws) if not (len(w) == 2 and w[1] == ".")]
    return given, " ".join(rest) or ws[-1]


def entity_of(kind: str, text: str) -> str:
    """The form under which mentions of one entity meet: without regard to case, spacing, separators or writing-out."""
    plain = " ".join(text.lower().split())
    if kind == "email":
        return _DOT.sub(".", _AT.sub("@", plain, count=1))
    if kind in ("phone", "id_number"):
        return ("+" if plain.startswith(("+", "00")) else "") + "".join(c for c in plain if c.isalnum()).removeprefix("00" if plain.startswith("00") else "")
    return "|".join(name_parts(plain)) if kind == "name" else plain


def resolved(mentions: list[tuple[str, str]]) -> list[str]:
    """The entity of each (kind, mention) of one text.

    A family name alone or with an initial stands for the one full name of the text that it fits; where several fit,
    or none, it is an entity of its own.
    """
    parts = [name_parts(t) if k == "name" else None for k, t in mentions]
    full: dict[str, set[str]] = {}
    for p in parts:
        if p and len(p[0].rstrip(".")) > 1:
            full.setdefault(p[1], set()).add(p[0])
    out = []
    for (kind, text), p in zip(mentions, parts):
        if p and len(p[0].rstrip(".")) <= 1:
            fits = [g for g in full.get(p[1], ()) if g.startswith(p[0].rstrip("."))]
            out.append(f"{fits[0]}|{p[1]}" if len(fits) == 1 else "|".join(p))
        else:
            out.append(entity_of(kind, text))
    return out


_FEMALE_TITLES = {"mrs", "ms", "miss", "mme", "mlle", "madame", "frau", "sra", "srta", "señora"}
_MALE_TITLES = {"mr", "monsieur", "herr", "sr", "señor"}
_LOW_FEMALE, _LOW_MALE = frozenset(x.lower() for x in FEMALE), frozenset(x.lower() for x in MALE)


def gender_of(title: str, given: str) -> str:
    """f or m by the title, else by a common given name, else ''."""
    t = {x.strip(".").lower() for x in title.split()}
    if t & _FEMALE_TITLES or given in _LOW_FEMALE:
        return "f"
    return "m" if t & _MALE_TITLES or given in _LOW_MALE else ""


# --- surrogates -----------------------------------------------------------------------------------------------------

# Syllables of surrogate names by script, and the words of addresses that stay.
_SYLLABLES = {
    "latin": "bar den fel gor hal kem lin mor nes pol rin sel tam vel wen zor bru dal fen gil hos jar kel lom mir nol pim ras sul tor vam wil".split(),
    "cyrillic": "бар ден фел гор хал кем лин мор нес пол рин сел там вел зор бру дал фен гил хос жар кел лом мир нол пим рас сул тор вам вил".split(),
    "greek": "βαρ δεν φελ γορ χαλ κεμ λιν μορ νες πολ ριν σελ ταμ βελ ζορ βρυ δαλ φεν γιλ χος καρ κελ λομ μιρ νολ πιμ ρας συλ τορ βαμ βιλ ξεν".split(),
}
_ADDRESS_KEPT = (
    "flat apt unit street road lane terrace close crescent avenue ave boulevard blvd drive way court place square row gardens grove hill park parade quay walk mews st rd bis ter rue impasse bd chemin allée quai "
    "cours route passage des de du la le les l d sur sous en straße strasse str weg gasse platz allee ring damm ufer steig hof am an auf im zum zur der dem calle plaza avda avenida paseo camino ronda c del los las el y bei"
).split()
_SUFFIX = regex.compile(r"(?i)(?<=\p{L})(?:straße|strasse|str|weg|gasse|platz|allee|ring|damm|ufer|steig|hof)$")
_COUNTRY = regex.compile(r"\+\d{1,2}(?=\D)|\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|00\d{2}")


class Draw:
    """Numbers from a keyed hash, as many as are wanted."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.what, self.count, self.pool = key, "|".join(map(str, what)), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, f"{self.what}|{self.count}".encode(), hashlib.sha256).digest()
            self.count += 1
        v, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return v % n

    def letter(self, c: str) -> str:
        """Another letter of the script and case of c; a digit for a digit; anything else as it is."""
        if c.isdigit():
            return str(self.below(10))
        if not c.isalpha():
            return c
        for first, n in (("a", 26), ("а", 32), ("α", 17)):
            if ord(first) <= ord(c.lower()) < ord(first) + n:
                new = chr(ord(first) + self.below(n))
                return new.upper() if c.isupper() else new
        if c.isascii() or unicodedata.normalize("NFD", c)[0].isascii():
            new = chr(97 + self.below(26))
            return new.upper() if c.isupper() else new
        base = ord(c) & ~0x1F  # a letter near by, of the same block
        near = [x for x in map(chr, range(base, base + 32)) if x.isalpha() and x.isupper() == c.isupper()]
        return near[self.below(len(near))]

    def word(self, like: str, syllables: int) -> str:
        """A made-up word in the script and case of like."""
        low = like.lower()
        script = "cyrillic" if any("а" <= c <= "я" or c == "ё" for c in low) else "greek" if any("α" <= c <= "ω" for c in low) else "latin"
        if script == "latin" and not any(unicodedata.normalize("NFD", c)[0].isascii() for c in low if c.isalpha()):
            return "".join(self.letter(c) for c in like)  # a script without syllables of its own here
        new = "".join(_SYLLABLES[script][self.below(len(_SYLLABLES[script]))] for _ in range(syllables))
        return new.upper() if like.isupper() and len(like) > 1 else new if like.islower() else new.capitalize()

    def number(self, like: str) -> str:
        """As many digits, the first not zero where it was not, and not the same number."""
        while True:
            new = "".join(str(1 + self.below(9)) if i == 0 and c != "0" else str(self.below(10)) for i, c in enumerate(like))
            if new != like or len(like) > 40:
                return new


def surrogate(kind: str, text: str, entity: str, gender: str, key: bytes, attempt: int = 0) -> str:
    """A replacement of the same kind and format for one mention of an entity, drawn by key, entity and attempt.

    Two mentions of an entity get the same surrogate, each in its own writing: order, initials and case of names,
    separators of e-mail addresses and numbers. Names keep gender and script, phone numbers their country code,
    addresses the kind of street; streets, house numbers, postcodes, towns and e-mail domains are replaced. A later
    attempt draws longer words and so from more.
    """
    size = 2 + min(attempt // 2, 6)
    if kind == "name":
        given, family = entity.split("|", 1)
        names = {"f": FEMALE, "m": MALE}.get(gender) or (FEMALE if Draw(key, "gender", entity).below(2) else MALE)
        d = Draw(key, "name", entity, attempt)
        cyrillic = any("а" <= c <= "я" for c in entity)
        fitting = [x for x in names if ("а" <= x[-1] <= "я") == cyrillic]
        first = fitting[d.below(len(fitting))]
        if attempt or not (entity.isascii() or cyrillic):
            first = d.word(text, 2)
        middle = chr(65 + d.below(26)) + "."
        last = [w if w in _PARTICLES else d.word(w.capitalize(), size) for w in family.split(" ")]

        def cased(new: str, old: str) -> str:
            return new.upper() if old.isupper() and len(old.strip(".,")) > 1 else new

        turned, has_given = "," in text, bool(name_parts(text)[0])
        words, out, fam = text.split(), [], iter(last)
        for k, w in enumerate(words):
            bare = w.strip(",")
            is_given = has_given and ((turned and "," in " ".join(words[:k])) or (not turned and k == 0))
            if len(bare) == 2 and bare[1] == ".":
                new = f"{first[0].upper()}." if is_given and not (turned and out and out[-1] == f"{first[0].upper()}.") else middle
            elif is_given:
                new = cased(first, bare)
            else:
                new = next(fam, None) or d.word(bare, size)
                new = new if new in _PARTICLES else cased(new, bare)
            out.append(new + ("," if w.endswith(",") else ""))
        return " ".join(out)
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        d, host = Draw(key, "email", entity, attempt), Draw(key, "domain", domain, attempt)
        new = [*("".join(d.letter(c) for c in local)), *"".join("".join(host.letter(c) for c in x) for x in labels[:-1])]
        new += [*labels[-1]]  # the top-level domain tells no person
        at, fill, out, pos = _AT.search(text), iter(c for c in new if c.isalnum()), [], 0
        cuts = [at.span()] if at else []
        cuts += [m.span() for m in _DOT.finditer(text, at.end() if at else 0)]
        for a, b in [*cuts, (len(text), len(text))]:
            for c in text[pos:a]:
                n = next(fill, "x") if c.isalnum() else c
                out.append(n.upper() if c.isupper() else n)
            out.append(text[a:b])
            pos = b
        return "".join(out)
    if kind == "address":
        d = Draw(key, "address", entity, attempt)

        def part(m: regex.Match) -> str:
            w = m.group(0)
            if w[0].isdigit():
                return d.number(w)
            if w.lower() in _ADDRESS_KEPT or len(w) == 1:
                return w
            end = _SUFFIX.search(w)
            return d.word(w[: end.start()], size) + end.group(0) if end else d.word(w, size)

        return regex.sub(r"\d+|\p{L}+", part, text)
    d = Draw(key, kind, entity, attempt)
    kept = m.end() if kind == "phone" and (m := _COUNTRY.match(text)) else 0
    zero = next((i for i, c in enumerate(text[kept:], kept) if c.isdigit()), -1) if kind == "phone" else -1
    out = [c if i < kept or (i == zero and c == "0") else d.letter(c) for i, c in enumerate(text)]
    extra = "".join(str(d.below(10)) for _ in range(max(0, attempt - 20)))  # a format too short for all its entities grows
    return "".join(out) + extra


# --- jobs -----------------------------------------------------------------------------------------------------------


def entities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_id, start, kind, found, entity, gender: every mention of every text; start counts characters from 0.

    text_id tells texts of one doc_id apart. Null, empty and blank texts have none. Whole texts are searched, however
    long. Mentions of one person in a text have one entity (resolved). Extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Detector()
        for b in batches:
            rows = []
            for i, h, t in zip(b["doc_id"], b["text_id"], b["text"]):
                spans = d.hinted(t)
                whole = resolved([(k, t[a:z]) for a, z, k, _ in spans])
                rows.extend((i, h, a, k, t[a:z], e, gender_of(hint, e.split("|")[0]) if k == "name" else "") for (a, z, k, hint), e in zip(spans, whole))
            yield pd.DataFrame(rows, columns=["doc_id", "text_id", "start", "kind", "found", "entity", "gender"])

    src = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    src = src.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, "doc_id long, text_id long, start int, kind string, found string, entity string, gender string")


def secret_key(spark: SparkSession) -> bytes:
    """The key of spark.factspan.surrogate.key; if none is set, one drawn for this run, so that nobody can draw again."""
    return (spark.conf.get("spark.factspan.surrogate.key", None) or secrets.token_hex(32)).encode()


def surrogate_table(mentions: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, gender, attempt, surrogate: one surrogate for each distinct entity, all distinct in their kind.

    A surrogate that is, in any writing, another entity's surrogate or any real entity of the corpus is drawn again,
    until none is: each round draws for the few that collided, from more words. Entities are aggregated before
    anything is drawn, so an entity with a third of all mentions costs no more than any other.
    """
    out = "kind string, entity string, gender string, sample string, attempt int, surrogate string, drawn string"

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["surrogate"] = [surrogate(k, f, e, g, key, a) for k, f, e, g, a in zip(b["kind"], b["sample"], b["entity"], b["gender"], b["attempt"])]
            b["drawn"] = [entity_of(k, s) for k, s in zip(b["kind"], b["surrogate"])]
            yield b

    # the longest writing is drawn for: it names most of the entity
    e = mentions.groupBy("kind", "entity").agg(F.max("gender").alias("gender"), F.max_by("found", F.struct(F.length("found"), "found")).alias("sample"))
    s = staged(e.withColumn("attempt", F.lit(0)).mapInPandas(drawn, out))
    while True:
        real = s.select("kind", F.col("entity").alias("drawn"), F.lit(True).alias("is_real"))
        place = F.row_number().over(W.partitionBy("kind", "drawn").orderBy("attempt", "entity"))
        checked = s.join(real, ["kind", "drawn"], "left").withColumn("place", place)
        bad = F.col("is_real") | (F.col("place") > 1)
        checked = staged(checked.withColumn("bad", F.coalesce(bad, F.lit(False))).select(*s.columns, "bad"))
        again = checked.where("bad").drop("bad")
        if again.isEmpty():
            return s.select("kind", "entity", "gender", "attempt", "surrogate")
        redrawn = again.drop("surrogate", "drawn").withColumn("attempt", F.col("attempt") + 1).mapInPandas(drawn, out)
        s = staged(checked.where("not bad").drop("bad").unionByName(redrawn))


def replacements(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_id, start, kind, found, entity, surrogate: every mention with its replacement in the mention's own writing.

    Mentions join their entity's row over salted copies of it, as one entity may have a third of all mentions.
    """
    mentions = staged(entities(df, id_col, text_col))
    table = surrogate_table(mentions, key).select("kind", "entity", F.col("gender").alias("g"), "attempt")
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    m = mentions.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["surrogate"] = [surrogate(k, f, e, g, key, a) for k, f, e, g, a in zip(b["kind"], b["found"], b["entity"], b["g"], b["attempt"])]
            yield b.drop(columns=["g", "attempt"])

    both = m.join(table, ["kind", "entity", "salt"]).select("doc_id", "text_id", "start", "kind", "found", "entity", "g", "attempt")
    return both.mapInPandas(written, "doc_id long, text_id long, start int, kind string, found string, entity string, surrogate string")


#: Copies of the surrogate table over which mentions of one entity are spread.
SALTS = 8


def found(df: DataFrame, key: bytes) -> DataFrame:
    """p8_found: doc_id, kind, found of the mentions that were given a surrogate; each substring once per document."""
    return replacements(df, key).select("doc_id", "kind", "found").distinct()


def pseudonymised(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: the texts with surrogates in place of what was found.

    Null texts stay null, texts without mentions as they are; repeated ids keep a row each. A text's replacements are
    gathered per text, as many as it has mentions, and joined to it once.
    """
    r = replacements(df, key, id_col, text_col).distinct()  # copies of a text under one id have the same replacements
    per = r.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("start", F.length("found").alias("n"), "surrogate"))).alias("r"))
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_id"), F.col(text_col).alias("text"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, rs in zip(b["text"], b["r"]):
                if t is not None and rs is not None:
                    for x in reversed(rs):
                        t = t[: x["start"]] + x["surrogate"] + t[x["start"] + x["n"] :]
                out.append(t)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": out})

    return src.join(per, ["doc_id", "text_id"], "left").select("doc_id", "text", "r").mapInPandas(put, "doc_id long, text string")


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, redacted: the text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of what was found.

    Null texts stay null, texts without findings stay as they are; repeated ids keep a row each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Detector()
        for b in batches:
            out = []
            for t in b["text"]:
                if t:
                    for s, e, k in reversed(d.spans(t)):
                        t = f"{t[:s]}[{k.upper()}]{t[e:]}"
                out.append(t)
            yield pd.DataFrame({"doc_id": b["doc_id"], "redacted": out})

    src = df.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text")
    return src.mapInPandas(run, "doc_id long, redacted string")


def surrogates(df: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, surrogate of every distinct entity of the corpus."""
    return surrogate_table(staged(entities(df)), key).select("kind", "entity", "surrogate")
