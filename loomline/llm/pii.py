"""Problem 3: personal information inside free text.

Generators with high recall propose spans, which may overlap: addresses for mail, digit groups, lettered numbers, street
lines, and capitalised sequences that could be a person. For each kind of information boosted trees (logistic loss, depth
3, fitted here by ``fit_models``) score the spans by format and context. The labelled sample they are fitted on is made by
``labelled_sample``: ``SAMPLE`` invented sentences a kind, fixed by a seed, a quarter of it held out to set the threshold
of each kind where F1 is best. Of overlapping spans the likeliest stay; they are replaced by placeholders such as [EMAIL].

Results by case: null texts give null, empty texts stay; a text without findings stays as it is, byte for byte; repeated
rows count once; spans are found in the whole of any text, however long.
"""

from __future__ import annotations

import random
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: Labelled sentences made for each kind, half of them with and half without.
SAMPLE = 2400

#: Common given names.
GIVEN = frozenset(
    "adam adele aisha alan albert alex alexander alice ali alina amara amelia amina amir ana anders andrea andreas angela anita anna anne antonio "
    "arjun arthur astrid ben bjorn boris bruno carla carlos carmen caroline chen chiara christian clara claire daniel daria david diana diego dmitri "
    "elena elif elisa emil emily emma eric erik esther eva fatima felix finn francesca frank fred gabriel george giulia grace greta hana hannah hans "
    "hassan helen helga hiroshi hugo ian ibrahim ines ingrid irena iris isabel ivan jack jacob james jan jane javier jean jens joao john jonas jose "
    "joseph juan julia julian karen karim karl kate keiko kenji kevin klaus kofi kwame lara lars laura lea leila lena leo li lily linda lisa louis lucas "
    "lucia lukas luis magnus mai marco maria marie marta martin mary mateo max mei mia michael miguel mina mohamed nadia naomi nina noor olga oliver "
    "omar oscar pablo paul pavel pedro peter petra philip pierre priya rachel rahul ravi rita robert rosa ruben ruth samir samuel sara sofia sophie "
    "stefan sven tariq thomas tom tomas tove uma ursula vera viktor wei yara yasmin yuki yusuf zara zoe".split()
)
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Señora?|MR|MRS|MS|DR|PROF|HERR|FRAU|MME)"
_UP_START = r"[A-ZÀ-ÖØ-Þ][\w’'-]*?"
_UP = r"[A-ZÀ-ÖØ-Þ][\w’'-]*[\wà-ÿ]"
#: Words of street lines.
_STREETS = "Street St Road Rd Avenue Ave Lane Ln Crescent Cres Drive Dr Court Ct Close Way Square Sq Boulevard Blvd Terrace Place Pl Row Mews Highway Parkway".split()
STREET = "(?:" + "|".join([*_STREETS, *[w.upper() for w in _STREETS]]) + ")"
_BEFORE = "rue avenue boulevard chemin place calle via plaza allée".split()
_BEFORE = "(?:" + "|".join(x for w in _BEFORE for x in (w, w.capitalize(), w.upper())) + ")"
_AFTER = "straße strasse str\\. weg gasse platz allee damm ufer".split()
_AFTER = "(?:" + "|".join([*_AFTER, *[w.upper() for w in _AFTER], "STRAßE"]) + ")"
_FLAT = r"(?:Flat|FLAT|Apt\.?|APT\.?|Apartment|APARTMENT|Unit|UNIT|Suite|SUITE|Wohnung|Floor|FLOOR)"
_MAIL = re.compile(r"(?i)[\w.+%'-]{1,64}\s?[@＠][\w-]+(?:\.[\w-]+)+")
_SPOKEN_MAIL = re.compile(r"(?i)[\w.+%'-]{1,64}(?:\s?[(\[{<]\s?at\s?[)\]}>]\s?|\sat\s)[\w-]+(?:(?:\s?\.\s?|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s)[\w-]+)+")
GENERATORS = {
    "phone": re.compile(r"(?:tel:)?(?:\+|\(|\b)\d[\d().\-/  ]{5,22}\d\b(?:\s?(?:ext\.?|extension|x|Durchwahl)\s?\d{1,5})?", re.I),
    "id_number": re.compile(r"\b(?:[A-Z]{1,3}[ -]?)?\d[\dA-Z]{0,10}(?:[ -][\dA-Z]{1,9}){0,5}\b"),
    "address": re.compile(
        r"(?:" + _FLAT + r"\s+\w+,?\s+)?"
        r"(?:\b\d{1,4}\s?[A-Za-z]?,?\s+(?:" + _BEFORE + r"\s+(?:(?:de|du|des|la|le|del)\s+)*" + _UP + r"|(?:" + _UP + r"\s+){1,3}" + STREET + r"\b\.?)"
        r"|\b(?:" + _UP_START + _AFTER + r"|(?:Am|AM|An der|Im|IM|Auf der|Calle|CALLE|Avenida|AVENIDA|Via|VIA|Plaza|PLAZA|Paseo|PASEO)\s+" + _UP + r"),?\s+\d{1,4}\s?[a-zA-Z]?\b)"
        r"(?:,\s+" + _FLAT + r"\s+\w+)?(?:,?\s+" + _UP + r"\s+\d{4,6}\b|,\s*(?:\d{4,5}\s+)?" + _UP + r")?"
    ),
    "name": re.compile(
        r"\b(?:" + TITLE + r"\.?\s+(?:" + _UP + r"\s+|[A-Z]\.\s*){0,2}" + _UP + r"|(?:[A-ZÀ-ÖØ-Þ]\.\s*){1,2}" + _UP + r"|" + _UP + r",\s+" + _UP + r"|" + _UP + r"(?:\s+[A-Z]\.)?(?:\s+(?:de|la|del|der|den|van|von|di|da|dos|bin|al|el)\b){0,2}\s+" + _UP + r")"
    ),
}
_CUES = {
    "email": re.compile(r"(?i)\b(?:mail|e-mail|mailto|mailbox|reach|write|contact|send|repl(?:y|ies)|export|desk|address|owner|escreib\w+|schreib\w+|écri\w+)\b"),
    "phone": re.compile(r"(?i)\b(?:call|caller|ring|phone|telephone|tel|fax|voice|mobile|cell|number|text\s+message|sms|dial|reach|hours|contact|card|anrufen|telefon|rufen|appel\w*|téléphone|teléfono|llam\w+|hotline|duty)\b"),
    "id_number": re.compile(r"(?i)\b(?:ssn|social\s+security|passport|licen[cs]e|identity|id\s+card|tax|personal\s+number|national|insurance|customer\s+quoted|matched\s+on|record\s+opened|verified|scan\s+shows|delete|ausweis\w*|steuer\w*|dni|nie|passnummer|reisepass|permis)\b"),
    "address": re.compile(r"(?i)\b(?:address|lives|courier|ship|letters|delivery|branch|moved|office|visit|post|card|home|wohnt|adresse|anschrift|habite|vive|dirección|sent)\b"),
    "name": re.compile(r"(?i)\b(?:signed\s+by|approved|ask|escalate|loop\s+in|according|thanks|contact\s+card|card|written\s+by|reviewed\s+by|spoke|met|caller|regards|dear|from|by|signed|reported|assigned|owner|per|says|said|told)\b"),
}
#: Words directly before or after a person.
_ASKED = re.compile(r"(?i)\b(?:signed\s+by|approved\s+by|reviewed\s+by|written\s+by|reported\s+by|sent\s+by|ask|call|contact|escalate(?:d)?\s+to|assigned\s+to|loop\s+in|according\s+to|thanks,?|regards,?|dear|met|told|spoke\s+(?:to|with)|card:|owner:|on\s+behalf\s+of)\s+$")
_AGAINST = re.compile(
    r"(?i)\b(?:job|order|build|reference|version|release|counter|ticket|step|section|invoice|serial|batch|port|id|answers|package|read|reset|replayed|rows|view|map|"
    r"team|environment|tenant|product|guide|chapter|handle|key|pattern|commit|hash|checksum|token|score|level|requests)\b"
)
_SAY = re.compile(r"(?i)^\W{0,3}(?:approved|about|when|said|says|wrote|asked|from|had|has|will|is|was|signed|confirmed|reviewed|the\s+job)\b")
#: What only a person does, directly after the name.
_SAID = re.compile(r"(?i)^\s(?:approved|said|says|wrote|writes|asked|signed|confirmed|reviewed|replied|agreed|reported|thinks|told|answered|called)\b")
_DATE = re.compile(r"^(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}|^\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d\d|^\d{4}-\d\d-\d\dT?$")
_NOT_NAME = frozenset(
    "tenant tenants teams groups users members customers the a an in on at for from to of by with and or our each read step section chapter release team group gruppe das die der für falls cuando quand para pour dans en el la le les "
    "l'équipe contact card call ring ask job build order open set use keep check since once before after when where if do not no you your we i it its this that there two one "
    "gateway console studio stream rules ledger hub canvas road map lane view street avenue guide notes manual page version customer scan record please fax lives delivery ship courier".split()
)
_SURNAME = re.compile(r"(?i)(?:ova|ova|ski|ska|sky|son|sen|berg|stein|mann|mundt|ez|es|ini|elli|etti|ari|aki|moto|ham|ton|ley|man|off|ov|ev|ić|ic|vich|escu|idze|yan|ian|oglu|pour|zadeh|eira|eiro|quist|strom|feld|bauer|meier|ieu|aux|ard)$")


def _plain(word: str) -> str:
    """A word without its accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _shape(text: str, span: str, start: int, end: int, kind: str) -> list[float]:
    """Features of a span: format first, then context."""
    before, after = text[max(0, start - 48) : start], text[end : end + 32]
    near = before[-26:]
    line = re.split(r"\n|[.!?]\s+(?=\S+\s)", before)[-1]
    around = before + after
    loud = sum(c.isupper() for c in around) / max(1, sum(c.isalpha() for c in around))
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    groups = re.findall(r"\d+", span)
    words = re.findall(r"[^\W\d_]+", span)
    low = [w.casefold() for w in words]
    base = [
        digits, letters, len(groups), max(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(span.startswith(("+", "tel:", "TEL:", "00", "(+"))), float("(" in span), span.count("-"), span.count(" "), span.count("."),
        float(bool(_CUES[kind].search(line))), float(bool(_CUES[kind].search(line[-26:]))), float(bool(_AGAINST.search(near[-18:]))), float(bool(_AGAINST.search(after[:18]))),
        float(before[-1:] in "`/@#=$" and before != "") , float(after[:1] in "`/@=_%" and after != ""), float(before.count("`") % 2),
        float(bool(_CUES["id_number"].search(line))), float(bool(_CUES["phone"].search(line))),
    ]
    if kind == "email":
        host = re.split(r"(?i)@|＠|[(\[{<]\s?at\s?[)\]}>]|\sat\s", span)[-1]
        top = re.split(r"(?i)\s?\.\s?|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s", host)
        sign = float("@" in span or "＠" in span)
        return base + [float(len(top)), float(top[-1].isalpha() and 2 <= len(top[-1]) <= 12), float(any(c.isalpha() for c in host)), sign, float(bool(re.search(r"(?i)[(\[{<]\s?at", span))), float(" dot " in span.lower() or "(dot)" in span.lower() or "[dot]" in span.lower())]
    if kind == "phone":
        first = groups[0] if groups else ""
        return base + [float(bool(_DATE.match(span.strip()))), float(7 <= digits <= 15), float(first.startswith("0")), float(first in ("1", "33", "34", "44", "49", "39", "31", "41", "43", "46", "0049", "0033", "0044")), float(bool(re.search(r"(?i)ext|x\s?\d", span))), float(bool(re.match(r"^\d{3}[- ]\d{2}[- ]\d{4}$", span)))]
    if kind == "id_number":
        return base + [
            float(bool(_DATE.match(span.strip()))), float(bool(re.match(r"^\d{3}[- ]\d{2}[- ]\d{4}$", span))), float(bool(re.match(r"^[A-Z]{1,3}[ -]?\d{5,}[A-Z]{0,3}$", span))),
            float(bool(re.match(r"^[A-Z]{2}(?: ?\d\d){3} ?[A-Z]$", span))), float(bool(re.match(r"^\d{6}[-+]\d{4}$", span))), float(bool(re.match(r"^\d{2}(?: \d{3}){3}$", span))),
            float(bool(re.match(r"^[A-Z]\d{2,3}[A-Z]\d{4,}$", span))), float(letters > 0),
        ]
    if kind == "address":
        return base + [float(bool(re.search(r",\s*(?:\d{4,5}\s+)?\w", span))), float(bool(re.search(r"\b\d{4,5}\b", span))), float(bool(re.search(r"(?i)\b(?:section|step|line|row|map|view|chapter)\b", near[-14:] + " " + span))), float(bool(re.search(r"(?i)straße|strasse|weg\b|rue|calle|gasse|platz", span))), float(bool(re.search(r"(?i)\b" + STREET + r"\b", span))), float(len(words)), float(not any(c.isupper() for c in span))]
    given = [w in GIVEN or _plain(w) in GIVEN for w in low]
    titled = bool(re.match(TITLE + r"\b", span))
    core = low[1:] if titled else low
    return base + [
        float(any(given)), float(titled), float(bool(core) and core[-1] in GIVEN), float(bool(core) and core[0] in GIVEN), float(any(w in _NOT_NAME for w in low if len(w) > 1)),
        float(bool(re.search(r"\b[A-Z]\.", span))), float("," in span), float(span.isupper()), float(bool(words) and bool(_SURNAME.search(words[-1]))), float(bool(words) and bool(_SURNAME.search(words[1 if titled and len(words) > 1 else 0]))),
        float(bool(_SAY.match(after))), float(bool(_ASKED.search(before))), float(bool(_SAID.match(after))), loud * span.isupper(), float(len(core)), float(not before.strip() or bool(re.search(r"[.!?\]:]\s*$", before))),
    ]


#: Without one of these in the lower-case text, white space as single spaces, or a short street word after a number, a text has no street line.
_STREET_HINTS = (
    "street", "road", " rd", "avenue", " ave", "lane", " ln", " cres", "drive", "court", "close", " way", "square", "boulevard", "blvd", "terrace", "place", " row", "mews", "highway", "parkway",
    " rue ", "chemin", "calle ", "via ", "plaza", "allée", "straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "damm", "ufer", "avenida", "paseo", "am ", "im ", "an der ", "auf der ",
)
_SHORT_STREET = re.compile(r"\d\s?[A-Za-z]?,?\s+(?:" + _UP + r"\s+){1,3}(?:S[Tt]|D[Rr]|C[Tt]|P[Ll]|S[Qq])\b")
#: Street lines without capitals; long street words only, as the short ones are other words too.
_LOWER_STREETS = ("street", "road", "avenue", "lane", "crescent", "drive", "court", "square", "boulevard", "terrace", "highway", "parkway")
_LOWER_ADDRESS = re.compile(r"\b\d{1,4}\s?[a-z]?,?\s+(?:[a-zà-ÿ][\w’'-]*\s+){1,3}(?:" + "|".join(_LOWER_STREETS) + r")\b(?:,\s+[a-zà-ÿ][\w’'-]*\b(?:\s+\d{4,6}\b)?)?")
_ELIDED, _INITIAL = re.compile(r"\b(?:[LDSNMTJ]|[Qq]u)[’'][a-zà-ÿ]"), re.compile(r"\b[A-Z]\.")
_TITLED, _LETTERS, _NEXT_UP = re.compile(TITLE + r"\b"), re.compile(r"[^\W\d_]{2,}"), re.compile(r"\s" + _UP + r"(?![\w-])")
_BRACKET_AT = re.compile(r"[(\[{<] ?[aA][tT] ?[)\]}>]")
_AT = re.compile(r"\s[aA][tT]\s+[\w-]+(?:\.[A-Za-z]| [dD][oO][tT] | ?[(\[{<] ?[dD])")
_USER = re.compile(r"[\w.+%'-]{1,64}\s?\Z")
_MAIL_SIGNS = re.compile(r"(?i)\bdot\b|[(\[{<]\s?at|\.[a-z]{2,}$")


def _mail_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans around every sign that may stand for the @ of an address; those with a real one come first."""
    out: list[tuple[str, int, int]] = []
    for signs, pattern in ((re.compile("[@＠]"), _MAIL), (_BRACKET_AT, _SPOKEN_MAIL), (_AT, _SPOKEN_MAIL)):
        last = 0
        for sign in signs.finditer(text):
            if sign.start() < last or any(s <= sign.start() < e for _, s, e in out):
                continue
            user = _USER.search(text, max(last, sign.start() - 66), sign.start())
            m = user and pattern.match(text, user.start(), sign.end() + 120)
            if not m or any(m.start() < e and s < m.end() for _, s, e in out):
                continue
            if pattern is _MAIL or _MAIL_SIGNS.search(m.group()):
                out.append(("email", *m.span()))
                last = m.end()
    return out


def _could_be_name(text: str, start: int, end: int) -> bool:
    """Whether a capitalised sequence could be a person: not if one of its words is known to be something else or an elided article.

    Among capitals only, capitals tell nothing, so there a given name or an initial is needed.
    """
    span = text[start:end]
    if _TITLED.match(span):
        return True
    words = [w.casefold() for w in _LETTERS.findall(span)]
    if _ELIDED.search(span) or any(w in _NOT_NAME for w in words):
        return False
    if span.isupper():
        around = [c for c in text[max(0, start - 30) : start] + text[end : end + 30] if c.isalpha()]
        if sum(c.isupper() for c in around) > 0.8 * len(around) > 0:
            return any(_plain(w) in GIVEN for w in words) or bool(_INITIAL.search(span))
    return True


def _longer(text: str, end: int) -> int:
    """The end of a name that begins a sequence of more than two capitalised words."""
    m = _NEXT_UP.match(text, end)
    return m.end() if m and not any(w.casefold() in _NOT_NAME for w in _LETTERS.findall(m.group())) else end


def propose(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans that could be personal information."""
    out = _mail_spans(text)
    for m in GENERATORS["phone"].finditer(text):
        if 7 <= sum(map(str.isdigit, m.group())) <= 16:
            out.append(("phone", *m.span()))
    for m in GENERATORS["id_number"].finditer(text):
        if m.end() - m.start() >= 6 and sum(map(str.isdigit, m.group())) >= 6:
            out.append(("id_number", *m.span()))
    low = " ".join(text.lower().split())
    if any(k in low for k in _STREET_HINTS) or _SHORT_STREET.search(text):
        out += [("address", *m.span()) for m in GENERATORS["address"].finditer(text)]
        if any(k in low for k in _LOWER_STREETS):
            out += [("address", *m.span()) for m in _LOWER_ADDRESS.finditer(text)]
    at = 0
    while m := GENERATORS["name"].search(text, at):
        if _could_be_name(text, *m.span()):
            end = m.end() if "," in m.group() else _longer(text, m.end())
            out.append(("name", m.start(), end))
            at = end
        else:  # the next may begin at its second word
            second = re.search(r"\s\S", m.group())
            at = m.start() + second.start() + 1 if second else m.end()
    return out


class Trees:
    """Gradient boosting for two classes: logistic loss, second order gains, depth-wise trees on raw thresholds."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.bias, self.trees = 0.0, []

    def _grow(self, x, g, h, rows, depth):
        value = -g[rows].sum() / (h[rows].sum() + 1.0)
        if depth == 0 or len(rows) < 8:
            return value
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        best = (1e-3, None, None)
        for f in range(x.shape[1]):
            col = x[rows, f]
            cuts = np.unique(col)
            for cut in (cuts[:-1] if len(cuts) <= 16 else np.quantile(col, np.linspace(0.05, 0.95, 15))):
                left = col <= cut
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                if min(hl, hr) * 4 < self.least:
                    continue
                gain = gl * gl / (hl + 1.0) + gr * gr / (hr + 1.0) - whole
                if gain > best[0]:
                    best = (gain, f, cut)
        if best[1] is None:
            return value
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._apply(low, x), self._apply(high, x))

    def fit(self, x, y):
        p = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(x, prob - y, prob * (1 - prob), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score = score + self.rate * self._apply(tree, x)
        return self

    def predict(self, x):
        score = np.full(len(x), self.bias)
        for tree in self.trees:
            score = score + self.rate * self._apply(tree, x)
        return 1 / (1 + np.exp(-score))


def labelled_sample(size: int = SAMPLE, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented sentences with the true spans in them; everything is drawn from a seeded generator."""
    r = random.Random(seed)
    given = sorted(GIVEN)
    syllables = "ba be bo da de do fa fi ga go ha he ka ke ki la le lo ma me mo na ne no pa pe ra re ri sa se so ta te to va ve wa wi za ze".split()
    ends = "berg ski son ova mann ez ini ard ham ton ley sen moto elli ov ier us an or in".split()
    up = lambda s: s[:1].upper() + s[1:]
    place = lambda: up("".join(r.choice(syllables) for _ in range(r.randint(2, 3))) + r.choice("nlrstmkd"))
    surname = lambda: up("".join(r.choice(syllables) for _ in range(r.randint(1, 2))) + r.choice(ends))
    onsets, ends_of_given = "sh xi ngu bri cai tha dmi oke ye zh mbe fio sau quy aoi tri kir gud hre lju".split(), "an en on ia ie ena ura iko ish esh ell eth oma ard us yen oor il am ys".split()
    stranger = lambda: up(r.choice(onsets) + r.choice(["", *syllables]) + r.choice(ends_of_given))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    filler = lambda: r.choice(["The limit was raised again.", "Values above 42 are rejected.", "See the guide for the score band.", f"Our {place()} environment is small.", "[2024-03-02T10:11:12Z] member-0042: ok,", f"Set `pool.max` to {d(3)} first.", ""])

    def email():
        user = r.choice([r.choice(given), f"{place().lower()}.{d(1)}", f"{place().lower()}_ops{d(2)}", f"{place().lower()}-desk+tag"])
        host, top = r.choice([place().lower(), f"{place().lower()}-mail", f"mx.{place().lower()}"]), r.choice(["example", "test", "com", "org", "de", "invalid", "net"])
        sep = r.choice(["@", "@", "@", "@", "(at)", " [at] ", " AT ", " at ", " @ "])
        out = f"{user}{sep}{host}{r.choice([' dot ', ' DOT ', '.', '(dot)']) if sep.strip().lower() in ('at',) else '.'}{top}"
        return out.upper() if r.random() < 0.15 else out

    def phone():
        return r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1.{d(3)}.{d(3)}.{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)} ext. {d(2)}", f"555-{d(4)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"+49 {d(2)} {d(5)} {d(3)}", f"0049-{d(2)}-{d(5)}-{d(3)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"tel:+1{d(6)} {d(4)}", f"0{d(3)}/{d(6)}", f"+{d(2)} {d(9)}", f"{d(3)}-{d(3)}-{d(4)}"])

    def number():
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"ZZ{d(6)}", f"X{d(7)}", f"QQ{d(6)}D", f"QQ {d(2)} {d(2)} {d(2)} C", f"{d(6)}-{d(4)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"L{d(3)}X{d(4)}", f"AB{d(7)}XX", f"{up(r.choice('abcdefgh'))}{d(8)}", f"{d(8)}{r.choice('ABCDEFGH')}"])

    def address():
        city, zip_ = place(), d(5)
        out = r.choice([f"{d(3)} {place()} {r.choice(['Street', 'Road', 'Avenue', 'Lane', 'Crescent', 'Drive'])}, {city}", f"{d(2)} {place()} St., {city}", f"{d(3)} {place()} St{chr(10)}{city} {zip_}", f"{d(2)} {place()} St {city} {zip_}", f"{d(2)} {place()} Ave., Suite {d(3)}, {city}", f"{r.randint(1, 200)}, rue {place()}, {zip_} {city}", f"{place()}straße {d(2)}a, {zip_} {city}", f"{place()}weg {d(2)}, {zip_} {city}", f"Calle {place()} {d(2)}, {zip_} {city}", f"Flat {d(2)}, {d(2)} {place()} Road, {city}", f"{d(3)}B {place()} Street, {city} {zip_}", f"{r.randint(1, 250)}{r.choice('ABC')} {place()} {r.choice(['Street', 'Road', 'Lane'])}, {city}", f"{r.randint(1, 250)} {place()} Crescent, {city}", f"{r.randint(1, 250)} {place()} {place()} Road, {city}"])
        return out.upper() if r.random() < 0.2 and "ß" not in out else out.lower() if r.random() < 0.08 else out

    def name():
        g = up(r.choice(given)) if r.random() < 0.6 else stranger()
        s = surname() if r.random() < 0.7 else stranger()
        out = r.choice([f"{g} {s}", f"{g} {s}", f"{g} {r.choice('ABDEKLMT')}. {s}", f"{r.choice('ABDEKLMT')}. {s}", f"Dr {g} {s}", f"Ms {s}", f"Mr. {s}", f"Herr {s}", f"{s}, {up(r.choice(given))}", f"{surname()}, {up(r.choice(given))}", f"{g} {s} {surname()}", f"{g} {r.choice(['de', 'van', 'von', 'di', 'al', 'de la', 'van der'])} {s}"])
        return out.upper() if r.random() < 0.12 else out

    say = {
        "email": ["Send the export to {} before noon.", "Replies please to {}", "Owner mailbox: {}.", "You can reach the desk at {}, even at night.", "Write to <{}> today.", "Contact {} about it.", "It went to {} and stayed there.", "{} did not answer.", "cc <{}> on every change.", "Noted {} in the log.", "Use {} instead."],
        "phone": ["Call {} if it stays red.", "Ring {} and ask for the desk.", "The caller left {} as a number.", "Fax and voice end at {}.", "Out of hours: {}.", "She wants a text message on {} later.", "Phone {} now.", "{} is the hotline.", "Noted {} in the log.", "Contact card: @, {}.", "Contact card: @, {}. It is kept.", "Contact card: @, {}"],
        "id_number": ["The caller was verified with passport number {} today.", "Customer quoted SSN {} in the form.", "Matched on {}, no second hit.", "Record opened under identity card {}.", "Please delete social security number {} from the field.", "Scan shows driving licence {}, expired.", "Tax id {} was seen.", "Personal number {} is on file.", "Record opened under {}.", "Noted {} in the log.", "It shows {} twice."],
        "address": ["Letters still go to {}.", "Lives at {} according to the form.", "Courier was sent to {}, twice.", "Delivery address on file: {}.", "The branch moved to {} last month.", "Ship the token to {}.", "Noted {} in the log.", "Contact card: Ann Bell, {}, 555-0100."],
        "name": ["{} approved the change window.", "The request was signed by {}.", "Ask {} about the weights.", "Please loop in {} from the billing desk.", "According to {}, the job had failed.", "Escalate to {} when the queue is full.", "Thanks for the quick check, {}!", "Contact card: {}, {}.", "{} said so.", "Reviewed by {} on Monday.", "Then {} left the room.", "Noted {} in the log.", "It was signed by {}.", "Please escalate to {} today.", "Dear {},", "I met {} at noon.", "{} had asked for it.", "{} approved it.", "{} signed it today.", "{} confirmed the date.", "{} wrote to the desk.", "{} reviewed the rule."],
    }
    make = {"email": email, "phone": phone, "id_number": number, "address": address, "name": name}
    versions = lambda: ".".join(d(1) for _ in range(r.randint(2, 4)))
    never = {
        "email": [lambda: f"The package rules@{versions()} replaces it.", lambda: "Use user@tenant as the key pattern.", lambda: "Mention @oncall in the room.", lambda: f"Pin loader@{versions()} now.", lambda: f"Look at {place()} now.", lambda: f"It stopped at {place()}. Then it went on.", lambda: f"The job was at step.{d(1)} of it.", lambda: f"Meet at {place()}.Next item", lambda: f"host root@{place().lower()} in the shell"],
        "phone": [lambda: f"Job id 00{d(r.randint(1, 4))}-11-{d(r.randint(2, 5))} was replayed.", lambda: f"Job id 0{d(r.randint(3, 6))}-{d(2)}-{d(r.randint(3, 5))} was replayed.", lambda: f"The counter read 555 0{d(r.randint(2, 4))} before the reset.", lambda: f"Order reference {d(4)}-{d(r.randint(2, 4))}-{d(r.randint(2, 4))} has no owner.", lambda: f"Job id {d(4)}-{d(2)}-{d(3)} was replayed.", lambda: f"Order reference {d(4)}-{d(2)}-{d(2)} has no owner.", lambda: f"Build 2024.{d(4)}.{d(2)} answers on 10.0.{d(2)}.12 now.", lambda: f"The counter read {d(3)} {d(3)} {d(3)} before the reset.", lambda: f"INC-{d(4)}-{d(3)} is open.", lambda: f"[2024-0{r.randint(1, 9)}-1{d(1)}T{d(2)}] now", lambda: f"From 2024-01-1{d(1)} to 2025-02-0{d(1)}.", lambda: f"Totals {d(6)},{d(6)},{d(7)} follow.", lambda: f"Serial {d(4)}-{d(4)}-{d(4)} passed.", lambda: f"Job id {d(6)}-11-{d(4)} was replayed.", lambda: f"{d(6)} {d(6)} rows", lambda: f"Matched on SSN {d(3)}-{d(2)}-{d(4)}.", lambda: f"Tax id {d(2)} {d(3)} {d(3)} {d(3)} was quoted.", lambda: f"personal number {d(6)}-{d(4)} in the form"],
        "id_number": [lambda: f"Job id 0{d(r.randint(3, 6))}-{d(2)}-{d(r.randint(3, 5))} was replayed.", lambda: f"Order reference {d(4)}-{d(r.randint(2, 4))}-{d(r.randint(2, 4))} has no owner.", lambda: f"The counter read 555 0{d(r.randint(2, 4))} before the reset.", lambda: f"Job id {d(4)}-{d(2)}-{d(3)} was replayed.", lambda: f"Order reference {d(4)}-{d(2)}-{d(4)} has no owner.", lambda: f"Build 2024.{d(4)}.{d(2)} answers.", lambda: f"The counter read {d(3)} {d(3)} before.", lambda: f"INC-{d(4)}-{d(3)} is open.", lambda: f"On 2024-0{r.randint(1, 9)}-1{d(1)} it ran.", lambda: f"Totals {d(6)},{d(6)},{d(7)} follow.", lambda: f"Call +1 ({d(3)}) {d(3)}-{d(4)} now.", lambda: f"Ring 0049-{d(2)}-{d(5)}-{d(3)}.", lambda: f"Phone +34 {d(3)} {d(3)} {d(3)}.", lambda: f"tel {d(3)}-{d(4)} works", lambda: f"Commit {d(3)}AB{d(5)} is bad.", lambda: f"Courier to 12, rue {place()}, {d(5)} {place()}", lambda: f"{d(3)} 2024 and {d(4)} rows", lambda: f"hash A{d(7)}"],
        "address": [lambda: f"Read Section {d(2)} Road Map in the guide.", lambda: f"Step {d(2)}, Lane view, shows {d(2)} rows.", lambda: f"See {d(1)} {place()} Road Map today.", lambda: f"Row {d(2)} Street View Lane stays open.", lambda: f"After {d(2)} Requests Close Way early.", lambda: f"Chapter {d(1)} {place()} Place is long.", lambda: f"The {d(1)} jobs that drive the map are late.", lambda: f"After {d(2)} days of the long road it ended.", lambda: f"Some {d(2)} rules in a square were read."],
        "name": [lambda: f"In {place()} Console the map is open.", lambda: f"Read Section {d(2)} Road Map in {place()} Canvas.", lambda: f"{up(r.choice(given))} runs the {place()} Stream today.", lambda: f"The {place()} Rules team left.", lambda: f"Das Team {place()} prüft es.", lambda: f"For {place()} Hub, {place()} waits.", lambda: f"Open {place()}, pick the cache.", lambda: f"Seen by {place()} and {place()} on {place()}.", lambda: f"Tenants {place()}, {place()}, {place()} agree.", lambda: f"Step A. {place()} follows.", lambda: f"See plan B. Then stop.", lambda: f"Ask {up(r.choice(given))} about it.", lambda: f"Drive {d(1)}. {place()} goes on.", lambda: f"Use Dr Watson Gateway {versions()}.", lambda: f"Marlo Gateway {versions()} and {place()} Ledger agree.", lambda: f"{place()} {place()} is open.", lambda: f"It moved from {place()} {place()} to the south.", lambda: f"Known Issues of {place()} {place()} follow.", lambda: f"{place()} {place()} {versions()} is out.", lambda: f"Die Werte der {place()} {place()} stimmen.", lambda: f"Values by {place()} {place()} were read.", lambda: f"Tenant {place()} {place()} left."],
    }
    common = (
        "the a of and to in for with that it by from this which when how who no then into after before while only until between at as any its on or also covers keeps holds default active policy rule list days "
        "hours weight view group window record step open once read stays locked passed falls back every where rows two may must should shows such trace check first often slow small large new old"
    ).split()
    prose = lambda: up(" ".join(r.choice(common) for _ in range(r.randint(6, 14)))) + "."
    never["name"] += [prose, prose, lambda: prose().upper(), lambda: prose().upper(), lambda: prose().upper(), lambda: " ".join(map(up, prose().split()))]
    loud = lambda text: text.upper() if r.random() < 0.1 and len(text.upper()) == len(text) else text
    out = []
    for kind in KINDS:
        for i in range(size):
            pre, post = filler(), filler()
            if i % 2:
                body = r.choice(never[kind])()
                text = f"{pre} {body} {post}"
                out.append((kind, loud(text), []))
            else:
                form, value = r.choice(say[kind]), make[kind]()
                form = form.replace("@", f"{name()}, {address()}")
                head = form.split("{}")[0]
                rest = form[len(head) + 2 :].replace("{}", address())
                text = f"{pre} {head}{value}{rest} {post}"
                start = len(pre) + 1 + len(head)
                out.append((kind, loud(text), [(kind, start, start + len(value))]))
    return out


@lru_cache(maxsize=1)
def fit_models(size: int = SAMPLE, seed: int = 5) -> dict[str, tuple[Trees, float]]:
    """kind to (trees, threshold), fitted on three quarters of the labelled sample, thresholds set on the rest."""
    data: dict[str, tuple[list, list]] = {k: ([], []) for k in KINDS}
    for kind, text, true in labelled_sample(size, seed):
        for k, start, end in propose(text):
            if k != kind and not true:
                continue
            hit = any(t == k and start < e and s < end and min(end, e) - max(start, s) >= 0.6 * (e - s) for t, s, e in true)
            if k != kind and not hit and true and any(start < e and s < end for _, s, e in true) is False:
                continue
            data[k][0].append(_shape(text, text[start:end], start, end, k))
            data[k][1].append(float(hit))
    out = {}
    for k, (x, y) in data.items():
        x, y = np.array(x, dtype=float), np.array(y)
        order = np.random.RandomState(seed).permutation(len(y))
        cut = len(y) * 3 // 4
        model = Trees().fit(x[order[:cut]], y[order[:cut]])
        p, t = model.predict(x[order[cut:]]), y[order[cut:]]
        marks = np.linspace(0.1, 0.9, 33)
        f1 = [2 * ((p >= m) & (t == 1)).sum() / max(1, (p >= m).sum() + (t == 1).sum()) for m in marks]
        top = [m for m, v in zip(marks, f1) if v >= max(f1) - 1e-9]
        out[k] = (model, float(np.clip(np.median(top), 0.3, 0.7)))
    return out


def _odds(p: float) -> float:
    """Log odds, by which the calibrated kinds compare."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def detect(texts: list[str | None], models: dict) -> list[list[tuple[int, int, str]]]:
    """Non-overlapping (start, end, kind) of each text."""
    spans: dict[str, tuple[list, list]] = {k: ([], []) for k in KINDS}
    for i, text in enumerate(texts):
        for kind, start, end in propose(text) if text else ():
            spans[kind][0].append((i, start, end))
            spans[kind][1].append(_shape(text, text[start:end], start, end, kind))
    chosen: list[list] = [[] for _ in texts]
    for kind, (at, x) in spans.items():
        if not at:
            continue
        model, threshold = models[kind]
        for (i, start, end), p in zip(at, model.predict(np.array(x, dtype=float))):
            if p >= threshold:
                chosen[i].append((_odds(p) - _odds(threshold), start, end, kind))
    out = []
    for items in chosen:
        taken: list[tuple[int, int, str]] = []
        for _, start, end, kind in sorted(items, key=lambda c: (-round(c[0], 2), c[1] - c[2])):
            if all(end <= s or e <= start for s, e, _ in taken):
                taken.append((start, end, kind))
        out.append(sorted(taken))
    return out


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for start, end, kind in spans:
        out += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join(out) + text[last:]


def _findings(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    models = fit_models()

    @F.pandas_udf("kinds array<string>, redacted string")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = [t if isinstance(t, str) else None for t in texts]
        spans = detect(rows, models)
        return pd.DataFrame({"kinds": [sorted({k for *_, k in s}) for s in spans], "redacted": [None if t is None else redact_text(t, s) if s else t for t, s in zip(rows, spans)]})

    rows = records.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text"))
    return rows.select("record_id", find("text").alias("f")).select("record_id", "f.*")


def found_pii(chunks: DataFrame, qa: DataFrame) -> DataFrame:
    """p3_found: (record_kind, record_id, pii_type), distinct."""
    a = _findings(chunks, "chunk_id", "text").select(F.lit("chunk").alias("record_kind"), "record_id", F.explode("kinds").alias("pii_type"))
    b = _findings(qa, "qa_id", "answer").select(F.lit("qa").alias("record_kind"), "record_id", F.explode("kinds").alias("pii_type"))
    return a.unionByName(b).distinct()


def redacted(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(record_id, redacted, kinds) of the distinct records, texts with placeholders."""
    return _findings(records.select(id_col, text_col).distinct(), id_col, text_col)
