"""Problem 10: template residue, filler, error pages and script notices.

A first pass in the JVM keeps texts that show any trigger at all. Those are cut into units (lines, then sentences); code
blocks and code spans are blanked first. Each placeholder style has a grammar of its own delimiters; a unit that
explains placeholders (stands for, is replaced, raw marker ...) is a tutorial and does not count. Filler, error messages
and script notices count by density: the words of such units against the words of all units that are neither page
furniture (menus, breadcrumbs, copyright lines) nor a heading. Genuine placeholders count at any density, as no finished
text contains one.

Results by case: null and blank texts are no cases; repeated ids give one row for each type found under them; a text
shows one type, in the order placeholder, script notice, error page, filler.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[A-Za-z][\w .-]{0,60}"
#: Placeholder grammars, by delimiter.
PLACEHOLDERS = (
    r"\{\{\s*[#/^]?" + _NAME + r"\s*\}\}",
    r"\$\{\s*" + _NAME + r"\s*\}",
    r"<%=?\s*" + _NAME + r"\s*%>",
    r"%[A-Z][A-Z0-9_]{2,40}%",
    r"@@\s*" + _NAME + r"\s*@@",
    r"\[\[\s*" + _NAME + r"\s*\]\]",
    r"\b__[A-Z][A-Z0-9_]{2,40}__\b",
    r"\bXX_[A-Z][A-Z0-9_]{1,40}_XX\b",
    r"\[(?i:(?:insert|enter|add|type|your|todo|tbd|name of)\b)[^\]\n]{0,60}\]",
    r"<[A-Z][A-Z0-9]*(?:[ _-][A-Z0-9]+)*>",
    r"«\s*[a-z][\w ]{0,40}»",
    r"(?<![\w{$`\"'/])\{[a-z][a-z0-9]*(?:_[a-z0-9]+)*\}(?![}\w])",
)
#: Words of a text that explains placeholders instead of containing them.
TUTORIAL = r"(?i)\b(?:stands?\s+for|replaced?|placeholders?|variables?|tokens?|markers?|resolved|substitut\w+|syntax|literal(?:ly)?|quotes|expands?|escaped?|interpolat\w+|rendered\s+as|syntax)\b"
#: Page furniture around the content.
FURNITURE = r"(?i)^(?:skip to (?:main )?content|(?:home|menu)\b[\w |>/·-]{0,80}|[\w ]{2,40}(?:\s+>\s+[\w &-]{2,40})+|©.{0,80}|copyright\b.{0,80}|all rights reserved\.?)$"
_FURNITURE_HEAD = r"(?i)^(?:skip to (?:main )?content|home(?: \| [\w ]+?)+? \| sign in|menu  search  account|[A-Z]\w+ \w+ > help > search|© \w+ documentation)[ \t]+"
_FURNITURE_TAIL = r"(?i)[ \t]+(?:skip to (?:main )?content|home(?: \| [\w ]+?)+? \| sign in|menu  search  account|\w+ \w+ > help > search|© \w+ documentation)$"
#: Script notices.
_SCRIPT = r"(?:java\s?script|(?:client-side\s+)?scripting|script\s+support|scripts?)"
SCRIPT = (
    rf"\b{_SCRIPT}\s+(?:is|are)\s+(?:missing|blocked|disabled|needed|required|switched\s+off|turned\s+off|not\s+(?:enabled|available|supported))\b",
    r"\b(?:enable|activate|allow|turn\s+on)\s+java\s?script\b(?!.{0,40}\bfor\s+the\s+embedded)",
    r"\bscripts?\s+must\s+be\s+(?:allowed|enabled)\b",
    rf"\brequires?\s+{_SCRIPT}\b",
    r"\bdoes\s+not\s+support\s+(?:java\s?)?script(?:ing)?\b",
    r"^noscript\b",
    r"\bjavascript\b.{0,60}\b(?:aktivieren|aktiviert)\b|\b(?:aktivieren|aktiviere)\b.{0,40}\bjavascript\b",
    r"\bactive[rz]?\s+javascript\b|\bhabilite\s+javascript\b",
)
SCRIPT_TAIL = r"(?i)^(?:please\s+change\s+the\s+browser\s+settings|allow\s+it\s+and\s+reload|turn\s+(?:it|them)\s+on\b.{0,40}|nothing\s+can\s+be\s+displayed.{0,20}|the\s+article\s+cannot\s+be\s+rendered.{0,20}|some\s+parts\s+of\s+the\s+guide\s+cannot.{0,20}|we're\s+checking\s+your\s+browser.{0,60})[.!]?$"
#: Error messages.
ERROR = (
    r"^(?:http|error|err|code|status|fehler|erreur|errore|c[óo]digo)\b[\s:#-]*(?:status\s+)?[1-5]\d\d\b(?!\s+(?:from|of|means)\b)",
    r"^[45]\d\d\s+(?:not\s+found|forbidden|unauthorized|service\s+unavailable|internal\s+server\s+error|bad\s+gateway|gateway\s+time-?out|bad\s+request|gone)\b",
    r"\bbad\s+gateway\s*\(5\d\d\)",
    r"^(?:oops\W+)?something\s+went\s+wrong\b",
    r"^access\s+denied\b|^you\s+don't\s+have\s+permission\s+to\b",
    r"\bpage\s+(?:was\s+|could\s+)?not\s+(?:be\s+)?found\b|\bthis\s+link\s+is\s+no\s+longer\s+valid\b",
    r"^the\s+(?:page|topic|document|article|resource)\s+(?:you\s+\w+\s+\w+\s+\w+\s+)?(?:was|is|has|could|cannot|does)\b.{0,30}\b(?:withdrawn|moved|gone|removed|exist|found|loaded|unavailable)\b",
    r"^too\s+many\s+requests\b|^rate\s+limit\s+reached\b",
    r"^the\s+\w+\s+server\s+is\s+(?:down|unavailable|overloaded)\b",
    r"\bseite\s+nicht\s+gefunden\b|\bpage\s+introuvable\b|\bp[áa]gina\s+no\s+encontrada\b|^der\s+angeforderte\s+artikel\b",
    r"^(?:your\s+)?session\s+(?:has\s+)?(?:expired|timed\s+out)\b",
    r"\bcette\s+page\s+n'est\s+pas\s+disponible\b|^it\s+may\s+have\s+been\s+(?:moved|removed)\b",
    r"^(?:no\s+such\s+\w+|too\s+many\s+redirects|no\s+further\s+details|request\s+timed\s+out)\b",
    r"^(?:document\s+unavailable|resource\s+gone|upstream\s+timed\s+out|request\s+rejected|the\s+upstream\s+service\s+did\s+not)\b",
    r"^(?:an?\s+)?(?:internal|unexpected|fatal)\s+(?:server\s+)?error\b",
    r"^(?:uncaught|unhandled)\s+\w*(?:exception|error)\b|^traceback \(most recent",
)
ERROR_TAIL = r"(?i)^(?:try\s+again\b.{0,40}|please\s+(?:retry|try|sign\s+in|reload)\b.{0,40}|go\s+back\s+to\b.{0,30}|return\s+to\s+the\s+start.{0,20}|reference\s+\w+|trace\s*:\s*\S+|vuelva\s+al\s+inicio|retournez\b.{0,40}|zur[üu]ck\s+zur\b.{0,30}|wait\s+\d+\s+seconds|oops|.{0,3})[.!]?$"
#: Stems of the usual filler Latin.
LATIN = (
    "lorem ipsum dolor sit amet consect adipisc elit sed eiusmod tempor incidid labor magna aliqu enim minim veniam quis nostrud exercit "
    "ullamco nisi commodo duis aute irure reprehend volupt velit cillum fugiat nulla pariatur except sint occaecat cupidat proident culpa "
    "offici deserunt mollit anim laborum curabit ultric fermen vestibul posuer lacinia viverra sodales pretium mattis semper ornare gravida "
    "pellentesq vivamus praesent maecenas phasell suspendiss fusce donec integer nullam mauris aenean"
).split()
#: Sentences that hold the place of text to come.
FILLER = (
    r"^placeholder\s+text\b", r"^content\s+coming\s+soon\b", r"^text\s+to\s+follow\b", r"^blah(?:\s+blah)+\b", r"\basdf\b",
    r"^(?:dummy|sample)\s+(?:text|heading|paragraph|title|content|body)\b", r"^(?:test\s+){2,}", r"^replace\s+this\s+(?:paragraph|text|sentence|section)\b",
    r"^describe\s+the\s+\w+\s+in\s+\w+\s+or\s+\w+\s+sentences\b", r"^(?:foo\s+bar|xxx+)\b", r"^(?:tbd|todo|to\s+be\s+(?:written|done|added))\b",
)

#: What every match of a grammar contains, so that no text without one of these is residue; tests hold an example of each alternative.
#: Literals of the lower-case text, for PLACEHOLDERS and SCRIPT.
TRIGGERS = ("{{", "${", "<%", "@@", "[[", "xx_", "[insert", "[enter", "[add", "[type", "[your", "[todo", "[tbd", "[name", "«", "script")
#: Placeholders whose delimiters are common characters, in the text as it is; and letters that (?i) takes for an s or i, unlike lower case.
TRIGGER_RE = r"%[A-Z][A-Z0-9_]{2,40}%|<[A-Z][A-Z0-9 _-]*>|\{[a-z][a-z0-9]*(?:_[a-z0-9]+)*\}|__[A-Z]|[\x{17f}\x{130}\x{131}]"
#: Beginnings at a word's start in the lower-case text: ERROR and FILLER in their order, LATIN last. What is white space in a
#: grammar is \W here, as \W is ASCII in the JVM and takes more; a span of code between two words may have any length, as it is blanked later.
_NEAR = r"(?:[^\n]{0,30}|[^\n]{0,30}[`~][\s\S]*)"
STARTS = (
    r"(?:http|err|error|errore|erreur|code|status|fehler|c[óo]digo)\W*(?:status\W+)?[1-5]\p{Nd}{2}",
    r"[45]\p{Nd}{2}\W+(?:not|forbidden|unauthorized|service|internal|bad|gateway|gone)",
    r"bad\W+gateway", r"something\W+went\W+wrong", r"access\W+denied", r"you\W+don't\W+have\W+permission",
    r"page\W+(?:was\W+|could\W+)?not\W+(?:be\W+)?found", r"this\W+link\W+is\W+no\W+longer\W+valid",
    r"the\W+(?:page|topic|document|article|resource)\W+(?:you\W[^\n]*\W)?(?:was|is|has|could|cannot|does)" + _NEAR + r"(?:withdrawn|moved|gone|removed|exist|found|loaded|unavailable)",
    r"too\W+many\W+re", r"rate\W+limit\W+reached", r"server\W+is\W+(?:down|unavailable|overloaded)",
    r"seite\W+nicht\W+gefunden", r"page\W+introuvable", r"p[áa]gina\W+no\W+encontrada", r"der\W+angeforderte",
    r"session\W+(?:has\W+)?(?:expired|timed)", r"cette\W+page\W+n'est\W+pas\W+disponible", r"it\W+may\W+have\W+been\W+(?:moved|removed)",
    r"no\W+such\W", r"no\W+further\W+details", r"request\W+(?:timed|rejected)", r"document\W+unavailable", r"resource\W+gone", r"upstream\W+timed",
    r"the\W+upstream\W+service\W+did", r"(?:internal|unexpected|fatal)\W+(?:server\W+)?error", r"(?:uncaught|unhandled)\W", r"traceback\W",
    r"placeholder\W+text", r"content\W+coming\W+soon", r"text\W+to\W+follow", r"blah\W+blah", r"asdf",
    r"(?:dummy|sample)\W+(?:text|heading|paragraph|title|content|body)", r"test\W+test\W", r"replace\W+this\W+(?:paragraph|text|sentence|section)",
    r"describe\W+the\W", r"foo\W+bar", r"xxx", r"tbd", r"todo", r"to\W+be\W+(?:written|done|added)",
    r"we're\W+checking",
)
_START_RE = r"(?<![a-z0-9_])(?:" + "|".join((*STARTS, *LATIN)) + ")"


_PLACE = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS))
_TUTORIAL, _FURN = re.compile(TUTORIAL), re.compile(FURNITURE)
_HEAD, _TAIL = re.compile(_FURNITURE_HEAD), re.compile(_FURNITURE_TAIL)
_SCRIPT_RE = re.compile("(?i)" + "|".join(f"(?:{p})" for p in SCRIPT))
_ERROR_RE = re.compile("(?i)" + "|".join(f"(?:{p})" for p in ERROR))
_FILLER_RE = re.compile("(?i)" + "|".join(f"(?:{p})" for p in FILLER))
_SCRIPT_TAIL, _ERROR_TAIL = re.compile(SCRIPT_TAIL), re.compile(ERROR_TAIL)
_LATIN = re.compile(r"(?i)\b(?:" + "|".join(LATIN) + r")\w*")
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`", re.S)
_WORD = re.compile(r"[^\W_]+")
#: A section heading "Name Name: term Name" in front of the first sentence.
_HEADING = re.compile(r"(?:[A-Z]\w+ ){1,2}?[A-Z]\w+: (?:[a-z][\w-]* ){1,3}[A-Z]\w+(?:\s+|$)")
_UNIT = re.compile(r"\n+|(?<=[.!?])\s+")


def _words(text: str) -> int:
    return len(_WORD.findall(text))


def residue_type(text: str | None, title: str | None = None, density: float = 0.5, filler_density: float = 0.3) -> str | None:
    """The kind of residue that a text is, None if it is content."""
    if not text or not text.strip():
        return None
    body = _CODE.sub(" `` ", text)
    total = script = error = filler = 0
    headings = (title or "").strip().casefold()
    last = ""
    for unit in _UNIT.split(body):
        unit = unit.strip()
        unit = _TAIL.sub("", _HEAD.sub("", unit)).strip()
        if headings and unit.casefold().startswith(headings) and not re.match(r"\w\w", unit[len(headings) - 1 : len(headings) + 1]):
            unit = unit[len(headings) :].strip()
        elif heading := _HEADING.match(unit):
            unit = unit[heading.end() :].strip()
        if not unit or _FURN.match(unit):
            continue
        if _PLACE.search(unit) and not _TUTORIAL.search(_PLACE.sub(" ", unit)):
            return "placeholder"
        n = _words(unit)
        total += n
        if _SCRIPT_RE.search(unit) or (last == "script" and _SCRIPT_TAIL.match(unit)) or re.match(r"(?i)we're\s+checking", unit):
            script, last = script + n, "script"
        elif _ERROR_RE.search(unit) or (last == "error" and _ERROR_TAIL.match(unit)):
            error, last = error + n, "error"
        elif _FILLER_RE.search(unit):
            filler, last = filler + n, "filler"
        else:
            latin = len(_LATIN.findall(unit))
            filler += latin if latin >= 0.5 * n else 0
            last = ""
    if not total:
        return None
    if script >= density * total and script:
        return "script_notice"
    if error >= density * total and error:
        return "error_page"
    if filler >= filler_density * total and filler:
        return "filler"
    return None


def find_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = "title") -> DataFrame:
    """(id_col, residue_type), distinct."""

    @F.pandas_udf("string")
    def kind(texts: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([residue_type(t, h) for t, h in zip(texts, titles)], dtype=object)

    title = F.col(title_col).cast("string") if title_col and title_col in docs.columns else F.lit(None).cast("string")
    text = F.col("text")

    def shows(low):
        hit = text.rlike(TRIGGER_RE)
        for word in TRIGGERS:
            hit = hit | F.contains(low, F.lit(word))
        return hit | low.rlike(_START_RE)

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), title.alias("title")).where("text is not null")
    hits = rows.where(F.exists(F.array(F.lower(text)), shows))  # the lambda binds the lower-case text, so it is made once
    return hits.select(id_col, kind("text", "title").alias("residue_type")).where("residue_type is not null").distinct()


def without_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = "title") -> DataFrame:
    """``docs`` without the documents that are residue."""
    return docs.join(find_residue(docs, id_col, text_col, title_col).select(id_col).distinct(), id_col, "left_anti")
