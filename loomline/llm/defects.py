"""Problem 4: answers that do not answer their question.

Distinct answers are sorted by text over range partitions, where all extensions of a text follow it. An answer without a
final mark is looked up once for each way in which a sentence goes on (a letter, a space, a comma ...): the neighbour that
follows there has a common prefix with it as long as the answer exactly if the answer is a shortened version. Lengths at which unusually
many answers stop give the length limits of the producer. Both facts join the record, and rules decide in one Arrow
pass: stand-ins for nothing, refusals, copies of the question, language by function words, and the shape of the end.

Results by case: a record has at most one defect, in the order empty_answer, copies_question, refusal, other_language,
truncated_answer; null and blank answers are empty; a null or blank question has no language and copies nothing;
repeated rows count once; a repeated id with different texts gives a row for each defect found.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.skew import hub_join
from loomline.session import Stage

#: Shortened answers are broadcast up to so many rows (an answer each), counted before.
BROADCAST_ROWS = 20_000

#: Answers that only stand for nothing, after removal of brackets, quotes and punctuation.
EMPTY = frozenset(
    "n a|na|none|null|nil|nan|tbd|tba|todo|answer|the answer|your answer|answer here|no answer|no response|not available|not applicable|unknown|"
    "empty|blank|undefined|pending|missing|placeholder|response|reply|see above|keine antwort|sans réponse|sin respuesta|k a|nichts|nada|rien".split("|")
)
#: The wording of a refusal.
_CANNOT = r"(?:can(?:not|['’]t|\s+not)|could\s?n[o'’]?t|am\s+(?:un|not\s+)able\s+to|am\s+not\s+in\s+a\s+position\s+to|won['’]t|will\s+not|must\s+decline\s+to|do\s+not|don['’]t)"
REFUSAL = (
    rf"^(?:i\s*['’]?\s*a?m\s+(?:so\s+|very\s+)?sorry|(?:my\s+)?apolog(?:ies|ise|ize)|i\s+apologi[sz]e|sorry|unfortunately|regrettably)\b.{{0,30}}?\bi\s+{_CANNOT}\b",
    rf"^i\s+{_CANNOT}\s+(?:help|assist|answer|provide|find|say|discuss|comment|share|give|tell|see|locate|determine|know|have|support|respond)\b",
    rf"^as\s+an?\s+(?:ai|language\s+model|assistant|automated)\b.{{0,60}}\b(?:{_CANNOT}|not\s+able|unable)\b",
    r"^(?:i['’]d|i\s+would)\s+(?:rather|prefer)\s+not\b|^i\s+(?:have\s+to|must)\s+decline\b|^i\s+(?:decline|refuse)\b",
    r"\bso\s+i\s+(?:have\s+to|must)\s+decline\b|\bi\s+(?:have\s+to|must)\s+decline\b",
    r"\bgoes\s+against\s+my\s+(?:guidelines|policy|policies|rules)\b|\bagainst\s+my\s+guidelines\b",
    r"^(?:the|this|that)\s+(?:answer|question|request|information|topic)?\s*(?:is|are|can)\s*(?:not|beyond|outside)\b.{0,60}\b(?:context|document|text|scope|answered|provided)\b",
    r"^(?:the\s+)?(?:provided\s+|given\s+|above\s+)?(?:text|context|document|passage|chunk|excerpt|source)s?\s+(?:does|do|did)\s*(?:not|n['’]t)\s+(?:contain|say|mention|provide|state|cover|include|specify|explain|answer)\b",
    r"^there\s+is\s+(?:no|not\s+enough|insufficient)\s+(?:information|context|data|answer)\b|^(?:no|insufficient|not\s+enough)\s+(?:information|context|data)\b",
    r"^no\s+answer\s+(?:is\s+|can\s+be\s+)?(?:possible|available|given|provided|found)\b",
    r"^it\s+is\s+not\s+clear\s+from\s+the\b|^it\s+(?:is\s+)?(?:cannot|not\s+possible\s+to)\s+(?:be\s+)?(?:answer|determin)",
    r"^(?:leider|tut\s+mir\s+leid|entschuldigung)\b.{0,40}\b(?:kann|darf|nicht)\b|^(?:dazu|darüber|hierzu)\s+(?:kann|darf)\s+ich\b|^ich\s+(?:kann|darf|möchte)\b.{0,60}\bnicht\b|^als\s+ki\b",
    r"^(?:désolée?|je\s+(?:suis\s+)?(?:désolée?|regrette)|malheureusement)\b|^je\s+ne\s+(?:peux|puis|suis|sais)\b|^en\s+tant\s+qu['’]ia\b",
    r"^(?:lo\s+siento|lamento|lamentablemente|perd[óo]n)\b|^no\s+(?:puedo|dispongo|estoy|s[ée])\b|^como\s+(?:una\s+)?ia\b",
)
#: Lead-ins before a repeated question.
LEAD = r"(?i)^\W*(?:(?:your\s+)?question|q|frage|pregunta|you\s+(?:ask(?:ed)?|wrote|want\s+to\s+know)|user|asked)\s*[:\-–]\s*"
TAIL = r"(?i)\s*(?:answer|a|antwort|réponse|respuesta)\s*:\s*$"
#: Function words by language, of words that are common in one of them only.
FUNCTION_WORDS = {
    "en": "the of and to is in for with that by it be from are this which when how what why does can where who no then into has have was were been after before while you your than only too until either between if at as any its on or",
    "de": "der die das und ist nicht ein eine einer eines wird für auf mit von dem den des nach im muss dass sich bleibt zu bei wenn ob wie warum wann wo obwohl wurde werden sobald nur bevor durch falls ohne hat noch einmal zum zur darf erst schon bereits sowie auch beim vom oder als am",
    "fr": "le les du et est une dans pour que qui ne pas sur avec au aux par reste être l d n s quand pourquoi comment où faut il soit alors sans après avant si ce cette son sa leur été bien déjà fait dès sont aussi ou mais depuis ainsi peut doit",
    "it": "il lo gli della delle dei degli nel nella che di è sono per con una non si al dal dalla sul sulla questo questa quando perché dove come anche più viene deve può prima dopo senza fino",
    "pt": "os as da das do dos na no nas nos em uma um que não é são para com por se ao à foi ser quando porque onde como também mais deve pode antes depois sem até isso esta este",
    "nl": "het een van en niet voor met op zijn wordt worden aan door naar bij om als dan ook maar deze dit wat wanneer waarom waar hoe heeft hebben moet kan nog geen alleen voordat",
    "es": "el los las del y una en para por con se al sin queda ser tras cuando qué cómo dónde hay por aunque ya que ha sido hace sea su sus tienen según también pero desde puede debe antes después hasta lo si vale es muy solo",
}
#: Scripts that decide a language by themselves.
SCRIPTS = {
    "han": "\u3400-\u4dbf\u4e00-\u9fff", "kana": "\u3040-\u30ff", "hangul": "\u1100-\u11ff\uac00-\ud7af", "cyrillic": "\u0400-\u052f", "greek": "\u0370-\u03ff", "arabic": "\u0600-\u06ff\u0750-\u077f",
    "hebrew": "\u0590-\u05ff", "devanagari": "\u0900-\u097f", "thai": "\u0e00-\u0e7f",
}
_SCRIPTS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES = {w: [k for k, s in _SETS.items() if w in s] for s in _SETS.values() for w in s}
_WORD = re.compile(r"[^\W_]+")
_CODE = re.compile(r"```.*?```|`[^`\n]*`", re.S)
_SPLIT = [alternative for p in REFUSAL for alternative in re.split(r"\|(?=\^|\\b)", p)]
_REFUSAL_START = re.compile("(?is)" + "|".join(f"(?:{p})" for p in _SPLIT if p.startswith("^")))
_REFUSAL_INSIDE = re.compile("(?is)" + "|".join(f"(?:{p})" for p in _SPLIT if not p.startswith("^")))
#: Without one of these (the letters are what (?i) takes for an i or s) no pattern that may begin inside a text matches.
_INSIDE_HINTS = ("declin", "against", "ı", "i̇", "ſ")
_LEAD, _TAIL = re.compile(LEAD), re.compile(TAIL)
#: A text may stop after these: sentence marks, closing quotes and brackets, code.
_ENDED = re.compile(r"(?:[.!?…。！？][\"'”’»)\]*_]*|[)\]\"”’»`;])$")
#: Ends that need no mark: list items, assignments, addresses, links, numbers with a label.
_BARE_END = re.compile(
    r"(?:(?:^|\n)\s*(?:[-*•]|\d+[.)])\s+[^\n]*|[\w.\-]+\s*=\s*[^\s,(]+|\S+@\S+\.\w+|\S+\s+(?:AT|at|\(at\)|\[at\])\s+\S+\s+(?:DOT|dot|\(dot\)|\[dot\])\s+\w+|https?://\S+|(?:^|\n)\s*\|[^\n]*\|?|[\U0001F300-\U0001FAFF☀-➿️‍]+)$"
)
#: A postal address as the last sentence.
_ADDRESS_END = re.compile(
    r"(?:\b\d{1,4}\s?[A-Za-z]?,?\s+(?:rue|avenue|boulevard|calle|via|plaza|chemin|place)\b[^.\n]*"
    r"|\b\d{1,4}[A-Za-z]?\s+(?:[A-Z]\w+\s+){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Court|Way|Square|Close)\b[^.\n]*"
    r"|\b(?:[A-ZÄÖÜ][\wäöüß]*(?:straße|strasse|weg|gasse|platz|allee)|(?:Am|An der|Im|Calle|Via|Avenida)\s+\w+),?\s+\d{1,4}[^.\n]*)$"
)
#: Of those, ends that are whole at any length: a closed table row, pictures.
_WHOLE_END = re.compile(r"(?:(?:^|\n)\s*\|[^\n]*\||[\U0001F300-\U0001FAFF☀-➿️‍]+)$")
#: Marks that end no sentence, after abbreviations and the numbers of a list.
_OPEN_MARK = re.compile(r"(?:\b(?:e\.\s?g|i\.\s?e|cf|vs|approx|incl|resp|fig|no|dr|mr|mrs|prof|st|z\.\s?b|d\.\s?h|bzw|ca|p\.\s?ej|p\.\s?ex)\.|(?:^|\n)\s*\d{1,3}[.)])$", re.I)


def languages(text: str) -> frozenset[str]:
    """The languages that a text may be in: a script, or those whose function words are nearly as frequent as the most frequent; empty if nothing decides."""
    plain = _CODE.sub(" ", text)
    if not plain.isascii():
        letters = sum(c.isalpha() for c in plain)
        for name, pattern in _SCRIPTS.items():
            if (n := len(pattern.findall(plain))) >= 6 and 2 * n >= letters:
                return frozenset(["han", "kana"] if name in ("han", "kana") else [name])
    words = _WORD.findall(plain.casefold())
    if len(words) < 4:
        return frozenset()
    score = dict.fromkeys(_SETS, 0)
    for word in words:
        for k in _LANGUAGES.get(word, ()):
            score[k] += 1
    first = max(score.values())
    if first < max(2, 0.12 * len(words)):
        return frozenset()
    return frozenset(k for k, n in score.items() if 1.3 * n > first)


def language(text: str) -> str | None:
    """The language of a text, None if there is none or more than one."""
    found = languages(text)
    return next(iter(found)) if len(found) == 1 else None


def copies(question: str, answer: str, new: float = 0.12) -> bool:
    """Whether an answer says no more than the question: at most ``new`` of its words are not in the question."""
    body = _LEAD.sub("", _TAIL.sub("", answer.strip())).casefold()
    own, asked = _WORD.findall(body), set(_WORD.findall(question.casefold()))
    if len(own) < 4 or not asked:
        return bool(own) and len(own) < 4 and len(asked) > 3 and " ".join(own) in " ".join(_WORD.findall(question.casefold()))
    return sum(w not in asked for w in own) <= new * len(own)


def is_empty(answer: str | None) -> bool:
    words = " ".join(_WORD.findall((answer or "").casefold()))
    return not words or words in EMPTY


def is_refusal(answer: str) -> bool:
    """Whether an answer declines; patterns that begin with ^ are tried at its start only."""
    if _REFUSAL_START.match(answer):
        return True
    low = answer.lower()
    return any(h in low for h in _INSIDE_HINTS) and bool(_REFUSAL_INSIDE.search(answer))


def unfinished(answer: str, shortened: bool, spike: bool) -> bool:
    """Whether an answer stops inside a sentence or word; ``spike``: it has a length at which unusually many stop without a mark."""
    text = re.sub(r"[\s​-‏⁠﻿]+$", "", answer)
    if shortened:
        return True
    tail = text.rsplit("\n", 1)[-1]
    tail = tail if len(tail) <= 240 else "…" + tail[-240:]
    if text.endswith("```"):
        return False
    if not _ENDED.search(tail[-8:]):  # at a length where answers are cut off, an end without a mark is a cut
        return not (_WHOLE_END if spike else _BARE_END).search(tail) and (spike or not _ADDRESS_END.search(tail))
    return text.count("`") % 2 == 1 or (spike and bool(_OPEN_MARK.search(tail)))


def defect(question: str | None, answer: str | None, shortened: bool = False, spike: bool = False) -> str | None:
    """The defect type of a pair, None if it has none."""
    if is_empty(answer):
        return "empty_answer"
    q, a = question or "", answer.strip()
    if copies(q, a):
        return "copies_question"
    if is_refusal(a):
        return "refusal"
    asked, said = languages(q), languages(a)
    if asked and said and not asked & said:
        return "other_language"
    return "truncated_answer" if unfinished(a, shortened, spike) else None


#: How a sentence goes on after a letter or digit: the next character, or the first of a range of letters.
GOES_ON = (" ", "'", "’", "(", ",", ";", ":", "-", "0", "A", "a", "\u00aa", "\u00c0")


def shortened_answers(answers: DataFrame) -> DataFrame:
    """(answer, shortened: true) of the distinct ``answers`` (answer) of at least 20 characters of which another one goes on inside a sentence.

    What follows an answer in the order of texts need not be the extension that goes on, so each is looked up at every
    GOES_ON; one that ends in an opening mark or a comma goes on with anything.
    """
    long = answers.where(F.length("answer") >= 20).select("answer")
    bare, cut = F.col("answer").rlike(r"[\p{L}\p{N}]$|\d\.$"), F.col("answer").rlike(r"[,(:–-]$")
    ends = F.when(bare, F.array(*[F.lit(c) for c in GOES_ON])).when(cut, F.array(F.lit("\x01")))
    probes = long.where(bare | cut).select(F.col("answer").alias("of"), F.explode(ends).alias("end"))
    probes = probes.select(F.concat("of", "end").alias("key"), F.lit(0).alias("kind"), F.length("of").alias("size"))
    both = answers.select(F.col("answer").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("size")).unionByName(probes)
    wide = Stage(both.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sorted").df
    back = Window.partitionBy("part").orderBy(F.desc("key"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    text = F.when(F.col("kind") == 1, F.col("key"))
    firsts = wide.groupBy("part").agg(F.min(text).alias("first"))
    nexts = firsts.select("part", F.last("first", ignorenulls=True).over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("next_first"))
    found = wide.withColumn("inside", F.last(text, ignorenulls=True).over(back)).where("kind = 0").join(F.broadcast(nexts), "part")
    follow, own = F.coalesce("inside", "next_first"), F.substring("key", F.lit(1), F.col("size"))
    rest = F.substring(follow, F.col("size") + 1, F.lit(40))
    on = F.when(own.rlike(r"[,(:–-]$"), rest != "").when(own.rlike(r"\.$"), rest.rlike(r"^[\p{L}\p{N}]")).otherwise(rest.rlike(r"^[\p{L}\p{N}'’-]|^[ ,;:(]"))
    return found.where(F.startswith(follow, own) & on).select(own.alias("answer")).distinct().withColumn("shortened", F.lit(True))


def length_spikes(answers: DataFrame, least: int = 20, factor: float = 4.0, around: int = 10) -> DataFrame:
    """(length) at which ``factor`` times as many answers stop without a mark as on average at the lengths ``around`` it.

    Each holds at least 1/10,000 of all answers, so there are at most 10,000.
    """
    least = max(least, answers.count() // 10_000)
    bare = answers.where(~F.col("answer").rlike(r"[.!?…\"')\]”’»`]\s*$")).groupBy(F.length("answer").alias("length")).agg(F.count("*").alias("n"))
    near = bare.select(F.explode(F.sequence(F.col("length") - around, F.col("length") + around)).alias("length"), "n").groupBy("length").agg(F.sum("n").alias("around"))
    total = bare.join(near, "length")
    return total.where((F.col("n") >= least) & (F.col("n") >= factor * (F.col("around") - F.col("n")) / (2 * around))).select("length")


def find_defects(records: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """(id_col, defect_type) of the defective records, distinct."""
    rows = records.select(F.col(id_col).alias("id"), "question", "answer").distinct()
    said = Stage(rows.where(F.col("answer").isNotNull()).select("answer").distinct(), "answers").df
    short = shortened_answers(said)
    spikes = length_spikes(said)
    short = Stage(short, "short").df
    few = short.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    facts = rows.join(F.broadcast(short), "answer", "left") if few else hub_join(rows, short, "answer", "left")
    facts = facts.withColumn("length", F.length("answer"))
    facts = facts.join(F.broadcast(spikes.withColumn("spike", F.lit(True))), "length", "left")

    @F.pandas_udf("string")
    def kind(q: pd.Series, a: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([defect(*x) for x in zip(q, a, s, p)], dtype=object)

    no = F.lit(False)
    found = facts.select(
        F.col("id").alias(id_col), kind("question", "answer", F.coalesce("shortened", no), F.coalesce("spike", no)).alias("defect_type")
    )
    return found.where("defect_type is not null").distinct()
