"""Problem 5: noise in text from scanned pages.

Characters: a noisy channel. Confusions of a scanner (rn for m, 1 for l, c for e ...) are folded to one skeleton per word,
so a misread word and the word meant share a key; one join of the corpus vocabulary with itself by that key proposes
candidates. How likely each confusion is (what is read for what is meant) is estimated from the corpus: the candidate
pairs are aligned under a constant channel, and each confusion's share of what it stands for is its probability. Within a
line, Viterbi picks the words of the greatest channel probability times bigram likelihood; bigrams are smoothed towards
the counts of single words. Pairs are counted over all texts, for the pairs that suspicious lines ask for.

Lines: running headers are short title-like lines that several records of one file share (digits apart), or that
continue the file's title, product or chapter; page numbers have a grammar; code blocks are left alone. Words broken at
a line end are joined, unless both halves are words and the whole is none. Lines are then set as paragraphs.

Only bodies that show some evidence go through Python; the rest passes by. A markdown that contains the record's text
as it stands shares its result. Results by case: null and blank bodies have no noise and stay as they are; records of
other types than ``scanned`` take part in the counts only; repeated rows count once; a null source path falls back on the
file name in the metadata or in the reference.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.words import words
from loomline.session import Stage

#: Characters that scanners confuse, each mapped to the class that stands for all of them.
SINGLE_FROM, SINGLE_TO = "01l5c8h", "oiisebb"
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
SPELLED = (("d", "ei"), ("m", "rn"), ("u", "ii"), ("w", "vv"))
#: Probability that a character is misread, before the corpus has told.
MISREAD = 0.05
#: How much denser misread characters are in a noisy text than in the corpus, which the estimates are averages of; candidates gain by it.
DENSER = 30.0
#: Weight of the counts of single words in a bigram's smoothed count, as a divisor.
SMOOTHING = 50.0
#: Side tables are broadcast up to so many rows, counted before.
BROADCAST_ROWS = 200_000

ROMAN = r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_PAGE_WORDS = r"page|pages|pg\.?|p\.|seite|s\.|página|pagina|pág\."
_MARKS = r"[\s\-–—\[\](){}|.·*]"
_NUMBER = rf"(?:{_PAGE_WORDS})?\s*(?:\d{{1,4}}|{ROMAN})\s*(?:(?:of|/|von|de|sur|\|)\s*\d{{1,4}})?"
PAGE_LINE = re.compile(rf"(?i)^[\s\-–—\[\](){{}}|.·*]*{_NUMBER}[\s\-–—\[\](){{}}|.·*]*$")
PAGE_EDGE = re.compile(rf"(?i)^(?:(?:page|p\.|seite|página)?\s*\d{{1,4}}\s*[|·–—/-]\s*)|(?:\s{{2,}}|\s*[|·]\s*)(?:page|p\.|seite|página)?\s*\d{{1,4}}(?:\s*(?:of|/|von|de)\s*\d{{1,4}})?\W*$")
#: A line that PAGE_LINE may match, for the JVM: marks, an optional word for page, a number, an optional total, marks; a superset, as white space and marks mix.
_PAGE_SQL = rf"(?iUm)^{_MARKS}*(?:{_PAGE_WORDS})?\s*(?:\p{{Nd}}{{1,4}}|[ivxlc]+)\s*(?:(?:of|/|von|de|sur|\|)\s*\p{{Nd}}{{1,4}})?{_MARKS}*$"
_EDGE_SQL = r"(?i)^(?:(?:page|p\.|seite|página)?\s*\d{1,4}\s*[|·–—/-]\s*)|(?:\s{2,}|\s*[|·]\s*)(?:page|p\.|seite|página)?\s*\d{1,4}(?:\s*(?:of|/|von|de)\s*\d{1,4})?\W*$"
CHAPTER = re.compile(r"(?i)^(?:chapter|kapitel|chapitre|cap[íi]tulo|section|abschnitt|part)\s+(?:\d{1,3}|[ivxlc]+)\b[^.!?]{0,50}$")
BREAK = r"(\p{L}+)[-­‐¬][ \t]*(?:\r?\n)+[ \t]*(\p{Ll}+)"
#: What a broken word needs; starts at the hyphen, so it costs far less than the whole pattern.
BREAK_HINT = r"[-‐][ \t]*\r?\n|[\x{ad}¬]"
_HYPHENS = "-­‐¬"
_LIST = re.compile(r"^\s*(?:[-*•+]\s|\d{1,3}[.)]\s|#{1,6}\s|>|\||```|~~~)")
_TOKEN = re.compile(r"[^\W_]+")


def skeleton(word: Column) -> Column:
    """The key that words share if a scanner may confuse them."""
    key = F.lower(word)
    for a, b in LIGATURES:
        key = F.replace(key, F.lit(a), F.lit(b))
    key = F.translate(key, SINGLE_FROM, SINGLE_TO)
    for a, b in SPELLED:
        key = F.replace(key, F.lit(a), F.lit(b))
    return key


def skeleton_of(word: str) -> str:
    key = word.lower()
    for a, b in LIGATURES:
        key = key.replace(a, b)
    key = key.translate(str.maketrans(SINGLE_FROM, SINGLE_TO))
    for a, b in SPELLED:
        key = key.replace(a, b)
    return key


def _maybe(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def joined_words(body: Column) -> Column:
    """Words of a body, those broken at line ends in one piece."""
    return words(F.when(body.rlike(BREAK_HINT), F.regexp_replace(body, BREAK, "$1$2")).otherwise(body))


def vocabulary(split: DataFrame) -> DataFrame:
    """(word, n) over all bodies."""
    return split.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def confusions(word: str, meant: str) -> list[str]:
    """What was read for what, 'read<meant', where two words of one skeleton differ: the fewest pieces of at most two characters."""
    best: dict[tuple[int, int], tuple[int, tuple]] = {(len(word), len(meant)): (0, ())}
    for i in range(len(word), -1, -1):
        for j in range(len(meant), -1, -1):
            for a, b in ((1, 1), (2, 1), (1, 2), (2, 2)):
                x, y = word[i : i + a], meant[j : j + b]
                rest = best.get((i + a, j + b))
                if rest is None or len(x) < a or len(y) < b or not (x == y or skeleton_of(x) == skeleton_of(y)):
                    continue
                cost = rest[0] + (x != y) * (a + b)
                if (i, j) not in best or cost < best[i, j][0]:
                    best[i, j] = (cost, rest[1] if x == y else (f"{x}<{y}", *rest[1]))
    return list(best[0, 0][1]) if (0, 0) in best else [f"{word}<{meant}"]


def _confused(word: str, meant: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(words: pd.Series, meanings: pd.Series) -> pd.Series:
        return pd.Series([confusions(w, m) for w, m in zip(words, meanings)])

    return run(word, meant)


def channel(vocab: DataFrame, pairs: DataFrame) -> dict[str, float]:
    """Log probability of each confusion: how often it was seen against how often what it stands for was written.

    pairs: (n: count of the word read, ops). Confusions are made of the few characters that scanners confuse, so their
    table is small by definition.
    """
    seen = pairs.select("n", F.explode("ops").alias("op")).groupBy("op").agg(F.sum("n").alias("seen"), F.count("*").alias("words"))
    counts = {r["op"]: (r["seen"], r["words"]) for r in seen.where("words > 1").collect()}
    meant = sorted({op.split("<", 1)[1] for op in counts} - {""})
    if not meant:
        return {}
    times = lambda m: F.sum(F.col("n") * ((F.length("word") - F.length(F.replace("word", F.lit(m), F.lit("")))) / len(m)))
    written = vocab.agg(*[times(m).alias(f"m{i}") for i, m in enumerate(meant)]).first()
    total = {m: float(written[i] or 0.0) for i, m in enumerate(meant)}
    out = {}
    for op, (n, _) in counts.items():
        base = total.get(op.split("<", 1)[1]) or sum(total.values())
        out[op] = math.log(min(0.5, (n + 0.5) / (base + n + 1.0)))
    return out


def candidates(vocab: DataFrame) -> DataFrame:
    """(word, cand, score, own): words that a scanner may have made of more likely ones; scores are log counts expected."""
    keyed = vocab.where(F.col("word").rlike(r"\p{L}") & (F.length("word") >= 2)).withColumn("key", skeleton(F.col("word")))
    odd = F.col("word").rlike(r"\p{L}") & F.col("word").rlike(r"\p{N}")
    seen = keyed.select("key", "word", F.col("n").alias("own_n"), F.greatest(F.col("n") * F.when(odd, 0.1).otherwise(1.0), F.lit(0.5)).alias("own"))
    meant = keyed.where((F.col("n") * MISREAD >= 1) & ~F.col("word").rlike(r"\p{N}")).select("key", F.col("word").alias("cand"), "n")
    edits = F.greatest(F.lit(1), F.ceil(F.levenshtein("word", "cand") / 2))
    pairs = seen.join(meant, "key").where("word <> cand").where(F.log("n") + edits * math.log(MISREAD) > F.log("own"))
    pairs = Stage(pairs.select("word", "cand", "n", "own", "own_n", _confused("word", "cand").alias("ops")), "confused").df
    known = channel(vocab, pairs.select(F.col("own_n").alias("n"), "ops"))
    if known:
        table = F.create_map(*[x for op, p in sorted(known.items()) for x in (F.lit(op), F.lit(p))])
        cost = F.aggregate("ops", F.lit(0.0), lambda s, op: s + F.coalesce(F.try_element_at(table, op), F.lit(math.log(MISREAD / DENSER))))
    else:
        cost = F.size("ops") * F.lit(math.log(MISREAD / DENSER))
    scored = pairs.withColumn("score", F.log("n") + cost + math.log(DENSER))
    return scored.where(F.col("score") > F.log("own")).select("word", "cand", "score", F.log("own").alias("own"))


def bodies(docs: DataFrame, scanned: str = "pdf") -> DataFrame:
    """(rid, doc_id, fields, body, file, known, scan): one row per text; markdown apart only if it differs."""
    meta = F.col("metadata")
    file = F.coalesce("source_path", meta["file_name"], F.nullif(F.regexp_extract("source_ref", r"^\w+::([^#]+)", 1), F.lit("")), "doc_id")
    text, md = F.col("text"), F.col("markdown")
    same = F.coalesce((text != "") & F.contains(md, text), F.lit(False))
    parts = F.array_compact(
        F.array(
            F.when(text.isNotNull(), F.struct(F.when(same, F.array(F.lit("text"), F.lit("markdown"))).otherwise(F.array(F.lit("text"))).alias("fields"), text.alias("body"))),
            F.when(md.isNotNull() & ~same, F.struct(F.array(F.lit("markdown")).alias("fields"), md.alias("body"))),
        )
    )
    known = F.array_compact(F.array("title", F.trim(F.split(meta["section_path"], ">")[0]), meta["product"]))
    scan = F.coalesce(F.lower(F.trim("source_type")) == scanned, F.lit(False))
    rows = docs.select("doc_id", F.regexp_extract(file, r"([^/\\]+)$", 1).alias("file"), known.alias("known"), scan.alias("scan"), F.explode(parts).alias("p"))
    rows = rows.select("doc_id", "file", "known", "scan", "p.fields", "p.body")
    return rows.withColumn("rid", F.xxhash64("doc_id", "fields", "body"))


def _lines(body: Column) -> Column:
    return F.split(body, r"\r?\n")


def _header_key(line: Column) -> Column:
    return skeleton(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(line), _EDGE_SQL, ""), r"\d+", "#"), r"\s+", " "))


def headers(rows: DataFrame) -> DataFrame:
    """(rid, keys): title-like lines that at least two records of the file share."""
    fits = lambda x: F.trim(x).rlike(r"^[\p{Lu}\p{N}][^.!?;`]{2,70}$") & ~x.rlike(r"[,:;]\s*$") & ~x.rlike(r"^\s*\d+[\W\d]*$")
    short = rows.select("rid", "doc_id", "file", F.explode(F.filter(_lines(F.col("body")), lambda x: (F.length(x) <= 80) & fits(x))).alias("line"))
    keyed = short.select("rid", "doc_id", "file", _header_key(F.regexp_replace("line", r"\b(\d+\.)+\d+\b", "#")).alias("key")).distinct()
    shared = keyed.groupBy("file", "key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    return keyed.join(shared.select("file", "key"), ["file", "key"]).groupBy("rid").agg(F.collect_set("key").alias("keys"))


def suspicious(split: DataFrame, cands: DataFrame) -> DataFrame:
    """(rid, cands): per scanned body, the words that may be misread, with their candidates."""
    seen = split.where("scan").select("rid", F.explode("w").alias("word"))
    grouped = cands.groupBy("word").agg(F.collect_list(F.struct("cand", "score")).alias("to"), F.first("own").alias("own"))
    hits = seen.join(_maybe(grouped), "word")
    return hits.groupBy("rid").agg(F.collect_set(F.struct("word", "own", "to")).alias("cands"))


def pair_counts(split: DataFrame, sus: DataFrame) -> DataFrame:
    """(rid, pairs): corpus counts of the word pairs that Viterbi may ask for in a body, as lines 'a b n'.

    Pairs travel as 64-bit hashes, so the pass over all texts moves numbers only.
    """
    named = split.join(_maybe(sus, BROADCAST_ROWS // 5), "rid").select("rid", "w", F.map_from_entries(F.transform("cands", lambda c: F.struct(c["word"], F.transform(c["to"], lambda t: t["cand"])))).alias("m"))
    at = named.select("rid", "m", "w", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.map_contains_key("m", F.get("w", i))).alias("is"))
    near = at.select("rid", "m", F.explode(F.transform("is", lambda i: F.struct(F.get("w", i).alias("o"), F.when(i > 0, F.get("w", i - 1)).alias("l"), F.get("w", i + 1).alias("r")))).alias("x")).select("rid", "m", "x.*")
    near = Stage(near, "suspicious").df
    options = lambda c: F.concat(F.array(c), F.coalesce(F.try_element_at("m", F.col(c)), F.array().cast("array<string>")))
    here = near.select("rid", F.explode(options("o")).alias("o"), F.when(F.col("l").isNotNull(), options("l")).alias("l"), F.when(F.col("r").isNotNull(), options("r")).alias("r"))
    wanted = here.select("rid", F.explode("l").alias("a"), F.col("o").alias("b")).union(here.select("rid", F.col("o").alias("a"), F.explode("r").alias("b"))).distinct()
    wanted = Stage(wanted.withColumn("h", F.xxhash64("a", "b")), "wanted").df
    ask = Stage(wanted.select("h").distinct(), "asked").df
    follow = split.where(F.size("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))).alias("h"))
    counted = follow.join(_maybe(ask), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    lines = F.concat_ws(" ", "a", "b", F.col("n").cast("string"))
    return wanted.join(counted, "h").groupBy("rid").agg(F.array_join(F.collect_list(lines), "\n").alias("pairs"))


def kept_hyphens(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(rid, keep): hyphens at line ends that belong to the word: both halves are words, the whole is none."""
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(BREAK), F.lit(1)).alias("l"), F.regexp_extract_all("body", F.lit(BREAK), F.lit(2)).alias("r"))
    broken = rows.where(F.col("body").rlike(r"-[ \t]*\r?\n")).select("rid", F.explode(pairs).alias("p")).select("rid", F.lower("p.l").alias("l"), F.lower("p.r").alias("r")).distinct()
    broken = Stage(broken, "breaks").df
    named = broken.select(F.col("l").alias("word")).union(broken.select(F.col("r").alias("word"))).union(broken.select(F.concat("l", "r").alias("word"))).distinct()
    known = Stage(vocab.join(named, "word", "left_semi"), "known").df
    count = lambda c: known.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    whole = broken.withColumn("whole", F.concat("l", "r")).join(count("l"), "l").join(count("r"), "r").join(count("whole"), "whole", "left")
    keep = whole.where("n_whole is null and n_l >= 20 and n_r >= 20")
    return keep.groupBy("rid").agg(F.collect_set(F.concat_ws("-", "l", "r")).alias("keep"))


def decode_line(tokens: list[str], options: dict, pairs: dict) -> list[str]:
    """The likeliest words behind ``tokens`` (lower case) by Viterbi. options: word to [(word, log of its expected count)].

    A step from a to b costs the log of the smoothed count of (a, b): its bigrams plus b's own expected count over
    SMOOTHING. A word without a choice is one state, where all paths meet again, so each run of suspects between two
    such words is decoded by itself.
    """
    out, i, n = list(tokens), 0, len(tokens)
    while i < n:
        if tokens[i] not in options:
            i += 1
            continue
        paths = [(0.0, (), tokens[i - 1] if i else "")]
        start = i
        while i < n and tokens[i] in options:
            new = []
            for cand, score in options[tokens[i]]:
                single = math.exp(min(score, 50.0)) / SMOOTHING
                cost, path = max((cost + math.log(pairs.get((prev, cand), 0) + single), path) for cost, path, prev in paths)
                new.append((cost + 0.5 * score, (*path, cand), cand))
            paths, i = new, i + 1
        if i < n:
            paths = [(cost + math.log(pairs.get((prev, tokens[i]), 0) + 1.0 / SMOOTHING), path, prev) for cost, path, prev in paths]
        out[start:i] = max(paths)[1]
    return out


def _cased(seen: str, cand: str) -> str:
    if seen.isupper() and len(seen) > 1:
        return cand.upper()
    return cand[:1].upper() + cand[1:] if seen[:1].isupper() else cand


_VERSION, _DIGITS, _SPACE = re.compile(r"\b(?:\d+\.)+\d+\b"), re.compile(r"\d+"), re.compile(r"\s+")
_REST = re.compile(r"|v?\d+(?:\.\d+)*|[—–|-]\s*\w[\w ]{0,30}")


def is_header(text: str, keys: set, known: list[tuple[str, str]]) -> bool:
    """Whether a stripped line continues the file's names or is shared; known: (name, its skeleton)."""
    text = text.strip("*_")
    if not 3 <= len(text) <= 90 or not (text[0].isupper() or text[0].isdigit()) or text[-1] in ".!?;:," or text.count(" ") > 12:
        return False
    bare = PAGE_EDGE.sub("", text).strip() if text[0].isdigit() or text[-1].isdigit() or "|" in text else text
    if CHAPTER.match(bare):
        return True
    flat = _SPACE.sub(" ", bare)
    if keys and skeleton_of(_DIGITS.sub("#", _VERSION.sub("#", flat))) in keys:
        return True
    mine = skeleton_of(flat)
    for name, own in known:
        if len(own) >= 6 and mine.startswith(own) and _REST.fullmatch(flat[len(name) :].strip() if mine != own else ""):
            return True
    return False


def repair(body: str, cands, pairs, keys, known, keep) -> tuple[str, int, int, int, int]:
    """(repaired text, broken words, misread words, headers, page numbers) of one body."""
    options: dict[str, list] = {}
    for line in (cands or "").split("\n") if cands else ():
        word, own, *to = line.split("\t")
        options[word] = [(word, float(own)), *[(c, float(v)) for c, v in (t.split(" ") for t in to)]]
    follow = {(a, b): int(n) for a, b, n in (x.split(" ") for x in pairs.split("\n"))} if pairs else {}
    keys, keep = set(keys.split("\n")) if keys else set(), set(keep.split("\n")) if keep else set()
    names = [_SPACE.sub(" ", k).strip() for k in (known or "").split("\n")]
    known = [(k, skeleton_of(k)) for k in dict.fromkeys(names) if k]
    breaks = misread = heads = numbers = 0
    kept: list[tuple[str, bool]] = []
    code = False
    for line in re.split(r"\r?\n", body):
        text = line.strip()
        if code or text.startswith(("```", "~~~")):  # a block may end behind its last line of code
            code ^= len(re.findall(r"```|~~~", line)) % 2 == 1
            kept.append((line, True))
            continue
        number = 0 < len(text) <= 40 and bool(PAGE_LINE.match(text))
        head = bool(text) and not number and is_header(text, keys, known)
        if number or head:
            heads += head
            numbers += number or bool(PAGE_EDGE.search(text))
            continue
        kept.append((line, False))
    # blank lines left around removed page furniture inside a sentence close up
    paragraphs: list[str] = []
    current = ""
    for line, fixed in kept:
        text = line if fixed else line.strip()
        if fixed or not text or _LIST.match(line):
            broken = current and current[-1] in _HYPHENS and current[-2:-1].isalpha()
            if not text and not fixed and broken:
                continue
            if current:
                paragraphs.append(current)
            current = "" if fixed or not text else text
            if fixed or not text:
                paragraphs.append(line if fixed else "")
            continue
        end = re.search(r"([^\W\d_]+)[-­‐¬]$", current[-60:]) if current[-1:] in _HYPHENS and current else None
        start = re.match(r"[^\W\d_]+", text) if end else None
        if end and start and start.group()[0].islower():
            pair = f"{end.group(1)}-{start.group()}".lower()
            if current[-1] == "-" and pair in keep:
                current += text
            else:
                breaks += 1
                current = current[:-1] + text
        else:
            current = f"{current} {text}" if current else text
    if current:
        paragraphs.append(current)
    if options:
        fence = False
        for i, line in enumerate(paragraphs):
            if fence or re.match(r"\s*(?:```|~~~)", line):
                fence ^= len(re.findall(r"```|~~~", line)) % 2 == 1
                continue
            found = list(_TOKEN.finditer(line))
            low = [m.group().lower() for m in found]
            if any(w in options for w in low):
                out, last = [], 0
                for m, a, b in zip(found, low, decode_line(low, options, follow)):
                    if a != b:
                        misread += 1
                        out += [line[last : m.start()], _cased(m.group(), b)]
                        last = m.end()
                paragraphs[i] = "".join(out) + line[last:]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(paragraphs)).strip("\n"), breaks, misread, heads, numbers


def scan_repairs(docs: DataFrame, scanned: str = "pdf") -> DataFrame:
    """(doc_id, fields, body, fixed, breaks, misread, headers, numbers) of the bodies with evidence of noise."""
    rows = bodies(docs, scanned)
    split = Stage(rows.select("rid", "scan", joined_words(F.col("body")).alias("w")), "words").df
    rows = rows.where("scan")
    vocab = Stage(vocabulary(split), "vocabulary").df
    cands = Stage(candidates(vocab), "candidates").df
    sus = Stage(suspicious(split, cands), "suspects").df
    heads = Stage(headers(rows), "headers").df
    keep = kept_hyphens(rows, vocab)
    pairs = pair_counts(split, sus)
    entry = F.transform("cands", lambda c: F.concat_ws("\t", c["word"], c["own"].cast("string"), F.array_join(F.transform(c["to"], lambda t: F.concat_ws(" ", t["cand"], t["score"].cast("string"))), "\t")))
    facts = sus.select("rid", F.array_join(entry, "\n").alias("cands")).join(pairs, "rid", "left")
    facts = facts.join(heads.select("rid", F.array_join("keys", "\n").alias("keys")), "rid", "full").join(keep.select("rid", F.array_join("keep", "\n").alias("keep")), "rid", "left")
    evidence = (F.col("body").rlike(BREAK_HINT) & F.col("body").rlike(BREAK)) | F.col("body").rlike(_PAGE_SQL)
    titled = F.exists("known", lambda k: F.contains(F.lower("body"), F.concat(F.lit("\n"), F.lower(k)))) | F.col("body").rlike(r"(?im)^\W{0,3}(?:\d+ \| )?(?:chapter|kapitel|chapitre|cap[íi]tulo) \d+")
    noisy = rows.join(facts, "rid", "left").where(F.col("cands").isNotNull() | F.col("keys").isNotNull() | F.coalesce(titled, F.lit(False)) | F.coalesce(evidence, F.lit(False)))
    noisy = noisy.withColumn("known", F.array_join("known", "\n"))

    @F.pandas_udf("fixed string, breaks int, misread int, headers int, numbers int")
    def fix(body: pd.Series, c: pd.Series, p: pd.Series, k: pd.Series, n: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = [repair(*x) for x in zip(body, c, p, k, n, h)]
        return pd.DataFrame(out, columns=["fixed", "breaks", "misread", "headers", "numbers"])

    done = noisy.withColumn("r", fix("body", "cands", "pairs", "keys", "known", "keep"))
    return done.select("doc_id", "fields", "body", "r.*")


def found_noise(docs: DataFrame, least_misread: int = 3) -> DataFrame:
    """p5_found: (doc_id, field_name, noise_type), distinct."""
    r = scan_repairs(docs)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("breaks") > 0, F.lit("hyphen_break")), F.when(F.col("misread") >= least_misread, F.lit("misread_chars")),
            F.when(F.col("headers") > 0, F.lit("running_header")), F.when(F.col("numbers") > 0, F.lit("page_number")),
        )
    )
    each = r.select("doc_id", F.explode("fields").alias("field_name"), kinds.alias("kinds"))
    return each.select("doc_id", "field_name", F.explode("kinds").alias("noise_type")).distinct()


def repaired(docs: DataFrame, scanned: str = "pdf") -> DataFrame:
    """``docs`` with text and markdown repaired; records without noise as they are. Repeated rows come out once."""
    fixes = scan_repairs(docs, scanned).where("breaks + misread + headers + numbers > 0")
    fixes = Stage(fixes.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "fixed").distinct(), "fixes").df
    out = docs.withColumn("_row", F.xxhash64("doc_id", "text", "markdown", F.col("source_ref")))
    for field in ("text", "markdown"):
        own = fixes.select(F.col("_id").alias("doc_id"), F.col("_body").alias("_old"), F.col("fixed").alias(f"_{field}"))
        joined = out.join(own, (out["doc_id"] == own["doc_id"]) & (out[field] == own["_old"]), "left").drop(own["doc_id"]).drop("_old")
        out = joined
    md = F.when(F.col("_markdown").isNotNull(), F.col("_markdown")).when(
        F.col("_text").isNotNull() & (F.col("text") != "") & F.contains("markdown", "text"), F.replace("markdown", "text", F.col("_text"))
    )
    return out.withColumn("markdown", F.coalesce(md, "markdown")).withColumn("text", F.coalesce("_text", "text")).drop("_text", "_markdown", "_row")
