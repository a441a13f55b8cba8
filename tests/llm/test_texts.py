"""Personal information, defects, scan noise, conversations, residue."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import conversations, defects, pii, residue, scans

UTC = dt.timezone.utc


def kinds(text):
    (spans,) = pii.detect([text], pii.fit_models())
    return {k for *_, k in spans}


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Reply to jo.smith+x@mail.example today.", {"email"}),
        ("Reply to jo [at] mail [dot] example today.", {"email"}),
        ("Call +49 30 23125 305 before noon.", {"phone"}),
        ("Matched on SSN 912-34-5678, no second hit.", {"id_number"}),
        ("Lives at 12 Holm Street, Kelm according to the form.", {"address"}),
        ("The request was signed by Maria Holmberg.", {"name"}),
        ("The package rules@7.5.5 replaces the older one.", set()),
        ("Mention @oncall in the room, use user@tenant as the key.", set()),
        ("Job id 0072-11-21501 was replayed.", set()),
        ("Read Section 80 Road Map in the guide.", set()),
        ("", set()),
    ],
)
def test_findings(text, expected):
    assert kinds(text) == expected


def test_street_gate_passes_every_street_line():
    lines = [f"12 {name} {form}, Leeds" for word in pii._STREETS for form in (word, word.upper()) for name in ("Elm", "Old\nMill", "Old Mill Hill", "King's", "King’s", "Stow-Hill")]
    lines += [f"7 b,{gap}{form}{gap}Holm" for word in "rue avenue boulevard chemin place calle via plaza allée".split() for form in (word, word.capitalize(), word.upper()) for gap in (" ", "\n")]
    lines += [f"Holm{word} 12" for word in "straße strasse str. weg gasse platz allee damm ufer".split()] + ["HOLMSTRAßE 12", "HOLMWEG 12"]
    lines += [f"{word}{gap}Holm 12" for word in "Am|AM|An der|Im|IM|Auf der|Calle|CALLE|Avenida|AVENIDA|Via|VIA|Plaza|PLAZA|Paseo|PASEO".split("|") for gap in (" ", "\n")]
    for line in lines:
        assert pii.GENERATORS["address"].search(line), line
        assert any(kind == "address" for kind, *_ in pii.propose(line)), line


def test_held_out_accuracy():
    models = pii.fit_models()
    right = total = 0
    for _, text, true in pii.labelled_sample(200, seed=99):
        found = {k for *_, k in pii.detect([text], models)[0]}
        want = {k for k, *_ in true}
        right += want <= found if want else not found
        total += 1
    assert right / total > 0.9


def test_trees_learn_a_rule():
    x = np.random.RandomState(0).rand(400, 3)
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(float)
    assert ((pii.Trees().fit(x, y).predict(x) > 0.5) == y).mean() > 0.97


def test_redaction_leaves_the_rest(spark):
    rows = [("a", "Write to jo@mail.example, please."), ("b", None), ("c", ""), ("d", "Nothing here."), ("a", "Write to jo@mail.example, please.")]
    out = {x.record_id: x for x in pii.redacted(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert out["a"].redacted == "Write to [EMAIL], please." and out["b"].redacted is None and out["c"].redacted == "" and out["d"].redacted == "Nothing here."
    none = spark.createDataFrame([], "chunk_id string, text string"), spark.createDataFrame([], "qa_id string, answer string")
    assert pii.found_pii(*none).count() == 0


@pytest.mark.parametrize(
    "question,answer,expected",
    [
        ("Why?", None, "empty_answer"), ("Why?", " ​", "empty_answer"), ("Why?", "N/A", "empty_answer"),
        ("How do I move the cache entry in the console?", "Q: How do I move the cache entry in the console?", "copies_question"),
        ("How do I move it?", "I'm sorry, but I cannot help with that.", "refusal"),
        ("How do I move the rule to the other group?", "Das Team prüft, ob die Regel in der Gruppe richtig ist und nicht mehr wartet.", "other_language"),
        ("How do I move the rule?", "Open the console and move the rule to the gro", "truncated_answer"),
        ("How do I move the rule?", "Open the console and move the rule. In short: pool.max=4", None),
        ("How do I move the rule?", "Open the console and move the rule.\n- pool.max\n- pool.min", None),
        ("How do I move the rule?", "Sorry for the wait in earlier builds. The rule moves with the group.", None),
        (None, "The rule moves with the group of the tenant.", None),
    ],
)
def test_defects(question, answer, expected):
    assert defects.defect(question, answer) == expected


@pytest.mark.parametrize(
    "end,cut",
    [
        ("move the rule.\n- the limit of the po", True), ("move the rule. In short: pool.max=4", True), ("move the rule. See https://holm.example/gui", True),
        ("move the rule.\n| pool | lim", True), ("write to 12 Holm Street, Kel", True), ("move a rule, e.g.", True), ("move the rule.\n2.", True),
        ("move the rule.\n| pool | limit |", False), ("move the rule 🎉", False), ("move the rule.", False), ("move the rules, pools etc.", False),
    ],
)
def test_only_the_spike_decides(end, cut):
    answer = "Open the console and " + end
    assert defects.defect("How do I move it?", answer, spike=True) == ("truncated_answer" if cut else None)
    assert defects.defect("How do I move it?", answer) is None


def test_spikes_reach_the_records(spark):
    rows = [(f"c{i}", "How do I move it?", f"Open the console and move the rule.\n- the limit of pool {i:03} and the gro") for i in range(30)]
    rows += [(f"w{i}", "How do I move it?", "Open the console and move the rule.\n- " + f"{i} the limit" + "s" * (2 * i)) for i in range(4)]
    found = {tuple(x) for x in defects.find_defects(spark.createDataFrame(rows, "qa_id string, question string, answer string")).collect()}
    assert found == {(f"c{i}", "truncated_answer") for i in range(30)}


#: An example of each pattern and of the alternatives that lacked a hint.
REFUSALS = (
    "I'm sorry, but I cannot do it.|Unfortunately I can't say.|I cannot help with it.|I\u00a0cannot help with it.|As an AI I am unable to say.|I'd rather not say.|I must decline.|I refuse.|It asks for a secret, so I have to decline.|"
    "That goes against my guidelines.|It is against my guidelines.|This question is outside the provided context.|This is beyond the scope of the document.|That request is outside the text.|The answer is not in the context.|"
    "The document does not mention it.|There is no information on it.|Insufficient data for it.|No answer is possible.|It is not clear from the text.|It is not possible to determine it.|Leider kann ich es so sagen.|"
    "Dazu kann ich nichts sagen.|Darüber darf ich nichts sagen.|Ich kann es nicht sagen.|Als KI weiß man es.|Désolé, rien.|Je ne sais pas.|En tant qu'IA, rien.|Lo siento, nada.|No puedo decirlo.|Como IA, nada.|Perdón, nada."
).split("|")


def test_every_refusal_is_seen_at_any_length():
    for pattern in defects._SPLIT:
        assert any(defects.re.search("(?is)" + pattern, text) for text in REFUSALS), pattern
    for text in REFUSALS:
        assert defects.is_refusal(text), text
        assert defects.defect(None, text + " The rule moves with the group of the tenant." * 20) == "refusal", text
    assert defects.defect(None, "The rule moves with the group of the tenant. Press Decline if it must not." * 20) is None


def test_shortened_answers_cross_partitions(spark):
    base = [f"Answer number {i} explains the rule of the group and then stops" for i in range(200)]
    texts = base + [t + " after a while." for t in base[::10]] + [t[:40] for t in base[3:4]]
    got = {x.answer for x in defects.shortened_answers(spark.createDataFrame([(t,) for t in set(texts)], "answer string")).where("shortened").collect()}
    want = {t for t in set(texts) if any(o != t and o.startswith(t) for o in texts)}
    assert got == want


def test_shortened_answers_behind_other_extensions(spark):
    head = "The rule moves with the group of the tenant"
    texts = [head, head + "\nSee the guide.", head + " after a while.", "Keys of the pool:\tone and two are set,", "Keys of the pool:\tone and two are set, three is not.", "Keys of the pool:\tone and two are set,\nor not."]
    got = {x.answer for x in defects.shortened_answers(spark.createDataFrame([(t,) for t in texts], "answer string")).collect()}
    assert got == {head, texts[3]}
    whole = [head, head + "\nSee the guide.", head + ".", head + "!"]
    assert defects.shortened_answers(spark.createDataFrame([(t,) for t in whole], "answer string")).count() == 0


@pytest.mark.parametrize(
    "answer",
    ["Il gruppo della regola non è pronto, quindi la chiave deve restare nella console.", "Das Team prüft die Regel und nicht die Gruppe.", "规则随租户的组一起移动，因此不需要更改设置。", "Правило переходит вместе с группой арендатора.", "O grupo da regra não está pronto, então a chave deve ficar na console.", "De regel gaat met de groep mee en moet niet worden gewijzigd."],
)
def test_answers_in_other_languages(answer):
    assert defects.defect("How do I move the rule to the other group?", answer) == "other_language"
    assert defects.defect(None, answer) is None


def test_defect_table_edges(spark):
    schema = "qa_id string, question string, answer string, length int"
    rows = [("a", "Why is it so?", "", 1), ("a", "Why is it so?", "", 1), ("b", None, None, 1), ("c", "Why is the sky blue?", "Because of the light in the air.", 1)]
    assert {tuple(x) for x in defects.find_defects(spark.createDataFrame(rows, schema)).collect()} == {("a", "empty_answer"), ("b", "empty_answer")}
    assert defects.find_defects(spark.createDataFrame([], schema)).count() == 0


def test_names_outside_the_list():
    """People whose given names the list does not hold, beside the cues that say who they are."""
    models = pii.fit_models()
    names = "Siobhan Gallagher|Xiadani Okonkwo|Brian Cooper|Nguyen Thi Hoa|Oluwaseun Adeyemi|Gwyneth Pritchard|Tadhg Brennan|Ljubica Petrovic|Kwabena Mensah|Hye Park".split("|")
    forms = ["The request was signed by {} yesterday.", "Please loop in {} from the desk.", "{} approved the change window.", "Escalate to {} when the queue is full."]
    found = [any(k == "name" and n in t[a:b] for a, b, k in pii.detect([t], models)[0]) for n in names for f in forms for t in [f.format(n)]]
    assert sum(found) >= 0.85 * len(found)
    plain = ["In Holm Console the map is open.", "The Delta Rules team left.", "Open Section Two of the Release Notes.", "Das Team Kelmar prüft die Werte der Gruppe Nord.", "THE CONTACT POLICY IS LOCKED UNTIL THE RULE ALSO COVERS THE DEFAULT LIST.", "L'équipe Nord contrôle la règle.", "(Tenants Bravum, Wenzor, Hesmog)"]
    assert not any(k == "name" for t in plain for *_, k in pii.detect([t], models)[0])
    card = "Contact card: Anna Bell, 93 GORTAX CRESCENT, OSTOVIK, {}."
    for phone in ("020 7946 0280", "+34 900 315 073", "555-0194", "0049-30-23125-846"):
        assert [k for *_, k in pii.detect([card.format(phone)], models)[0]] == ["name", "address", "phone"], phone


DOC = "doc_id string, source_type string, source_ref string, source_path string, title string, page int, text string, markdown string, metadata map<string,string>"


def doc(i, text, markdown=None, path="a.pdf", kind="pdf", title="Holm Guide"):
    return (i, kind, f"pdf::{path}#x", path, title, 1, text, markdown, {"section_path": "Holm Guide > Part"})


def test_scan_noise(spark):
    clean = "The audience segment belongs to the treatment of the rollback point and the publish job returns the answer"
    rows = [doc(f"c{i}", f"{clean} number {i}.\n{clean}.", path=f"f{i}.pdf") for i in range(60)]
    rows += [
        doc("m", "The aud1ence segrnent bclongs to the treatment of the rol1back point.", path="m.pdf", title=None),
        doc("h", "The audience seg-\nment belongs to the treat-\r\nment of the point.", path="h.pdf", title=None),
        doc("p", "The audience belongs\nHolm Guide\n- 12 -\nto the treatment.", path="p.pdf"),
        doc("k", "```\n12\n13\n```\nThe audience belongs to it.", path="k.pdf", title=None), doc("f", "``` { \"a\": 1,\n12\n\"b\": 2 } ```\nThe seg-\nment belongs to it.\n- 12 -\nIt stays.", path="f.pdf", title=None), doc("n", None, None), doc("e", "", ""), doc("w", "seg-\nment", kind="webex"),
    ]
    rows.append(rows[-5])
    df = spark.createDataFrame(rows, DOC)
    got = {tuple(x) for x in scans.found_noise(df).where("doc_id not like 'c%'").collect()}
    assert got == {("m", "text", "misread_chars"), ("h", "text", "hyphen_break"), ("f", "text", "hyphen_break"), ("f", "text", "page_number"), ("p", "text", "running_header"), ("p", "text", "page_number")}
    fixed = {x.doc_id: x for x in scans.repaired(df).collect()}
    assert fixed["m"].text == "The audience segment belongs to the treatment of the rollback point."
    assert fixed["h"].text == "The audience segment belongs to the treatment of the point."
    assert fixed["p"].text == "The audience belongs to the treatment." and fixed["n"].text is None and fixed["e"].text == ""
    assert fixed["k"].text == "```\n12\n13\n```\nThe audience belongs to it."
    assert scans.found_noise(spark.createDataFrame([], DOC)).count() == 0


def test_confusions_and_their_probabilities(spark):
    assert scans.confusions("sti1l", "still") == ["1<l"] and scans.confusions("segrnent", "segment") == ["rn<m"] and scans.confusions("cl0sed", "closed") == ["0<o"]
    assert sorted(scans.confusions("stcvvard", "steward")) == ["c<e", "vv<w"] and scans.confusions("ﬁnd", "find") == ["ﬁ<fi"] and scans.confusions("same", "same") == []
    vocab = spark.createDataFrame([("some", 900), ("s0me", 9), ("more", 100), ("m0re", 1), ("modern", 40)], "word string, n long")
    pairs = spark.createDataFrame([(9, ["0<o"]), (1, ["0<o"])], "n long, ops array<string>")
    known = scans.channel(vocab, pairs)
    assert set(known) == {"0<o"} and abs(known["0<o"] - scans.math.log(10.5 / 1051)) < 1e-9
    assert scans.channel(vocab, pairs.limit(0)) == {}
    assert scans.decode_line(["the", "bclongs"], {"bclongs": [("bclongs", 0.7), ("belongs", 3.0)]}, {("the", "belongs"): 4}) == ["the", "belongs"]
    assert scans.decode_line(["a", "modern"], {"modern": [("modern", 3.7), ("modem", -2.0)]}, {}) == ["a", "modern"]


@pytest.mark.parametrize("line", ["Pages 3", "pagina 7", "pág. 12", "3 | 12", "PÁGINA 3", "- 12 -", "xviii", "[ 4 ]", "Seite 3 von 9", "***** page 12 *****", "| iv |", "lxxxviii"])
def test_page_lines_are_evidence(spark, line):
    assert scans.PAGE_LINE.match(line)
    row = spark.createDataFrame([(f"The text\n{line}\ngoes on.",), ("The text goes on.\nIt was 12 days.",)], "body string")
    assert [x.hit for x in row.select(F.col("body").rlike(scans._PAGE_SQL).alias("hit")).collect()] == [True, False]


def test_real_hyphens_stay():
    assert scans.repair("a cross-\nchannel job", None, None, None, None, "cross-channel")[0] == "a cross-channel job"


MESSAGE = "message_id string, room_id string, parent_id string, thread_id string, author string, person_email string, created string, updated string, text string, markdown string, files array<string>, ingested_at timestamp"


def msg(i, parent=None, thread=None, author="Ann", email="a@x.test", created="2024-01-01T10:00:00Z", updated=None, text="hi", minute=0):
    return (i, "r", parent, thread, author, email, created, updated, text, text, [], dt.datetime(2024, 1, 2, 0, minute, tzinfo=UTC))


def run(spark, rows, hot=100_000):
    df = spark.createDataFrame(rows, MESSAGE)
    return sorted((x.thread_id, x.turn_no, x.message_id, x.role) for x in conversations.conversations(df, hot).collect())


@pytest.mark.parametrize("hot", [100_000, 1])
def test_conversations(spark, hot):
    rows = [
        msg("a", thread=None), msg(" b ", "a", " ", "Bob", created="2024-01-01T12:00:00+02:00"), msg("c", "b", None, " ann ", created="junk"), msg("d", "c", None, "Notifier", "n@bot.example", "2024-01-01 09:30:00"),
        msg("b", "a", "a", "Bob", text="edited", updated="2024-02-01T00:00:00Z", created="2024-01-01T12:00:00+02:00"),
        msg("x"), msg("y", "x", "x", "ANN "), msg("z", "x", "x", "Bot", "b@bot.example"),
        msg("m"), msg("n", "gone", "m", "Bob"), msg("o", text="(deleted)"), msg("p", "o", "o", "Bob"), msg("q", "missing-root", None, "Bob"),
        msg("s"), msg("t", "s", "s", "Bob", text="​"), msg(None), msg("  "),
    ]
    assert run(spark, rows, hot) == [("a", 1, "a", "user"), ("a", 2, "d", "system"), ("a", 3, "b", "assistant"), ("a", 4, "c", "user")]


@pytest.mark.parametrize("hold", [50_000, 3])
def test_conversations_match_brute_force(spark, hold):
    r = random.Random(hold)
    rows, thread_of = [], {}
    for i in range(400):
        t = f"t{r.randrange(40):02}" if r.random() < 0.6 else "t00"
        root = t not in thread_of
        thread_of.setdefault(t, [])
        name = t if root and r.random() < 0.9 else f"{t}-{i:03}"
        parent = None if name == t else r.choice(thread_of[t] or [t]) if r.random() < 0.995 else "nowhere"
        named = t if parent is None or r.random() < 0.7 else None
        rows.append(msg(name, parent, named, r.choice(["Ann", "ann ", "Ann", "Bob"]) if t != "t05" else "Ann", r.choice(["a@x.test", "a@x.test", "b@bot.example"]), f"2024-01-01T{r.randrange(24):02}:00:00Z" if r.random() < 0.9 else None, text=r.choice(["hi", "hi", "hi", "", "(deleted)"]) if name != t or r.random() < 0.2 else "hi"))
        thread_of[t].append(name)
    by = {x[0]: x for x in rows}

    def thread(x):
        while not x[3]:
            if x[2] not in by:
                return x[2]
            x = by[x[2]]
        return x[3]

    groups = {}
    for x in rows:
        groups.setdefault(thread(x), []).append(x)
    expected = []
    for t, items in groups.items():
        first = next((x for x in items if x[0] == t), None)
        ok = lambda x: x[8] == "hi"
        who, bot = lambda x: x[4].strip().lower(), lambda x: x[5].endswith("bot.example")
        if not first or not ok(first) or any(x[2] and x[2] not in by for x in items) or not any(ok(x) and who(x) != who(first) and not bot(x) for x in items):
            continue
        turns = sorted((x for x in items if ok(x)), key=lambda x: (x[0] != t, x[6] is None, x[6] or "", x[0]))
        expected += [(t, i, x[0], "system" if bot(x) else "user" if who(x) == who(first) else "assistant") for i, x in enumerate(turns, 1)]
    assert expected and run(spark, rows, hold) == sorted(expected)


def test_conversations_in_a_circle(spark):
    rows = [msg("u", "v", None), msg("v", "w", None, "Bob"), msg("w", "u", None), msg("a"), msg("b", "a", None, "Bob")]
    assert [x[2] for x in run(spark, rows)] == ["a", "b"]


def test_tables_compose():
    import numpy as np

    r = np.random.RandomState(1)
    letters = r.randint(0, 5, 200)
    begin = np.array([0, 1, 2, 50, 51, 130])
    for table, a, b in zip(conversations.compose(conversations.DELTA[letters], begin), begin, [*begin[1:], 200]):
        for state in range(4):
            at = state
            for x in letters[a:b]:
                at = conversations.DELTA[x][at]
            assert table[state] == at


def test_conversations_deep_chain_and_nothing(spark):
    rows = [msg("m000")] + [msg(f"m{i:03}", f"m{i - 1:03}", None, "Bob" if i % 2 else "Ann", created=f"2024-01-01T10:{i:02}:00Z") for i in range(1, 50)]
    assert [x[2] for x in run(spark, rows)] == [f"m{i:03}" for i in range(50)]
    assert run(spark, []) == []


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Dear {{first_name}}, welcome to [INSERT COMPANY HERE].", "placeholder"), ("In a template the token `{{ profile.tier }}` is replaced at send time.", None),
        ("The label %BRAND% stands for the tenant.", None), ("Lorem ipsum dolor sit amet consectetur adipiscing elit.", "filler"),
        ("Designers paste lorem ipsum into a treatment to test line breaks, which the job rejects.", None), ("404 Not Found\nTry again later.", "error_page"),
        ("A call to a retired offer answers with 404 Not Found, and the buffer must treat that as final.", None), ("Please enable JavaScript to view this page.", "script_notice"),
        ("An administrator may have to enable JavaScript for the embedded preview; the server side is not affected.", None), ("```\n{{ x }}\n```\nText of a guide.", None), ("", None), (None, None), ("  ", None),
    ],
)
def test_residue(text, expected):
    assert residue.residue_type(text) == expected


def test_residue_tables(spark):
    rows = [(1, "404 Not Found", None, "x"), (1, "404 Not Found", None, "x"), (2, "A finished text about rules.", "t", "x"), (3, None, None, "x"), (4, "Hello ${NAME}!", "t", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, low string")
    assert {tuple(x) for x in residue.find_residue(df).collect()} == {(1, "error_page"), (4, "placeholder")}
    assert {x.doc_id for x in residue.without_residue(df).collect()} == {2, 3}
    assert residue.find_residue(df.limit(0)).count() == 0


#: An example of each alternative of the grammars.
RESIDUE = {
    "error_page": (
        "HTTP 503|HTTP-503|Error: 500|Err #404|Code: 500|Status: 404|HTTP status 502|Fehler 404|Erreur 404|Errore 500|Código 404|Codigo 404|Status 404|404 Not Found|403 Forbidden|401 Unauthorized|"
        "503 Service Unavailable|500 Internal Server Error|502 Bad Gateway|504 Gateway Timeout|504 Gateway Time-out|400 Bad Request|410 Gone|Bad gateway (502)|Oops! Something went wrong|Access denied|"
        "You don't have permission to view it|Page not found|The page could not be found|This link is no longer valid|The page has been removed.|The page does not exist.|The topic you were looking for was withdrawn|"
        "The article cannot be loaded|The document is `a code span that is far longer than thirty characters` gone|Too many requests|Rate limit reached|The search server is overloaded|Seite nicht gefunden|"
        "Page introuvable|Página no encontrada|Der angeforderte Artikel fehlt|Your session has expired|Session timed out|Cette page n'est pas disponible|It may have been moved.|No such file|Too many redirects|"
        "No further details|Request timed out|Document unavailable|Resource gone|Upstream timed out|Request rejected|The upstream service did not answer.|Internal error.|An unexpected error|Fatal server error|"
        "Uncaught TypeError|Unhandled exception|Traceback (most recent call last)"
    ).split("|"),
    "script_notice": (
        "JavaScript is disabled|Scripts are blocked|Scripting is not available|Please enable JavaScript|Turn on java script|Scripts must be allowed|This page requires scripting|It does not support script|"
        "Noscript|JavaScript muss man aktivieren|Bitte aktivieren Sie JavaScript|Activer JavaScript|Habilite JavaScript|We're checking your browser before the visit"
    ).split("|"),
    "filler": (
        "Placeholder text|Content coming soon|Text to follow|Blah blah|It is asdf|Dummy heading|Sample text|Sample\u00a0title|Test test test|Replace this paragraph|Describe the rule in one or two sentences|Foo bar|XXXX|"
        "TBD|TODO|To be written|Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi|Vivamus|Loreſ ipſum"
    ).split("|") + list(residue.LATIN),
    "placeholder": "Dear {{name}}|To ${name}|By <%= name %>|On %DATE%|At @@place@@|In [[town]]|A __NAME__|A XX_NAME_XX|[your name here]|[Insert it]|For <FULL NAME>|« nom »|Dear {first_name}|See `x`{name} now".split("|"),
}


def test_residue_gate_passes_every_grammar(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, texts in RESIDUE.items() for t in texts)]
    for grammar in residue.ERROR + residue.SCRIPT + residue.FILLER + residue.PLACEHOLDERS:
        flags = 0 if grammar in residue.PLACEHOLDERS else residue.re.I
        assert any(residue.re.search(grammar, t, flags) for _, t, _ in rows), grammar
    assert [(t, residue.residue_type(t)) for _, t, _ in rows] == [(t, k) for _, t, k in rows]
    found = {x.doc_id: x.residue_type for x in residue.find_residue(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    assert [(t, found.get(i)) for i, t, _ in rows] == [(t, k) for _, t, k in rows]
