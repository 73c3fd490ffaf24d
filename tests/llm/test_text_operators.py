from datetime import datetime

import pytest

from foliograph.llm import markup as M
from foliograph.llm import pii
from foliograph.llm import residue as R


def kinds(text):
    return {"/".join(x) for x in M.elements(text)}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<h2\nid='s'>T</h1>", {"html/heading"}),
        ("<UL><li>a<li>b</UL>", {"html/list"}),
        ("<pre><code>x <b>y</b></code></pre>", {"html/code"}),
        ("<table><tr><td><b>x</b></table>", {"html/table"}),
        ("<table border=1>\n<tr><td>x\n\ntext", {"html/table"}),
        ("a <b>b</b> &nbsp; c<br/>d", {"html/inline"}),
        ("<li>a <em>b</em></li>", {"html/list", "html/inline"}),
        ("== H ==", {"wiki/heading"}),
        ("** a\n*# b", {"wiki/list"}),
        ("{|\n|-\n| '''a''' || $x_1$\n|}", {"wiki/table"}),
        ("<syntaxhighlight lang='x'>a $b_1$</syntaxhighlight>", {"wiki/code"}),
        ("<math>a<b</math>", {"wiki/formula"}),
        ("a '''b''' __NOTOC__ <ref>x</ref> [https://e.example x]", {"wiki/inline"}),
        ("\\section{A}", {"latex/heading"}),
        ("\\begin{itemize}\n\\item $x^2$\n\\end{itemize}", {"latex/list", "latex/formula"}),
        ("\\begin{verbatim}\n\\section{x}\n\\end{verbatim}", {"latex/code"}),
        ("\\begin{tabular}{ll}\na & $b_1$ \\\\\n\\end{tabular}", {"latex/table"}),
        ("with $k^{2} \\le 4$ and \\(a\\) and $$b$$", {"latex/formula"}),
        ("a\\footnote{b} \\emph{c}", {"latex/inline"}),
        ("```html\n<b>x</b>\n```\n`\\emph{x}` ~~~\n", set()),
        ("```\n<b>never closed", set()),
        ("cost $3 and $4, 9 < 11 and s > c, C:\\section\\new on disk", set()),
        ("- ## H\n* a\n# b\n**bold** ==mark== [[L]] {{query (x)}} key:: v\n| a | b |\n|---|---|\n[t](u) ![i](../assets/i.png)", set()),
        ("<!-- region: a --> <Region id='x'></Region>\n<SectionHeading level={2}>T</SectionHeading> <a@b.example>", set()),
        ("R&D; AT&T <nosuchtag> a<b", set()),
        ("", set()),
    ],
)
def test_elements(text, expected):
    assert kinds(text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<h2>T</h2>\ntext", "## T\n\ntext"),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table>", "| a | b |\n|---|---|\n| 1 |  |"),
        ("<pre>a\nb</pre>", "```\na\nb\n```"),
        ("== H ==\n'''b''' ''i''", "## H\n**b** *i*"),
        ("{|\n|-\n! a !! b\n|-\n| 1 || 2\n|}", "| a | b |\n|---|---|\n| 1 | 2 |"),
        ("\\section{A}\n\\begin{equation}\nx\n\\end{equation}", "## A\n\n$$x$$"),
        ("a &amp; b<br>c", "a & b\nc"),
        ("plain\n- x", "plain\n- x"),
        (None, None),
        ("", ""),
    ],
)
def test_clean(text, expected):
    assert M.clean(text) == expected


def test_long_records_keep_short_pieces():
    prose = "A sentence, with marks. " * 210
    item = "An item, of three marks; about the mill and the weir and what stands near it, as it was when the hub was built."
    got = M.clean(f"{prose}<ul><li>Mill</li><li>{item}</li></ul>{prose}<div><h2>Results</h2></div><div>an <b>x</b></div>\\begin{{itemize}}\n\\item Hub\n\\end{{itemize}}")
    assert all(x in got for x in ("- Mill", f"- {item}", "## Results", "an x", "Hub"))


def test_ratios_tell_navigation_from_the_article():
    link = '<a href="/{0}">{0}</a>'
    row = " ".join(link.format(x) for x in ("Home", "Mill", "Weir", "Hub", "Map", "Log"))
    prose = "The <b>mill</b> stands by the weir, and the <i>hub</i> is near; see <a href='/m'>the map</a> for it. It was built late, as all was. " * 4
    page = f"<div>{row}</div>\n<div>{prose}</div>\n<div>{row}</div>"
    got = M.clean(page)
    # The same tags hold the menu and the article's links, so no list of tags could tell them apart.
    assert "Home" not in got and "Log" not in got and "mill" in got and "hub" in got and "It was built late" in got
    assert got.count("see") == 4
    # Without an article beside it the row is the record; a list of links is a list.
    assert M.clean(f"<div>{row}</div>").split() == ["Home", "Mill", "Weir", "Hub", "Map", "Log"]
    assert "- Home" in M.clean(f"<ul><li><a href='/h'>Home</a><li><a>Mill</a><li><a>Weir</a></ul><div>{prose}</div>")
    assert "One" in M.clean(f"<p>One</p><p>Two</p><p>Three</p><div>{prose}</div>")


def test_deep_paths_end():
    assert "x" in M.clean("<div>" * 5_000 + "x" + "</div>" * 5_000)
    assert len({n.path for n in M.scan("<b>" * 40 + "x")}) == 41


def test_long_inline_formula():
    assert kinds("a $" + "x_1 + " * 100 + "y$ b") == {"latex/formula"}


def test_nodes_cover_the_text():
    text = "a <b>b</b> == x ==\n\\section{y} $z_1$ ```\n<i>\n```"
    at = 0
    for n in M.scan(text):
        assert n.start == at
        at = n.end
    assert at == len(text)


def test_long_texts_end():
    for text in ("<" * 20_000, "$a" * 20_000, "'" * 5_000, "\\begin{x}" * 2_000, "<table>" * 3_000, "= " * 20_000, "`" * 5_001):
        M.elements(text)


def test_last_delivery_counts(spark):
    rows = [(1, "<b>x</b>", datetime(2024, 1, 1), "m"), (1, "== H ==", datetime(2024, 1, 2), "m"), (2, None, None, "m"), (3, "", datetime(2024, 1, 1), "m"), (None, "<b>", None, "m"), (4, "<b>y</b>", None, "m"), (4, "<b>y</b>", None, "m")]
    df = spark.createDataFrame(rows, "page_id long, raw_content string, loaded_at timestamp, markup string")
    assert sorted(tuple(r) for r in M.markup_elements(df, "page_id", "raw_content").collect()) == [(1, "wiki", "heading"), (4, "html", "inline")]
    assert {r["page_id"]: r["clean"] for r in M.clean_texts(df, "page_id", "raw_content").collect()} == {1: "## H", 2: None, 3: "", 4: "y"}
    assert M.markup_elements(df.limit(0), "page_id", "raw_content").count() == 0


@pytest.mark.parametrize(
    "text, expected",
    [
        ("to a.b+c@x-y.example, ok", [("email", "a.b+c@x-y.example")]),
        ("JUNO+KB@A.TEST by", [("email", "JUNO+KB@A.TEST")]),
        ("a (at) b.example and c [at] d [dot] test>", [("email", "a (at) b.example"), ("email", "c [at] d [dot] test")]),
        ("juno AT weir.post DOT test, has", [("email", "juno AT weir.post DOT test")]),
        ("[x](mailto:a@b.test)", [("email", "a@b.test")]),
        ("chart@2x.png digest@8.13.17 @todo look at the page", []),
        ("(+44 7700 900643 answers", [("phone", "+44 7700 900643")]),
        ("☎ (476) 555-0122 / x", [("phone", "(476) 555-0122")]),
        ("0044 (0)7700 900 659. 030/23125755, 01632 960692", [("phone", "0044 (0)7700 900 659"), ("phone", "030/23125755"), ("phone", "01632 960692")]),
        ("19575550172 or 789.555.0173 or 01 99 00 77 97 or +33 1 99 00 92 70", [("phone", "19575550172"), ("phone", "789.555.0173"), ("phone", "01 99 00 77 97"), ("phone", "+33 1 99 00 92 70")]),
        ("SSN 994 49 5914. 923-12-5068, QQ 11 63 71 C; XW6977379, 03 327 377 233", [("id_number", x) for x in ("994 49 5914", "923-12-5068", "QQ 11 63 71 C", "XW6977379", "03 327 377 233")]),
        ("PO-6711-1186, rows 459-3813 of 47353, 10.40.86.4 on 2022-10-24, 415.30 Z-111", []),
        ("id:: 16435973-3102-4b44-8111-178005548203", []),
        ("at 43 Kiln Avenue, Norvale QX1 2ZZ, second floor", [("address", "43 Kiln Avenue, Norvale QX1 2ZZ")]),
        ("125 Lantern Rd., Apt 7, Pellmoor. Next", [("address", "125 Lantern Rd., Apt 7, Pellmoor")]),
        ("47 bis, rue du Lantern, 00519 Halbrook", [("address", "47 bis, rue du Lantern, 00519 Halbrook")]),
        ("Orchardstraße 192, 00847 Eastmere.", [("address", "Orchardstraße 192, 00847 Eastmere")]),
        ("Tidewater Lane 25b, Quarrington-on-Weir;", [("address", "Tidewater Lane 25b, Quarrington-on-Weir")]),
        ("Lantern Street Project meets in room 9", []),
        ("", []),
    ],
)
def test_structured(text, expected):
    assert [(k, text[a:b]) for k, a, b in pii.structured(text)] == expected


def bodies(spark, extra=()):
    given, family = ["Mara", "Bram", "Ilse", "Noor"], ["Harrowgale", "O’Brackenry", "Vandersluys-Ek"]
    rows, k = [], 0
    for g in given:
        for f in family:
            rows += [f"- Thanks to Dr. {g} {f} for it.", f"- {g} {f} drew it.", f"- {f}, {g} – 01632 960692", f"- signed {g[0]}. {f}, for it", f"- The {f} method works. Ring {g} {f} on it."]
    rows += ["- Sandhaven Press and Norvale Foundry merged."] * 6 + ["- Ring Norvale about the Quarry Foundry."] * 6
    rows += list(extra) + ["- The mill stands by the weir. A hub is near. It was old."] * 20
    return spark.createDataFrame([(i, t, datetime(2024, 1, 1), "k") for i, t in enumerate(rows)], "body_id long, body string, loaded_at timestamp, kind string")


def test_names_are_learned(spark):
    df = bodies(spark, [None, ""])
    got = pii.find_personal(df.union(df.limit(3)), "body_id", "body").filter("kind = 'name'").select("body_id", "value").collect()
    assert len(got) == len({tuple(r) for r in got}) == 4 * 3 * 5
    values = {r["value"] for r in got}
    assert {"Mara Harrowgale", "O’Brackenry, Ilse", "N. Vandersluys-Ek"} <= values
    assert not any(x in v for v in values for x in ("Press", "Foundry", "Norvale", "Ring", "The", "Dr"))


def test_framed_names_of_skewed_families(spark):
    extra = ["- The Harrowgale project moved the Harrowgale mill."] * 300
    extra += ["- Then the Owner, the Press, the Engineer and the Foundry met near Norvale."] * 100 + [
        "- Plan B. Then it rained, then it stopped. Go from A to B. Then rest.", "- The Sr. Software Engineer left.", "- software by an engineer",
        "- Dr. Harrowgale Foundry", "- Plan B. Norvale opens", "- Ask Mr. Otto Quern.", "- Lea Quill: lea.quill@x.test", "- Owner Quill: o.quill@x.test", "- Norvale Press, 01632 960692",
    ]
    got = pii.find_personal(bodies(spark, extra), "body_id", "body").filter("kind = 'name'").collect()
    values = [r["value"] for r in got]
    assert len(values) == 4 * 3 * 5 + 2 and {"Otto Quern", "Lea Quill"} <= set(values)
    assert sum("Harrowgale" in v for v in values) == 4 * 5


def test_redacted(spark):
    got = {r["body_id"]: r["redacted"] for r in pii.redact(bodies(spark, ["a@b.test and 923-12-5068", None, ""]), "body_id", "body").collect()}
    assert got[0] == "- Thanks to Dr. [NAME] for it." and got[2] == "- [NAME] – [PHONE]"
    assert got[72] == "[EMAIL] and [ID_NUMBER]" and got[73] is None and got[74] == ""


@pytest.mark.parametrize("last", [None, "", "no data"])
def test_the_last_delivery_of_a_body_counts(spark, last):
    old, new = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [(1, "write to a@b.test", old), (1, last, new), (2, "call (476) 555-0122 now", new), (2, None, old), (3, "x@y.test", old), (3, "or z@y.test", old)]
    df = spark.createDataFrame(rows, "body_id long, body string, loaded_at timestamp")
    for whole in ("true", "false"):
        spark.conf.set("spark.sql.codegen.wholeStage", whole)
        spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK" if whole == "true" else "NO_CODEGEN")
        got = {r["body_id"]: r["redacted"] for r in pii.redact(df, "body_id", "body").collect()}
        assert (got[1], got[2]) == (last, "call [PHONE] now") and got[3] in ("[EMAIL]", "or [EMAIL]")
        assert {r["body_id"] for r in pii.find_personal(df, "body_id", "body").collect()} == {2, 3}


def test_nothing_personal(spark):
    df = bodies(spark)
    assert pii.find_personal(df.limit(0), "body_id", "body").count() == 0
    plain = spark.createDataFrame([(1, "no names here", None)], "body_id long, body string, loaded_at timestamp")
    assert pii.find_personal(plain, "body_id", "body").count() == 0


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Dear {{name}}, hi", True), ("short:: <%= x %>", True), ("## ${entry.x}", True), ("a %%X%% b", True), ("[INSERT X HERE]", True), ("[Your hub name] x", True),
        ("__MILL_NAME__", True), ("{anchor_title}", True), ("[[[X]]]", True), ("{% for a in b %}", True), ("[hier Mill eintragen]", True), ("#{x}", True), ("@@X@@", True),
        ("<insert property>", True),
        ("{{query (and [[a]])}} {{embed ((x))}}", False), ("`{{x}}` or `<%= y %>`", False), ("```yaml\ntitle: {{ page.x }}\n```", False),
        ("set {} and {a, b}; [ ] [x] [sic] [^a]", False), ("[Your page](https://x.example)", False), ("\\emph{a_b}", False), ("", False),
    ],
)
def test_placeholders(text, expected):
    assert R.has_placeholder(text) is expected


@pytest.mark.parametrize("begin, end", [("{{", "}}"), ("{%", "%}"), ("<%", "%>"), ("${", "}"), ("#{", "}"), ("%%", "%%"), ("@@", "@@"), ("[[[", "]]]"), ("[Insert ", "]"), ("<<", ">>"), ("<insert ", ">")])
def test_placeholders_of_any_length(begin, end):
    assert R.has_placeholder(f"a {begin}{'Short description of the project and its goals ' * 40}{end} b")
    assert not R.has_placeholder(f"a {begin}{'Short description ' * 40}\n{end} b")
    R.has_placeholder(begin * 20_000)


def test_long_error_lines():
    assert R.is_error("ValueError: " + "no such anchor in the vault " * 20) and R.is_error(f'File "/{"site/" * 60}a.py", line 3, in run')


@pytest.mark.parametrize(
    "text, expected",
    [
        ("ok\nLorem ipsum dolor sit amet consectetur", True), ("Terga velum canto porta lumen orbis.", True), ("xxx xxx xxx xxx xxx xxx", True), ("Your text here. Your text here.", True),
        ("This is a sample hub. Replace this paragraph with your own words before publishing.", True), ("Hier steht später Ihr Text zum Thema X. Dies ist nur ein Blindtext ohne Sinn und Zweck.", True),
        ("Write a short introduction of the hub here. Two or three sentences are enough.", True), ("- Content coming soon. Content coming soon.", True),
        ("We threw out the lorem ipsum block and wrote a proper satchel.", False), ("A normal sentence about the hub and the mill.", False), ("```\ntest test test test test\n```", False), ("", False),
    ],
)
def test_filler(text, expected):
    assert R.has_filler(text) is expected


def test_long_error_pages(spark):
    frames = "\n".join(f'  File "/srv/site/page_{i}.py", line {i}, in run\n    value = load(anchor_{i})' for i in range(20))
    rows = [
        (1, f"Traceback (most recent call last):\n{frames}\nValueError: no such anchor", "s", "T"),
        (2, "\n".join(f"key{i}:: {'value ' * 20}" for i in range(30)) + "\n\n404 Not Found", "s", "T"),
        (3, f"- The mill broke down with this:\n\nTraceback (most recent call last):\n{frames}\nValueError: no such anchor\n\n- We mended it.", "s", "T"),
        (4, "404 Not Found\n\n" + "- The mill stands by the weir.\n" * 40, "s", "T"),
        (5, "Menu | Pages | About\n" * 90 + "Please enable JavaScript to view this page.\n" * 12, "s", "T"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, title string")
    assert {r["doc_id"] for r in R.find_residue(docs).filter("error_page").collect()} == {1, 2, 5}


def test_residue(spark):
    page = "type:: note\n\n- A real page about the mill.\n- It goes on.\n- And on."
    rows = [
        (1, "404 Not Found\nnginx\nMenu", "s1", "T"),
        (2, "type:: x\n\nHome | Pages | About\nPlease enable JavaScript to view this page.", "s2", "T"),
        (3, page, "s1", "T"),
        (4, "Please enable JavaScript to use the search box.\n\n" + page, "s1", "T"),
        (5, "- The crawler met a 404 Not Found on the mill and went on.", "s1", "T"),
        (6, None, None, None), (7, "", "s", "t"), (8, "  \n ", "s", "t"), (9, "Dear {{x}}", None, None), (9, "Dear {{x}}", None, None),
        (10, "Menu\nSearch", "s", "T"),
        *[(20 + i, "Access denied\nPlease ask the warden of this place for a new key.", f"h{i % 2}", f"Title {i}") for i in range(4)],
        (30, "Access denied\nA note that only this page has, about something else.", "h1", "Z"),
        (None, "404 Not Found", "s", "t"),
    ]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, source string, title string, host string")
    got = {r["doc_id"]: (r["placeholder"], r["filler"], r["error_page"]) for r in R.find_residue(docs).collect()}
    assert set(got) == {1, 2, 9, 20, 21, 22, 23} and got[9] == (True, False, False) and got[20] == (False, False, True)
    assert R.find_residue(docs.limit(0)).count() == 0
    kept = {r["doc_id"] for r in R.without_residue(docs).collect()}
    assert kept == {3, 4, 5, 6, 7, 8, 10, 30, None}


#: Wordings that played no part in the choice of words: responses, and texts that speak about such things.
RESPONSES = (
    "HTTP Error 418", "The requested resource is no longer available.", "Connection refused", "Request failed with status code 502",
    "This service is temporarily unavailable. Please try again later.", "You need to sign in to view this page. Access denied.", "Sorry, this file has been deleted.\nError code: 7f3a-11",
    "Cookies must be enabled to continue.", "Your browser does not run scripts. Please enable JavaScript.", "Please wait…", "Loading page…\nJavaScript is required.",
    "The page could not be found", "Session timeout. Please log in again.", "Too Many Requests\nRetry later.", "Zugriff verweigert", "Fehler 403", "Die Adresse existiert nicht.",
    "Accès refusé", "Cette page n'existe pas.", "Acceso denegado", "Pagina non trovata", "Ошибка 404", "Server error in app.\nRequestError: no response", "Unsupported Media Type",
    "Site is down for maintenance. Check again in 30 minutes.",
)
SPEAKING = (
    "Error handling in Rust", "Error 500 means the server failed and every engineer should read it.", "How we cut the error rate of the weir by half", "JavaScript for gardeners",
    "The page about forbidden fruit was written in spring.", "A 404 in the mill's ledger is the number of a sack.", "Permission to fish is given by the warden of the pond.",
    "We found nothing in the archive, yet the map exists.", "Scripts of the old theatre and their authors", "Cookies and bread: two recipes", "Loading a cart takes two people and a mule.",
    "An exception to the rule of thumb", "The bridge was closed for repairs after a flood.", "Access to the quarry by the northern road", "Failure is a good teacher of masons",
    "Fehlerkultur in kleinen Teams und was sie bringt", "Une erreur fréquente des jeunes meuniers", "Connection between tides and moon", "The server brought tea and cake.",
    "- Notes on timeouts\n- Retries need a limit\n- We chose three",
)


def test_wordings_not_seen_before():
    def page(text):
        failed, _, left = R.compared(text, "A title")
        return failed and not left

    hits, wrong = sum(map(page, RESPONSES)), [t for t in SPEAKING if page(t)]
    assert hits >= 0.9 * len(RESPONSES), [t for t in RESPONSES if not page(t)]
    assert len(wrong) <= 0.1 * hits, wrong
    assert not page("Error handling in Rust") and not page(SPEAKING[1])


STAND_INS = (
    "Placeholder text.", "Sample content goes here.", "This is dummy copy. Please replace it.", "Add your description here.", "Insert a heading here", "Replace this section with your own words.",
    "Text coming soon.", "Beispieltext. Bitte ersetzen.", "Texte d'exemple. Remplacez ce texte.", "Texto de ejemplo. Reemplaza este texto.", "Your body text here", "Lorem ipsum dolor sit amet.",
)
REAL = (
    "We replace the rope each spring.", "The sample was taken from the pond.", "He will be here soon.", "The text of the charter is kept in the hall.", "A dummy stood in the window of the tailor.",
    "The introduction names the keeper and the place of the mill.", "Here the road turns to the weir.", "Swap the old stones before winter comes.", "Ein Beispiel für Wasserräder aus Holz.",
)


def test_stand_ins_not_seen_before():
    hits, wrong = sum(map(R.has_filler, STAND_INS)), [t for t in REAL if R.has_filler(t)]
    assert hits >= 0.9 * len(STAND_INS), [t for t in STAND_INS if not R.has_filler(t)]
    assert not wrong


def test_the_same_response_once_or_often(spark):
    line = "Error 503: Service unavailable. Please try again later."
    rows = [(1, line), (2, "\n".join([line] * 9)), (3, "\n".join([line] * 400))]
    docs = spark.createDataFrame([(k, t, "s", "T") for k, t in rows], "doc_id long, text string, source string, title string")
    assert {r["doc_id"] for r in R.find_residue(docs).filter("error_page").collect()} == {1, 2, 3}


def test_duplicated_responses_need_hosts_and_other_titles(spark):
    body = "Access denied\nThe keeper of this orchard keeps its gate shut for {}."
    rows = [(i, body.format(f"Mr Quern{i}"), f"h{i % 3}", f"Orchard {i}") for i in range(6)]
    rows += [(10 + i, f"Access denied\nOnly one house has this sentence about a cellar number {i}.", "h1", "Cellar") for i in range(6)]
    rows += [(20 + i, "Access denied was what the sign of the weir said for years.", f"h{i}", "Access denied, a history") for i in range(6)]
    # Repeated rows of one document aren't several documents.
    rows += [(30, "Access denied\nThis sentence came six times with one document.", f"h{i}", "T") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, title string")
    assert {r["doc_id"] for r in R.find_residue(docs).collect()} == set(range(6))
    assert {r["doc_id"] for r in R.find_residue(docs, min_hosts=4).collect()} == set()
