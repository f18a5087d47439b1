import re

import pytest

from lucerna.llm import residue as r

REAL = "The wave keeps the floor from breaking up when the camera gets close."
CASES = [
    "Welcome to {{ name }}. " + REAL, "Name: fog\nAuthor: ${author}\nDescription: " + REAL, "Published under @@license@@, see below. " + REAL, "Hello [INSERT USER HERE], thanks for your upload! " + REAL, "Name: (add title later)", "Author: <your name>\n" + REAL,
    "Welcome to __TITLE__. " + REAL, "Author: #USER#\n" + REAL, "Name: {title}", "Lorem ipsum dolor sit amet consectetur elit.\n" + REAL, "Please enable JavaScript to view this shader.", "Neon Tide\n\nSeite nicht gefunden. Der Eintrag wurde gelöscht.",
    "404 Not Found\n\nThe page you asked for could not be delivered.", "页面不存在或已被删除。(404)", "Traceback: template render failed for entry 7, showing nothing", "Description: TBD"]
OTHERS = [
    REAL, "", "  \n ", None, "The macro __VERSION__ is predefined and %3 is the modulo here. " + REAL, "In our script the header is:\n```\n// name: {{title}}\n```\n" + REAL, "const url = `/shader/${id}?v=${version}`; " + REAL, 'Our logger prints "<your name>" for empty titles. ' + REAL,
    "When an id is wrong the old site answered '404 Not Found' with a grey page. " + REAL * 2, "Demo of glyphs: the line shows 'lorem ipsum' in an 8x8 font. " + REAL, "0(12) : error C0000: syntax error", "void main(){ if(a){discard} }", "Name: fog\nAuthor: ann", "Name: sea\nAuthor: bob",
    "Welcome to Bob. " + REAL, "float m[2][2] = {{1., 2.}, {3., 4.}}; " + REAL, "x" * 200_000]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'k' as kind", "1 as key", "2 as fill")


#: Each confirms the case at its place: another content of the slot, the same filler or the same page.
PEERS = [
    "Welcome to Ann. " + REAL, "Name: sea\nAuthor: ann\nDescription: a sea\nTopics: x", "Published under zlib, see below. " + REAL, "Hello Ann, thanks for your upload! " + REAL, "Name: fog", "Author: bob\n" + REAL,
    "Welcome to {{ title }}. " + REAL, "Author: #NAME#\n" + REAL, "Name: moon", "Lorem ipsum dolor sit amet sed do.\n" + REAL, "Please enable JavaScript to view this shader.", "Seite nicht gefunden. Der Eintrag wurde gelöscht.",
    "500 Not Found\n\nThe page you asked for could not be delivered.", "页面不存在或已被删除。(500)", "😀Traceback: template render failed for entry 9, showing nothing", "Description: a fog"]


def test_found(spark):
    df = frame(spark, CASES + OTHERS + PEERS + CASES[:1])
    got = {x.doc_id for x in r.found(df).collect()}
    n, m = len(CASES), len(CASES) + len(OTHERS)
    assert {i for i in range(n) if i not in got} == set(), "missed"
    assert {i for i in got if n <= i < m} == set(), "wrong"
    assert {i - m for i in got if m <= i < m + len(PEERS)} == {6, 7, 9, 10, 11, 12, 13, 14}
    assert m + len(PEERS) in got and r.clean(df).count() == len(OTHERS) + 8 and r.clean(df).columns == df.columns


def test_no_row_comes_from_a_list_alone(spark):
    for text in CASES:
        assert r.found(frame(spark, [text, REAL])).count() == 0, text


def test_bare_names_and_gaps_beside_filled_slots(spark):
    texts = ["Welcome, USER_NAME. " + REAL, "Welcome, . " + REAL, "Welcome, Ann. " + REAL, "Welcome, Bob. " + REAL, "We use MAX_STEPS at night. " + REAL, "Sent by  in May. " + REAL, "Sent by Ann in May. " + REAL, "Sent by Bob Lee in May. " + REAL]
    assert sorted(x.doc_id for x in r.found(frame(spark, texts)).collect()) == [0, 1, 5]


def test_long_equal_pages(spark):
    page = "Error 503. The page you asked for is not available. " + "The server could not be reached and the request failed. Please try again to load the page later on this server. " * 4
    assert 400 < len(page) < 700 and r.found(frame(spark, [page] * 20 + [REAL] * 20)).count() == 20 and r.found(frame(spark, [page, REAL])).count() == 0


def test_filler_vocabulary_grows_from_the_corpus(spark):
    seeds = ["Lorem ipsum velor toren malden quorit.", "Lorem ipsum quorit velor malden toren alis.", "Malden toren velor quorit malden.", REAL]
    assert sorted(x.doc_id for x in r.found(frame(spark, seeds)).collect()) == [0, 1, 2]


def test_weak_forms_need_an_aligned_slot(spark):
    assert r.found(frame(spark, ["Welcome to __TITLE__. " + REAL])).count() == 0
    assert r.found(frame(spark, ["Welcome to __TITLE__. " + REAL, "Welcome to __USER__. " + REAL])).count() == 2


def test_empty(spark):
    assert r.found(frame(spark, ["a"]).limit(0)).count() == 0 and r.found(frame(spark, [None, "", " "])).count() == 0


@pytest.mark.parametrize("a, b", [("Error 404 here", "Error 500 here"), ("id ab12 gone", "id x9 gone")])
def test_page_templates(a, b):
    assert r.page_words(a) == r.page_words(b)


@pytest.mark.parametrize("text", ["To use this without scripts, copy the code into the offline viewer. The web preview needs JavaScript and WebGL, but the viewer does not. " + REAL, "Q: why do I get 'access denied' when saving? A: the folder was read only. After a chmod it worked.", REAL, "", "0(12) : error C0000: undefined variable \"p\""])
def test_talk_is_no_page(text):
    assert r.message_keys(text) == set()


def test_bit_set(spark):
    df = spark.createDataFrame([(0,), (5,), (32767,), (32768,), (r.BITS - 1,), (5,)], "b long")
    bits = r.bit_set(df)
    assert [i for i in range(r.BITS) if r.has(bits, i)] == [0, 5, 32767, 32768, r.BITS - 1] and len(bits) == r.BITS // 8


def test_filled_blank_and_constant_slots_are_aligned(spark):
    texts = ["Welcome to __USER__. " + REAL, "Welcome to Bob. " + REAL, "(halo) This effect was made by [[author]] in one evening.", "This effect was made by Ann Lee in one evening.",
             "This effect was made by in one evening.", "name: {title}", "name: a fog that comes from the sea and goes on", "Shader number #NR# of the set. One.", "Shader number #NR# of the set. Two.", "Use the key __X__ at night. " + REAL, REAL, "{who} wrote this on a train.", "Ann wrote this on a train.", "wrote this on a train."]
    assert sorted(x.doc_id for x in r.found(frame(spark, texts)).collect()) == [0, 2, 4, 5, 7, 8, 11]


def test_blank_labels(spark):
    texts = ["Author: ann\nName: fog", "Author:\nName: sea", "Author:\nmade by a friend of mine", "Controls:\nName: fog"]
    assert [x.doc_id for x in r.found(frame(spark, texts)).collect()] == [1]


def test_long_pages_count_if_repeated(spark):
    html = "<html><head><title>404 Not Found</title><style>p { color: red }</style></head>\n<body><h1>Page not found</h1>\n<p>The page you asked for could not be found on this server.</p>\n" + '<a href="/a/long/link/to/some/other/place">Home</a>\n' * 8 + "</body></html>"
    cookies = "We use cookies to make this site better for you. Accept all cookies or choose which. You must enable JavaScript to save your choice. Your browser is not supported in its old version. You can change that at any time."
    talk = "The old site answered page not found when an id was wrong. " + (REAL + " ") * 4
    texts = [html, html, cookies, cookies, talk, talk, html.replace("page", "file").replace("server", "machine")]
    assert sorted(x.doc_id for x in r.found(frame(spark, texts)).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("page", ["502 Bad Gateway", "Please sign in to access this page.", "Log in to view the content of this site.", "Página no encontrada.", "Pagina non trovata.", "Strona nie istnieje.", "Contenido no disponible."])
def test_messages_of_short_words_are_read(page):
    assert {k for kind, k, _ in r.evidence(1, page, r.LATIN) if kind == "page"} == r.message_keys(page) != set()


def test_pages_of_short_words(spark):
    pages = ["502 Bad Gateway", "Please sign in to access this page.", "Página no encontrada.", "Strona nie istnieje."]
    assert sorted(x.doc_id for x in r.found(frame(spark, pages * 2 + [REAL, "Log in one step, a bad page in the other. " + REAL])).collect()) == list(range(8))


def test_words_of_a_field_do_not_veto_it(spark):
    texts = ["Made by (FILL IN NAME HERE) of ours. " + REAL, "Made by Ann of ours. " + REAL, "Name: (Fill in title later)", "Name: fog", "Welcome, {{ template_variable }} of old. {{ template }} came first.", "Welcome, Ann of old. Bob came first.",
             "Sent by {{ user }} in May, with a template. " + REAL, "Sent by Ann in May, with love. " + REAL, "Sent by Bob in May, or June. " + REAL, "The macro __LINE__ is predefined. " + REAL, "The macro ABC is predefined. " + REAL, "The macro foo is predefined. " + REAL]
    assert sorted(x.doc_id for x in r.found(frame(spark, texts)).collect()) == [0, 2, 4, 6]


def test_defaults_beyond_ascii_labels_and_within_sentences(spark):
    texts = ["Автор: TBD", "Автор: Анна", "作者：TBD", "作者：安娜", "AUTHOR: to be added", "AUTHOR: ann", "author: tbd", "author: ann", "author: bob", "Published under TBD, see below. " + REAL, "Published under zlib, see below. " + REAL,
             "Published under MIT, see below. " + REAL, "Coming soon.", "coming soon.", "Todo es niebla. " + REAL, "Esto es todo el mar. " + REAL, "Esto es casi el mar. " + REAL, "Esto es solo el mar. " + REAL, "float a=1.; // TODO: replace a by something", "float b=1.; // fog: replace a by something"]
    assert sorted(x.doc_id for x in r.found(frame(spark, texts)).collect()) == [0, 2, 4, 6, 9, 12, 13]


def test_short_and_mixed_filler(spark):
    texts = ["Title: Lorem ipsum", "Lorem ipsum.", REAL[:-1] + " lorem ipsum dolor sit amet", "The fog is thin dolor sit amet consectetur elit and moves on.", "Lorem ipsum dolor sit amet consectetur elit.", "The placeholder is lorem ipsum in an 8x8 font.", "We do sit here. " + REAL, "Do sit et al. " + REAL]
    assert sorted(x.doc_id for x in r.found(frame(spark, texts)).collect()) == [0, 1, 2, 3, 4]


def forms(tree):
    """Every string that a parsed pattern matches, sets of letters by their first, open repeats once."""
    out = [""]
    for op, arg in tree:
        match str(op):
            case "LITERAL": now = [chr(arg)]
            case "SUBPATTERN": now = forms(arg[3])
            case "BRANCH": now = [x for branch in arg[1] for x in forms(branch)]
            case "IN": now = [chr(v) if str(o) == "LITERAL" else "q" for o, v in arg if str(o) != "NEGATE"]
            case "MAX_REPEAT": now = [x for n in {arg[0], min(arg[1], arg[0] + 1)} for x in (forms(list(arg[2]) * n) if n else [""])]
            case "AT": now = [""]
            case other: raise ValueError(other)
        out = [a + b for a in out for b in now]
    return out


@pytest.mark.parametrize("name", ["STATE", "BROWSER", "AGAIN"])
def test_the_quick_test_passes_every_message(name):
    found = forms(re._parser.parse(getattr(r, name).pattern, re.I))
    assert len(found) > 10 and [x for x in found if not any(w in x.lower() for w in r.PARTS)] == []


def test_a_quotation_may_join_a_message():
    assert r.message_keys("The page was not\"\"found: page not'x y'found.") == set() and r.message_keys('Page not"x"found.') != set()
