import pytest

from inkwell.llm import layout, spam

PAGE = ["Home | News | Sport | Fekuzu | Contact", "We use cookies to remember your choices.", "Accept all", "You are here: Home › Town › How the bri Somebody",
        "How the bridge of Nafora was moved", "By Ann Example, staff writer | 3.2.2022", "", "The old bridge was moved to the river in the night, and nobody in the town had seen it.",
        "250 g flour", "2 eggs", "Most read", "1. Why the mill was closed", "2. The ferry of Baro", "Alpha | Beta | 1:2", "Gamma | D | 10:3",
        "It was the first time that a bridge had been moved in this way.", "Share this page (12)", "© 2022 Some Post. All rights reserved.", "Some Post, 12 Mill Lane, Town"]
OWN = {5, 8, 9, 10, 14, 15, 16}


def test_roles():
    numbered = list(enumerate(PAGE, 1))
    hidden = set(layout.hidden_lines(numbered))
    assert hidden == {n for n, x in numbered if x} - OWN


def test_rendered_with_blocks_and_cells():
    text = layout.render(layout.build(list(enumerate(PAGE, 1))))
    assert "250 g flour\n\n2 eggs" in text or "250 g flour\n2 eggs" in text
    assert "Alpha | Beta | 1:2\nGamma | D    | 10:3" in text
    assert "cookies" not in text and "Most read" not in text and "Mill Lane" not in text
    assert text.startswith("How the bridge of Nafora was moved\n\nThe old bridge")


def test_cookies_in_an_article_stay():
    assert layout.role("She bakes cookies in the town and accepts all orders by post.")[0] is None
    assert layout.role("")[0] == "blank" and layout.role(None)[0] == "blank"


@pytest.mark.parametrize("line", ["Menu", "Accept cookies", "This site relies on cookies.", "Continue reading below", "By the staff", "Tweet", "Copyright 2020 Acme", "Menú",
                                  "Aceptar cookies", "Este sitio utiliza cookies.", "Sigue leyendo", "Por la redacción", "Tuitear", "Todos los derechos reservados", "Terms of use \ufffd Privacy \ufffd Imprint \ufffd Accessibility",
                                  "NOT\ufffdCIAS", "Read next: How the mill was sold", "Ver\ufffdffentlicht von A B am 3. M\ufffdrz", "\ufffdltimas not\ufffdcias", "Dosasuth: 16 \ufffdC / Femise: 10 \ufffdC", "Ao continuar, aceita a nossa política."])
def test_common_notices(line):
    assert layout.role(line)[0] in layout.HIDDEN


@pytest.mark.parametrize("line", ["She bakes cookies in the town and accepts all orders by post.", "The menu of the evening was short, and nobody read it.", "He sent a tweet about it.",
                                  "The copyright on the book had run out.", "Share prices fell in the night."])
def test_their_words_in_an_article(line):
    assert layout.role(line)[0] is None


def test_unnumbered_box_leaves_the_headline():
    lines = ["Related articles", "The mill of the town", "The boat of the lake", "The road to the hill", "The road was closed by the council in the spring."]
    assert layout.hidden_lines(list(enumerate(lines, 1))) == [1, 2, 3]


def test_a_box_of_many_titles_ends_at_the_first_text():
    titles = [f"The boat of the lake {w}" for w in "abcdefghijklmnopqrst"]
    lines = [PAGE[4], PAGE[7], "Related articles", *titles, PAGE[15]]
    assert layout.hidden_lines(list(enumerate(lines, 1))) == list(range(3, 4 + len(titles)))


SPAM = {
    1: ["phone case cheap phone case best phone case cheap"] * 3 + ["phone case buy phone case outlet phone case sale"],
    2: ["http://a.example/1", "Lamp - http://b.example/", "[x](https://c.example/x)", "http://d.example/2"],
    3: ["Tags Foo", "lamp foo (3)", "desk chair foo (29)", "bench bar (4)", "lamp bar (88)"],
    4: ["SKU 123 Foo lamp in stock", "#lamp #foo #sale", "phone case XL 38.99", "#cheap #lamp"],
    5: ["lampe de chevet Foo | lampe de chevet Bar | lampe de chevet Baz", "lampe de chevet Qux | lampe de chevet Zap"],
}
GOOD = {
    11: ["The bridge was moved to the river in the night, and nobody had seen it.", "It was the first time that this had been done to a bridge."] * 3,
    12: ["How to bake", "250 g flour", "100 g butter", "You mix the flour with the butter and wait for an hour. It is done when the top is brown."],
    13: [None, "", "  "],
    14: ["Home | News | Sport | Contact | Help", "The bridge was moved to the river in the night."],
}


def table(spark, pages, extra=()):
    data = [(d, n, x) for d, p in pages.items() for n, x in enumerate(p, 1)]
    return spark.createDataFrame([*data, *data[:5], *extra], "doc_id bigint, line_no int, line string")


def test_spam_pages(spark, rows):
    more = {100 + i: GOOD[11] for i in range(10)}
    assert rows(spam.spam_pages(table(spark, SPAM | GOOD | more))) == [(d,) for d in sorted(SPAM)]
    assert rows(spam.spam_pages(table(spark, {}))) == []


def test_furniture_leaves_out_spam_pages(spark, rows):
    df = table(spark, SPAM | {50: PAGE} | {100 + i: GOOD[11] for i in range(10)}, [(None, 1, "x"), (60, None, "y")])
    assert rows(spam.furniture(df)) == sorted([(50, n) for n, x in enumerate(PAGE, 1) if x and n not in OWN], key=repr)


def test_lines_that_a_site_repeats_are_furniture_in_any_words(spark, rows):
    own = "The bridge {} was moved to the river in the night, and nobody had seen it."
    pages = {i: ["Zure pribatutasuna garrantzitsua da.", own.format(f"of {'abcdefgh'[i]}"), "Partekatu orri hau 12", f"Idazlea {'abcdefgh'[i]}"] for i in range(8)}
    sites = spark.createDataFrame([(i, "one.example" if i < 5 else "two.example" if i < 7 else None) for i in range(8)], "doc_id bigint, site string")
    df = table(spark, pages)
    assert rows(spam.furniture(df)) == []
    assert rows(spam.furniture(df, sites)) == [(i, n) for i in range(5) for n in (1, 3)]
    texts = {r.doc_id: r.text for r in spam.main_texts(df, sites).collect()}
    assert texts[0] == "The bridge of a was moved to the river in the night, and nobody had seen it.\n\nIdazlea a" and texts[5].startswith("Zure")
    assert rows(spam.repeated(spam.looked_at(df, part=2), sites)) == [(i, n) for i in range(5) for n in (1, 3)]


def long_page(n):
    """Lines whose roles and counts reach over any cut: menus one per line, boxes, titles, repeated words and lines."""
    kinds = ["Home", "Fekuzu", "News", "", "Related articles", "The mill of the town", "The boat of the lake", "Most read", "1. Why the mill was closed", "2. The ferry of Baro",
             "The bridge was moved to the river in the night, and nobody had seen it.", "phone case cheap phone case best", "You are here: Home › Town › The mill of the", "Sport", None]
    pick, out = 7, []
    for _ in range(n):
        pick = (pick * 1103515245 + 12345) % (1 << 31)
        out.append(kinds[(pick >> 16) % len(kinds)])
    return out


@pytest.mark.parametrize("lines", [long_page(400), ["Related articles"] + ["The boat of the lake"] * 130 + [PAGE[7]], ["Home"] + ["Fekuzu"] * 90 + ["News", "Sport"],
                                   [PAGE[7]] + ["phone case cheap phone case buy"] * 100, ["Related articles"] + ["The boat of the lake"] * 99, [None] * 70 + [""] * 70])
def test_parts_give_the_result_of_the_whole(spark, rows, lines):
    df = table(spark, {7: lines, 8: GOOD[11]})
    columns = ["doc_id", "lang", *spam.MEASURES]
    want = spam.looked_at(df, part=10**6)
    for part in (1, 70):
        got = spam.looked_at(df, part=part)
        assert rows(got.where("lang IS NOT NULL"), *columns) == rows(want, *columns)
        open_ = lambda x: sorted((r.doc_id, o.line_no, o.key) for r in x.where("hidden IS NOT NULL").collect() for o in r.open)
        assert open_(got) == open_(want)
        hidden = lambda x: sorted((r.doc_id, n) for r in x.where("hidden IS NOT NULL").collect() for n in r.hidden)
        assert hidden(got) == hidden(want)


def test_a_page_of_ten_thousand_lines(spark):
    lines = long_page(10_000)
    got = [r.line_no for r in spam.furniture(table(spark, {7: lines, **{100 + i: GOOD[11] for i in range(10)}})).collect()]
    assert sorted(got) == sorted(layout.hidden_lines(list(enumerate(lines, 1)))) and len(got) > 3000
    stuffed = [PAGE[7], PAGE[15], GOOD[11][0]] + ["phone case cheap phone case best phone case cheap"] * 10_000
    assert [r.doc_id for r in spam.spam_pages(table(spark, {7: stuffed[3:], 8: stuffed, **{100 + i: GOOD[11] for i in range(10)}})).collect()] == [7]
