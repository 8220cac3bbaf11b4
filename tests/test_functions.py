"""Row-level functions on hand-written cases."""

import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagelake.functions import html as H, prices as P, text as T, urls as U


def test_clean_text(column):
    assert column([None, "", " a  b\x1c\n c ", "x"], T.clean_text) == ["", "", "a b c", "x"]


def test_decode_entities(column):
    cases = {"a&amp;lt;": "a&lt;", "&#8364;&#x20AC;": "€€", "&nope; & x": "&nope; & x", "&#0;&#99999999;": "&#0;&#99999999;",
             "&laquo;&nbsp;&raquo;": "« »", "plain": "plain"}
    assert column(list(cases), T.decode_entities) == list(cases.values())
    assert column([None], T.decode_entities) == [None]


def test_emails_match_plain_regex(column):
    plain = re.compile(rf"{T.EMAIL_LOCAL}+@{T.EMAIL_DOMAIN}")
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab.@-_ c@x.org") for _ in range(60)) for _ in range(200)] + ["A@b.COM a@b.com.x@y.org"]
    expected = [list(dict.fromkeys(m.lower() for m in plain.findall(t))) for t in texts]
    assert column(texts, T.extract_emails) == expected


def test_phones(column):
    plain = re.compile(T.PHONE.removeprefix("(?U)"))
    texts = ["call 8 (800) 333-59-98, 1234567", "123456", "32277460012345", "8\u00a0800\u00a0333-59-98", "+7(495) 215-12-88 12"]
    expected = [list(dict.fromkeys(" ".join(p.split()) for p in plain.findall(t) if 7 <= sum(c.isdigit() for c in p) <= 12)) for t in texts]
    assert column([*texts, None], T.extract_phones) == [*expected, []]


def test_prices(column):
    cases = {"12 990 ₽ x": ("12 990 ₽", "RUB"), "100 РУБ.": ("100 РУБ.", "RUB"), "$5.00": ("$5.00", "USD"),
             "5 тг": ("5 тг", ""), "¥ 7": ("¥ 7", ""), "free": ("", ""), "7 uah": ("7 uah", "")}
    assert [tuple(r) for r in column(list(cases), P.price_and_currency)] == list(cases.values())


def test_normalize_url(column):
    cases = {"http://a.b/#x": "http://a.b", "http://a.b": "http://a.b", "http://a.b/?q=/": "http://a.b/?q=",
             "http://a.b/c/#d": "http://a.b/c/"}
    assert column(list(cases), U.normalize_url) == list(cases.values())


def test_resolve_url_matches_stdlib(column):
    base = "http://a.org/b/c/d;p?q"
    refs = ["g", "./g", "g/", "/g", "//h.org/p", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..",
            "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "http://x.org/../y",
            "mailto:a@b.c", "g;x=1/../y", "g?y/./x"]
    assert column(refs, lambda c: U.resolve_url(F.lit(base), c)) == [urljoin(base, r) for r in refs]
    assert column(["x"], lambda c: U.resolve_url(F.lit("http://a.org"), c)) == ["http://a.org/x"]


def test_followable_prefix_rule(column):
    urls = ["http://a.org/cartoon", "http://a.org/x", "http://b.org/x", "http://a.org/f.PDF?x", "http://a.org:8080/x"]
    assert column(urls, lambda c: U.is_followable(c, F.lit("a.org"))) == [False, True, False, False, False]


def test_social_substring_and_host(column):
    url = ["https://netflix.com/t"]
    assert [r.type for r in column(url, U.classify_social)[0]] == ["social:X"]
    assert column(url, lambda c: U.classify_social(c, "host")) == [[]]


def test_attributes(column):
    tags = ['<a class="x y" HREF=\'u"v\'>', '<a data-href="q" href=abc>', "<a href>", '<a title="b href=1" href="2">',
            "<a title='>' href=\"&amp;\">", '<A HREF="">', "<img src=1>"]
    assert column(tags, lambda c: H.attr(c, "href")) == ['u"v', "abc", "", "2", "&", "", None]


def test_title_and_heading(column):
    pages = ["<title>a &amp; b</title><h1>x <i>y</i></h1>", "<title>a<b>c</b></title>", "<!-- <h1>no</h1> --><H1>yes</H1>", None]
    assert column(pages, lambda c: H.page_title(H.visible_html(c))) == ["a & b", "", "", ""]
    assert column(pages, lambda c: H.first_heading(H.visible_html(c))) == ["x y", "", "yes", ""]


def test_main_content(column):
    words = "word " * 30
    pages = [
        f"<nav>n<nav>q</nav>x</nav><div class='a content b'>{words}<div>in</div>t</div>after",
        "<main>short</main><p>a<b>b</b> c",
        f"<main>short</main><article>{words}</article>tail",
        f"<noscript>{words}</noscript><script>no</script><style>no</style>",
        "", None,
    ]
    assert column(pages, H.main_content) == [
        f"{words}in t", "short a b c", words.strip(), words.strip(), "", ""]


def test_needs_render(column):
    text = "plain words " * 30
    pages = ["", None, "<p>thin</p>", f"<div data-reactroot>{text}</div>", f"<p>{text}</p>",
             f"<p>{text}</p><div class='product-list'> </div>", f"<p>{text}</p><div class='product-list'>{text}</div>"]
    assert column(pages, H.needs_render) == [True, True, True, True, False, True, False]


def test_strip_site_suffix(column):
    titles = ["A - x.org", "A – x.org ", "A x.org", "x.org", " - x.org", None]
    assert column(titles, lambda c: T.strip_site_suffix(c, F.lit("x.org"))) == ["A", "A", "A x.org", "x.org", "", ""]


def test_heading_fallbacks(column):
    titles = ["Shop - About", "", " – x"]
    got = column(titles, lambda c: T.page_heading(c, F.lit("H"), F.lit("u"), F.lit("site"), markdown=True))
    assert got == ["Shop - About", "H", "– x"]


def test_chunks_cover_whole_text(column):
    text = "".join(chr(97 + i % 26) for i in range(60_001))
    chunks = column([text, ""], T.chunk_text)
    assert "".join(c.chunk for c in chunks[0]) == text and chunks[1] == []
    assert sum(len(c.chunk) for c in chunks[0] if c.within) == 27_000


def test_menu_tail_against_nested_pattern(column):
    """The word fold equals the backtracking pattern on short random texts."""
    nested = re.compile(r'(\s+[А-ЯA-ZЁ№][а-яa-zА-ЯA-ZЁ\s«»"№\d]{1,30}){4,}\s*$')
    rnd = random.Random(7)
    words = ["Foo", "bar", "A", "x1", "Long" + "e" * 30, "Мир", "end.", "№5", "Aa", "q" * 12]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    expected = [len(m.group()) if (m := nested.search(t)) else 0 for t in texts]
    assert column(texts, T._menu_tail_length) == expected


def test_clean_page_text_rules(column):
    cases = {
        "Shop Главная — Каталог Текст один": "Текст один",
        "Текст. Условия оплаты Возврат": "Текст.",
        "Итог Показать еще 1 2": "Итог", "a 1 2 3": "a",
        "Подробнее Подробнее Подробнее ok": "ok",
    }
    got = [x.strip() for x in column(list(cases), T.clean_page_text)]
    assert got == list(cases.values())


def test_strip_text_looks_at_the_ends_only(spark, column):
    spaces = [chr(c) for c in range(0x3100) if re.match(f"[{T.SPACE}]", chr(c))]
    assert column([f"{s}a{s}b{s}" for s in spaces] + [None, "".join(spaces)], T.strip_text) == [f"a{s}b" for s in spaces] + [None, ""]
    assert "regexp" not in spark.range(1).select(T.strip_text(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()


def test_tail_rules_of_texts_that_end_otherwise(column):
    cases = {"a Возврат Наверх": "a", "a Возврат Наверх b.": "a Возврат Наверх b.", "x. 1 2 3 4": "x.", "x. 1 2 3 4 y": "x. 1 2 3 4 y",
             "a. Показать еще 1 2 3": "a."}
    assert column(list(cases), T.clean_page_text) == list(cases.values())
