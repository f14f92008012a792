"""Main text of pages whose marks and shapes contradict each other, and odd tables."""

import pytest
from reportlens.llm import html_text

PARA = " ".join(["word"] * 60)
FOUR = "".join(f"<p>{PARA}</p>" for _ in range(4))
FULL = "\n".join([PARA] * 4)

KEPT = {
    "a state of the body": f"<body class='no-sidebar'>{FOUR}",
    "a state of a wrapper": f"<div class='has-sidebar'><article>{FOUR}</article></div>",
    "comments may be open": f"<body class='single comments-open'><main>{FOUR}</main>",
    "an advert without an end tag": f"<p class='ad'>Buy{''.join('<p>' + PARA for _ in range(4))}",
    "an unclosed drawing": f"<svg>{FOUR}",
    "long text in a named element": f"<div class='widget'>{FOUR}</div>",
    "a body that names itself": f"<body class='ad'>{FOUR}",
    "a page inside a form": f"<form id=f><main>{FOUR}</main></form>",
    "main text inside a named wrapper": f"<div class='sidebar'><main>{FOUR}</main></div>",
    "reader comments as articles": f"<article>{FOUR}</article><div class='comments'><article>{FOUR}</article></div>",
    "a named paragraph in an article": f"<article>{FOUR}<p class='ad'>Buy now</p></article>",
    "a role": f"<div role='main'>{FOUR}</div><div role='navigation'>{FOUR}</div>",
    "no marks": f"<div>{FOUR}</div>",
    "hidden text": f"<div hidden>{FOUR}</div><main>{FOUR}</main>",
    "a teaser in an aside": f"<main>{FOUR}</main><aside><p>{PARA}</p></aside><footer>{PARA}</footer>",
}


@pytest.mark.parametrize("name", KEPT)
def test_main_text_stays_and_the_rest_goes(name):
    assert html_text.main_texts([KEPT[name]], html_text.train()) == [FULL]


def test_other_shapes():
    tree = html_text.train()
    read = lambda page: html_text.main_texts([page], tree)[0]
    assert read(f"<article>a short teaser</article><div>{FOUR}</div>") == "a short teaser\n" + FULL
    assert read(f'<p title="x>hello</p>{FOUR}') == "hello\n" + FULL
    assert read(f"<article>{FOUR}<p><a href=x>{PARA}</a></p></article>") == FULL + "\n" + PARA
    assert read(f"<ul><li class='promo'>Buy<li>{PARA}<li>{PARA}</ul>") == PARA + "\n" + PARA
    for tag in ("nav", "aside", "footer", "dialog"):
        assert read(f"<{tag}>{FOUR}</{tag}>") == ""
    assert read(f"<main>{FOUR}<div class='comments'><p>{PARA}</p></div></main>") == FULL
    assert read("<script>var a = 1;") == "" and read("<style>p{}") == "" and read("<!-- open " + FOUR) == ""


def test_odd_pages(spark):
    rows = [(1, "u", f"<main>{FOUR}</main>", "x"), (1, "u", f"<main>{FOUR}</main>", "x"), (None, None, None, None), (2, "", "", ""),
            (3, "v", "<main>" + "<p>some words that are long enough to stay</p>" * 20_000 + "</main>", "t"), (4, "w", "<" * 5000, "t"), (5, "w", "&amp;&#65;&nope; " * 30, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 1] == [FULL] * 2
    assert [r["text"].count("\n") for r in got if r["page_id"] == 3] == [19_999]
    assert [r["text"] for r in got if r["page_id"] is None] == [""]
    assert html_text.extract(pages.where("false")).count() == 0
