"""Doubtful containers, the votes of their hosts, and pages that are deep or never close."""

import resource
import time

import pytest

from loomgraph.llm import html_extract as hx

TEXT = "A paragraph of the article, with some length to it, and commas."


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<main><div class='cookie-recipes'><p>{TEXT}</p></div></main>", TEXT),
        (f"<article><p>Start.</p><section class='discussion'><h2>Discussion</h2><p>{TEXT}</p></section></article>", f"Start. Discussion {TEXT}"),
        (f"<article><p>Start.</p><div class='related-work'><p>{TEXT}</p></div></article>", f"Start. {TEXT}"),
        ("<article><p>Start.</p><ul class='share-prices'><li>Ore 12<li>Tin 9</ul></article>", "Start. Ore 12 Tin 9"),
        ("<article><p>Start.</p><div class='related-stories'><a href='x'>One story</a> <a href='y'>Another one</a></div></article>", "Start."),
        ("<article><p>Start.</p><div class='cookie-hint'><p>We use cookies.</p><button>Yes</button></div></article>", "Start."),
        (f"<article><p>Start.</p><section class='comments'><p>{TEXT}</p></section><div class='share-buttons'>Tell</div></article>", "Start."),
        (f"<article><p>Start.</p><section class='discussion'><div class='comment'><p>{TEXT}</p></div></section></article>", "Start."),
        (f"<article><p>Start.</p><div class='cookie-recipes'><div class='newsletter-signup'>Join</div><p>{TEXT}</p></div></article>", "Start."),
        (f"<article><div class='notice-period'><div class='alert-levels'><p>{TEXT}</p></div></div></article>", TEXT),
    ],
)
def test_doubtful_containers(body, want):
    assert hx.extract(hx.parse(f"<html><body><nav>menu</nav>{body}</body></html>"), []) == want


def test_hosts_judge_by_their_pages(spark):
    page = lambda i, hint: f"<body><article><p>Story {i}. {TEXT}</p><div class='cookie-facts'><p>{hint}</p></div></article></body>"
    rows = [(i, "http://same.example/", page(i, "This site stores small files.")) for i in range(9)]
    rows += [(i, "http://own.example/", page(i, f"Fact {i} about baking.")) for i in range(20, 29)]
    rows += [(40, None, page(40, "No host, so its own judgement.")), (41, "http://few.example", page(41, "One page."))]
    # One of the host's pages has a link only; the others decide.
    rows.append((29, "http://own.example/", page(29, "<a href='x'>Fact 29</a>")))
    out = {r.page_id: r.text for r in hx.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("small files" not in out[i] and out[i].startswith(f"Story {i}.") for i in range(9))
    assert all(out[i].endswith(f"Fact {i} about baking.") for i in range(20, 29)) and out[29].endswith("Fact 29")
    assert out[40].endswith("its own judgement.") and out[41].endswith("One page.")


def test_all_containers_vote():
    page = hx.parse("<body><div class='a'><p>One, two.</p></div><div class='b'><p>Three.</p></div><div class='c'><p>F</p></div><ul><li>x</ul></body>")
    found = hx.votes(page)
    assert len(found) == 5 and sum(s for _, s in found) == pytest.approx(1)


STRESS = {
    "divs": "<div>", "classes": "<div class='x1 y'>", "svg": "<svg><div>", "lists": "<ul><li>a", "words": "<div>word word word ", "stray": "<span>x</b></i>", "inline": "<b><i>x</b>",
    "paragraphs": "<p>a<div>b</p>", "tables": "<table><tr><td>a", "links": "<a>x<div>", "doubts": "<div class='cookie-facts'>z",
}


@pytest.mark.parametrize("name", [*STRESS, "svg end", "svg closed by containers", "open b"])
def test_deep_and_unclosed_pages_are_linear(name):
    n = 1_000_000
    page = {
        "svg end": "<div>" + "<svg>x" * (n // 6) + "</div></svg>", "svg closed by containers": "<div><svg></div>" * (n // 16) + "</svg>", "open b": "<b>" * (n // 12) + "<i>" * (n // 12) + "</b>" * (n // 12),
    }.get(name) or STRESS[name] * (n // len(STRESS[name]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    start = time.process_time()
    hx.extract(hx.parse(page), ["none"])
    assert time.process_time() - start < 12
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
