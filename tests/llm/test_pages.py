"""Generated pages whose main text is known."""

import random
import time

import pytest

from rulemeter.llm.html_text import main_text

R = random.Random(17)
WORDS = "river stone carries older maps than any ledger could hold and still the market opens every morning with bread, salt, copper; nobody asks".split()


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n)).capitalize() + "."


def article():
    """(markup, blocks) of a main text with a heading, short and long paragraphs, a list, a quote, a source line of links."""
    blocks, out = [sentence(5)], []
    out.append(f"<h1>{blocks[0]}</h1>")
    for _ in range(R.randint(4, 12)):
        kind = R.random()
        text = sentence(R.choice([2, 12, 40, 90]) if kind < 0.7 else 20)
        blocks.append(text)
        if kind < 0.7:
            out.append(f"<p>{text}</p>")
        elif kind < 0.8:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.9:
            out.append(f"<h2>{text}</h2>")
        else:
            first, second = text.split(" ", 1)
            out.append(f"<p><b>{first}</b> <a href=x>{second}</a></p>")
    return "".join(out), blocks


WRAPS = [
    ('<div class="page has-sidebar"><article>', "</article></div>"),
    ('<article class="post related-stories-enabled">', "</article>"),
    ('<div class="post comments-open">', "</div>"),
    ('<div class="social science">', "</div>"),
    ('<main id="content">', "</main>"),
    ("<div id=content><section>", "</section></div>"),
    ('<form id="aspnetForm"><div class=x>', "</div></form>"),
    ("<table><tr><td>", "</td></tr></table>"),
    ("<article><dialog open>note</dialog>", "</article>"),
]
MENU = "".join(f"<li><a href=/{i}>section {i}</a></li>" for i in range(9))
BEFORE = f'<header><h2>The Daily</h2></header><nav><ul>{MENU}</ul></nav><div class="cookie-notice">We use cookies to make this site work, and ask that you agree.</div>'
AFTER = f"""<aside><h3>Elsewhere</h3><p>{sentence(30)}</p></aside><div class="sidebar-left"><p>{sentence(25)}</p></div><div class="ad-slot">{sentence(12)}</div>
<form><label>Search</label><input><button>Go</button></form><section id="comments"><p>{sentence(40)}</p><p>{sentence(30)}</p></section><footer>All rights. {sentence(8)}</footer><script>var a = "<p>no</p>";</script>"""


@pytest.mark.parametrize("wrap", WRAPS, ids=lambda w: w[0])
def test_main_text_is_found_whole(wrap):
    right = found = wanted = 0
    for _ in range(30):
        markup, blocks = article()
        got = main_text(f"<html><head><title>t</title></head><body>{BEFORE}{wrap[0]}{markup}{wrap[1]}{AFTER}</body></html>").split("\n\n")
        right += sum(b in got for b in blocks)
        found += len(got)
        wanted += len(blocks)
    assert right / wanted >= 0.98 and right / found >= (0.85 if "dialog" in wrap[0] else 0.98)


def test_lead_and_all_sections_are_kept():
    lead, a, b = sentence(20), sentence(170), sentence(70)
    html = f"<body>{BEFORE}<div id=content><h1>Head</h1><p>{lead}</p><div><p>{a}</p></div><div><p>{b}</p></div></div>{AFTER}</body>"
    assert main_text(html).split("\n\n") == ["Head", lead, a, b]
    html = f"<body>{BEFORE}<div id=content><h1>Head</h1><p>{lead}</p><div><p>{a}</p><p>{a}</p></div></div>{AFTER}</body>"
    assert main_text(html).split("\n\n") == ["Head", lead, a, a]


def test_comments_longer_than_the_article_go():
    text = sentence(60)
    html = f'<body>{BEFORE}<article><h1>Head</h1><p>{text}</p></article><div id="comments">{"".join(f"<article class=comment><p>{sentence(80)}</p></article>" for _ in range(9))}</div></body>'
    assert main_text(html).split("\n\n") == ["Head", text]


def test_a_teaser_article_does_not_win():
    text = [sentence(60) for _ in range(6)]
    html = f"<body><div class=story>{''.join(f'<p>{t}</p>' for t in text)}</div><div><article><p>{sentence(90)}</p></article></div></body>"
    assert main_text(html).split("\n\n")[:6] == text


def test_boilerplate_alone_is_no_text():
    assert main_text(f"<body>{BEFORE}<article></article>{AFTER}</body>") == ""
    assert main_text("<nav><a href=x>one</a></nav><footer>two</footer>") == ""


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "deep", "<b>" + "</i></p></div>" * 50_000 + "text", "<p>" + "word " * 400_000, "<b><div>" + "<i>" * 40_000 + "x" + "</b>" * 40_000])
def test_broken_and_long_pages_take_linear_time(html):
    start = time.time()
    assert main_text(html)
    assert time.time() - start < 10
