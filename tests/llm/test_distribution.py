"""Line-block distribution: what windows, surges and dives decide on pages with, without and with several article elements."""

from veriscope.llm import html

PROSE = ["A first paragraph that tells what happened in some detail.", "Short one.", "Then a longer paragraph of the report, with names, places and a number of reasons.", "The end of it, told at some length too."]
LINKS = "".join(f"<div><a href='/{k}'>Linked headline number {k}</a></div>" for k in range(6))
BODY = "".join(f"<p>{p}</p>" for p in PROSE)


def test_windows_decide_inside_an_article():
    page = f"<article><h1>A title of the report</h1>{BODY}{LINKS}</article>"
    wanted = "\n".join(["A title of the report", *PROSE])
    assert html.main_text(page) == wanted  # untagged links after the last dive
    assert html.main_text(f"<article>{LINKS}<h1>A title of the report</h1>{BODY}</article>") == wanted
    assert html.main_text(f"<article><h1>A title of the report</h1>{BODY}{LINKS}<p>And after the links the report goes on for a while.</p></article>") == wanted + "\nAnd after the links the report goes on for a while."
    # without the distribution (one window over everything) the links stay
    assert "Linked headline" in html.main_text(f"<article>{BODY}{LINKS}<p>And after the links the report goes on for a while.</p></article>", window=1000)


def test_linked_and_short_lines_amid_text_stay():
    page = f"<article><p>{PROSE[0]}</p><p><a href='/x'>All of this line is a link</a></p><p>No.</p><p>{PROSE[2]}</p></article>"
    assert html.main_text(page) == "\n".join([PROSE[0], "All of this line is a link", "No.", PROSE[2]])
    assert html.main_text("<article><p>No.</p></article>") == "No." and html.main_text("<article><a href='/'>Only a link</a></article>") == "Only a link"


def test_furniture_inside_an_article_splits_but_loses_nothing():
    aside = "<aside>" + "<p>Advert line</p>" * 5 + "</aside>"
    page = f"<article><p>{PROSE[0]}</p>{aside}<p>{PROSE[2]}</p><div class='comments'><p>Nice!</p><p>Bad!</p><p>So so!</p></div><p>{PROSE[3]}</p></article>"
    assert html.main_text(page) == "\n".join([PROSE[0], PROSE[2], PROSE[3]])


def test_pages_without_article_and_untagged_furniture():
    menu = "<div>" + "".join(f"<div><a href='/{k}'>Menu {k}</a></div>" for k in range(8)) + "</div>"
    foot = "<div>" + "".join(f"<div><a href='/f{k}'>About us {k}</a></div>" for k in range(4)) + "</div>"
    page = f"<body>{menu}<div><h1>A title of the report</h1>{BODY}</div>{foot}</body>"
    assert html.main_text(page) == "\n".join(["A title of the report", *PROSE])
    two = f"<body>{menu}<div>{BODY}</div>{LINKS}<div>{BODY}</div>{foot}</body>"
    assert html.main_text(two) == "\n".join([*PROSE, *PROSE])


def test_several_articles():
    page = f"<div>Noise outside</div><article>{BODY}</article><div>More noise</div><article><p>{PROSE[0]}</p></article><main><p>{PROSE[3]}</p></main>"
    assert html.main_text(page) == "\n".join([*PROSE, PROSE[0], PROSE[3]])
