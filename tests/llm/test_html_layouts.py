"""Main text of pages written by hand, none of them by the training pages' rules."""

from collections import Counter

import pytest

from folioframe.llm import html_crf

A = "The harbour of the old town lies in the shade of two long walls. Boats come in with the tide, and leave before the evening."
B = "Nobody knows who built the walls. A stone above the gate has a date on it, but most of its letters are gone by now."
LINKS = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'
TWO = f"<p>{A}</p><p>{B}</p>"
BOTH = f"{A} {B}"

#: Ordinary pages with two paragraphs, and the text that each must give.
PAGES = {
    "main alone": (f"<html><body><main>{TWO}</main></body></html>", BOTH),
    "main, title in head": (f"<html><head><title>Harbour</title></head><body><main>{TWO}</main></body></html>", BOTH),
    "noscript before": (f"<html><body><noscript>Please switch on scripts.</noscript><main>{TWO}</main></body></html>", BOTH),
    "header before": (f"<body><header><a href='/'>The Daily</a></header><main>{TWO}</main></body>", BOTH),
    "nav before": (f"<body><nav>{LINKS}</nav><main>{TWO}</main></body>", BOTH),
    "article alone": (f"<body><article>{TWO}</article></body>", BOTH),
    "plain divs between link bars": (f"<body><div>{LINKS}</div><div><div>{TWO}</div></div><div>{LINKS}</div></body>", BOTH),
    "form inside": (f"<body><main><p>{A}</p><form><label>Your address</label><input><button>Subscribe</button></form><p>{B}</p></main></body>", BOTH),
    "aside inside": (f"<body><main><p>{A}</p><aside><h3>Read on</h3><p>Ten more harbours</p></aside><p>{B}</p></main></body>", BOTH),
    "advert inside": (f'<body><main><p>{A}</p><div class="ad">Buy a boat today</div><p>{B}</p></main></body>', BOTH),
    "plain text": (f"{A} {B}", BOTH),
    "comments inside an article": (f'<body><article><h1>Walls</h1>{TWO}<section class="comments"><h3>Two comments</h3><div class="comment"><b>Ann</b><p>I was there as a child and liked it a lot.</p></div></section></article></body>', f"Walls {BOTH}"),
    "comment list": (f'<body><div id="main"><h1>Walls</h1>{TWO}<ol class="commentlist"><li><b>Ann</b><p>I was there as a child and liked it.</p></li><li><b>Bo</b><p>Me too.</p></li></ol></div></body>', f"Walls {BOTH}"),
    "table layout": (f"<body><table><tr><td>{LINKS}</td><td><h1>Walls</h1>{TWO}</td></tr><tr><td colspan=2>Copyright 2020 The Daily. All rights reserved.</td></tr></table></body>", f"Walls {BOTH}"),
    "aside between, with nav and footer": (f"<body><nav>{LINKS}</nav><p>{A}</p><aside><p>Ten more harbours</p></aside><p>{B}</p><footer>&copy; The Daily</footer></body>", BOTH),
    "one paragraph": (f"<body><p>{A}</p></body>", A),
    "no paragraphs": (f"<body>{A}<br><br>{B}</body>", BOTH),
}

#: Ten layouts with longer articles; marked texts are not the article's.
C = "In winter the town is quiet. The fishermen mend their nets in the market hall, and the children learn to row on the flooded meadow behind the church."
D = "Every spring a crew of volunteers clears the channel of sand. It takes them nine days, and they are paid in bread, soup and songs."
LONG = [A, B, C, D]
P = "".join(f"<p>{x}</p>" for x in LONG)
LAYOUTS = [
    (f'<html><body><div class="site"><div class="topline"><a href="/">Home</a> | <a href="/s">Search</a></div><h1>The two walls</h1>{P}<div class="related-posts"><h4>More</h4>{LINKS}</div></div></body></html>', ["The two walls", *LONG]),
    (f'<body><main role="main"><h1>The two walls</h1><p class="lead">{A}</p><figure><img src="a.png"></figure><p>{B}</p><h2>Winter</h2><p>{C}</p><p>{D}</p></main><footer><p>Made in the harbour. Contact us.</p></footer></body>', ["The two walls", A, B, "Winter", C, D]),
    (f'<body><header id="top"><div class="logo">The Daily</div><nav>{LINKS}</nav></header><section><div><h1>The two walls</h1>{P}</div></section><div class="newsletter"><p>Get our letter every week.</p><button>Sign up</button></div></body>', ["The two walls", *LONG]),
    (f'<body><div id="cookie-banner"><p>We use cookies to make this page better.</p><button>Accept</button></div><article><h1>The two walls</h1>{P}<div class="share"><a>Share</a><a>Post</a></div></article></body>', ["The two walls", *LONG]),
    (f'<body><center><h2>The two walls</h2></center><font size=3>{A}<p>{B}<p>{C}<p>{D}</font><hr><font size=1>Copyright 1999 The Daily</font></body>', ["The two walls", *LONG]),
    (f'<body><div id="wrapper"><div id="sidebar">{LINKS}<p>About this site: a page on harbours.</p></div><div id="content"><h1>The two walls</h1>{P}</div></div><div id="footer">All rights reserved. The Daily</div></body>', ["The two walls", *LONG]),
    (f'<body><article><header><h1>The two walls</h1><p class="byline">By Ann Lee, 3 May 2020</p></header>{P}</article><section id="comments"><h3>Comments</h3><div class="comment"><p>Lovely town, I go there every summer with my dog.</p></div></section></body>', ["The two walls", *LONG]),
    (f"<body><div><div><div><div><h1>The two walls</h1><div>{A}</div><div>{B}</div><div>{C}</div><div>{D}</div></div></div></div><div><a href='/a'>Next</a> <a href='/b'>Last</a></div></div></body>", ["The two walls", *LONG]),
    (f'<body><main><h1>The two walls</h1><ul><li>{A}</li><li>{B}</li></ul><blockquote><p>{C}</p></blockquote><p>{D}</p><form><input><button>Search</button></form></main></body>', ["The two walls", *LONG]),
    (f'<body><nav class="breadcrumb"><a>Home</a> &gt; <a>Towns</a></nav><div class="post"><h1>The two walls</h1><p>{A}</p><div class="advertisement">Advertisement: new boats at half the price!</div><p>{B}</p><p>{C}</p><aside class="pullquote-box"><a href="/x">Read about the bridge</a></aside><p>{D}</p></div><footer>&copy; 2021</footer></body>', ["The two walls", *LONG]),
]


@pytest.fixture(scope="module")
def chain():
    return html_crf.trained()


@pytest.mark.parametrize("name", PAGES)
def test_ordinary_pages(chain, name):
    page, want = PAGES[name]
    assert chain.main_text(page) == want


def test_layouts(chain):
    """Word precision and recall over all ten layouts, and of each by itself."""
    kept = right = wanted = 0
    for page, parts in LAYOUTS:
        got, want = Counter(chain.main_text(page).split()), Counter(" ".join(parts).split())
        both = (got & want).total()
        assert both >= 0.9 * want.total() and both >= 0.9 * got.total(), chain.main_text(page)
        kept, right, wanted = kept + got.total(), right + both, wanted + want.total()
    assert right >= 0.95 * kept and right >= 0.95 * wanted
