"""Short pages whose main-text blocks carry ``data-main``: the labelled table that the block classifier is fitted on."""

_LONG = "The river rose again in the night and by morning the lower fields were under water, as they had been in most springs that anyone could remember. "
_SHORT = "It rained."
_LINKS = "<li><a href='/a'>Home</a></li><li><a href='/b'>News from the valley</a></li><li><a href='/c'>About us and our work</a></li>"


def _p(text: str, main: bool = True) -> str:
    return f"<p{' data-main' if main else ''}>{text}</p>"


_ARTICLE = f"<h1 data-main>High water</h1>{_p(_LONG)}{_p(_SHORT)}{_p(_LONG * 3)}{_p('Yes.')}{_p('See <a href=x>the map of the fields</a> for more.')}{_p(_LONG * 2)}"

PAGES = [
    # article element, short and long paragraphs, boxes around it
    f"<nav><ul>{_LINKS}</ul></nav><div class=ad>{_LONG}</div><article>{_ARTICLE}</article><footer>{_LONG}</footer>",
    f"<nav><ul>{_LINKS}</ul></nav><div class=ad>{_SHORT}</div><article><h1 data-main>Rain</h1>{_p(_SHORT)}</article><footer>{_SHORT}</footer>",
    f"<header><h1>The Valley Post</h1>{_p(_LONG, False)}</header><main>{_ARTICLE}<aside>{_p(_LONG * 2, False)}</aside></main><form>{_p(_LONG, False)}</form>",
    f"<article><header><h1 data-main>Rain</h1></header>{_p(_LONG)}<div class=related><h2>More</h2><ul>{_LINKS}</ul></div>{_p('No.')}</article><section id=comments><article>{_p(_LONG, False)}</article></section>",
    f"<article>{_p('Yes.')}<div class=ad>{_LONG * 2}</div>{_p('No.')}{_p(_SHORT)}<ul><li data-main>one field</li><li data-main>two fields and a barn</li></ul></article>",
    f"<article>{_p('<a href=x>All of this paragraph is a link to the map</a>')}{_p(_LONG)}{_p('<a href=y>Source</a>')}{_p(_SHORT)}</article><aside>{_p(_SHORT, False)}</aside>",
    # no article element: long blocks and what stands between them; links and odd words around
    f"<div>Log in</div><div><a href=a>Home</a> <a href=b>News</a></div><div><div><h1 data-main>High water</h1></div>{_p(_LONG * 2)}{_p(_SHORT)}{_p(_LONG * 3)}</div><div><a href=p>Privacy and terms</a></div><div>All rights reserved</div>",
    f"<table><tr><td><a href=a>Home</a></td></tr><tr><td data-main>{_LONG * 3}</td></tr><tr><td data-main>{_LONG}</td></tr></table><div>Page 1</div>",
    f"<div>Follow us</div><div><a href=a>Home</a></div>{_p(_LONG)}{_p(_LONG * 2)}{_p('And so it went.')}{_p(_LONG)}<div><a href=b>Next page</a></div><div>Contact</div>",
    f"{_p(_LONG)}{_p(_LONG)}<div class=cookie-notice>{_p(_LONG * 2, False)}</div><div class=sidebar>{_p(_LONG, False)}</div><div id=footer>{_p(_SHORT, False)}</div>",
    f"<div role=banner>{_p(_LONG, False)}</div><div><h2 data-main>Rain</h2>{_p(_LONG)}</div><div class='social share'>{_p('Tell a friend', False)}</div><div><a href=c>Imprint of the valley post</a></div>",
]
