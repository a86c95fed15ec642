"""Pages of layouts as sites use them, in which every word says itself whether it is main text: g words are, b words are not."""

from itertools import count

_number = count()


def g(n: int) -> str:
    return " ".join(f"g{next(_number)}" for _ in range(n))


def b(n: int) -> str:
    return " ".join(f"b{next(_number)}" for _ in range(n))


def links(n: int, tag: str = "li") -> str:
    return "".join(f"<{tag}><a href='/{k}'>{b(1 + k % 3)}</a></{tag}>" for k in range(n))


def paragraphs(*sizes: int) -> str:
    return "".join(f"<p>{g(n)}</p>" for n in sizes)


PAGES = {
    "news": f"""<body><div id="masthead"><span>{b(2)}</span></div><nav class="primary-nav"><ul>{links(7)}</ul></nav>
<main><article class="story"><h1>{g(8)}</h1><p class="byline">{g(3)}</p>{paragraphs(45, 60, 30)}<figure><img src="x"><figcaption>{g(12)}</figcaption></figure>
<div class="ad">{b(9)}</div>{paragraphs(50)}<blockquote><p>{g(25)}</p></blockquote>{paragraphs(20, 8)}</article>
<section class="comments"><h2>{b(2)}</h2><p>{b(40)}</p><p>{b(22)}</p></section></main>
<aside><h3>{b(2)}</h3><ul>{links(5)}</ul></aside><footer><p>{b(14)}</p></footer></body>""",
    "blog": f"""<body><div class="navbar"><a href="/">{b(2)}</a><a href="/about">{b(1)}</a></div><div class="sidebar"><h3>{b(2)}</h3><ul>{links(6)}</ul>
<div class="widget newsletter"><p>{b(13)}</p></div></div><div class="post"><h2>{g(6)}</h2>{paragraphs(35, 48, 27)}<ul><li>{g(9)}</li><li>{g(5)}</li></ul>{paragraphs(61)}</div>
<div id="comments"><div class="comment"><p>{b(31)}</p></div><form><input><button>{b(1)}</button></form></div><div class="footer">{b(8)}</div></body>""",
    "wiki": f"""<body><nav><ul>{links(9)}</ul></nav><main id="content"><h1>{g(2)}</h1>{paragraphs(70)}<h2 id="navigation">{g(1)}</h2>{paragraphs(44, 52)}
<section id="consent"><h2>{g(2)}</h2>{paragraphs(38)}</section><table><tr><th>{g(1)}</th><th>{g(1)}</th></tr><tr><td>{g(3)}</td><td>{g(2)}</td></tr></table>
<h2 id="comments">{g(2)}</h2>{paragraphs(29)}</main><footer>{b(20)}</footer></body>""",
    "manual": f"""<body><header><a href="/">{b(2)}</a><form role="search"><input><button>{b(1)}</button></form></header><nav aria-label="Contents"><ol>{links(12)}</ol></nav>
<main><h1>{g(4)}</h1><p>{g(18)}</p><pre><code>{g(15)}</code></pre><dl><dt>{g(1)}</dt><dd>{g(11)}</dd><dt>{g(2)}</dt><dd>{g(16)}</dd></dl><div class="notice">{g(21)}</div>
<div class="overlay-network"><p>{g(24)}</p></div></main><div class="pagination">{links(2, 'span')}</div></body>""",
    "recipe": f"""<body><div class="cookie-consent">{b(17)}<button>{b(1)}</button></div><article><h1>{g(5)}</h1><p>{g(33)}</p><ul class="ingredients"><li>{g(3)}</li><li>{g(2)}</li><li>{g(4)}</li></ul>
<div class="sponsored">{b(11)}</div><ol><li>{g(14)}</li><li>{g(19)}</li></ol><p class="cookies">{g(8)}</p><div class="share">{links(4, 'span')}</div></article><footer><ul>{links(4)}</ul></footer></body>""",
    "plain": f"<body><ul>{links(5)}</ul><div>{paragraphs(50, 42, 66, 38)}</div><div>{b(2)}</div></body>",
    "table layout": f"""<body><table><tr><td><a href="/">{b(1)}</a><br><a href="/n">{b(2)}</a><br><a href="/c">{b(1)}</a></td></tr></table>
<div class="main">{paragraphs(57, 33)}<p>{g(40)}</p></div><div class="legal copyright">{b(6)}</div></body>""",
    "history": f"""<body><nav>{links(3)}</nav><article><h1>{g(4)}</h1><div class="navy">{g(36)}</div><div class="naval-history">{g(28)}</div><p title="the hidden harbour">{g(17)}</p>
<div class="promontory">{g(9)}</div><div class="promoted-rank">{g(12)}</div><blockquote class="comment">{g(23)}</blockquote><!-->{paragraphs(14)}<!-- {b(5)} --></article></body>""",
    "hidden parts": f"""<body><article><p>{g(31)}</p><p hidden>{b(12)}</p><div aria-hidden="true">{b(6)}</div><p style="color:red; display : none">{b(9)}</p><p data-hidden="no" style="color:blue">{g(13)}</p></article></body>""",
    "forum notice": f"""<body><div role="navigation">{links(6, 'span')}</div><div role="main"><article><h1>{g(7)}</h1>{paragraphs(41, 39)}<div class="newsletter"><p>{b(16)}</p><form><input></form></div>{paragraphs(26)}
<div class="related"><ul>{links(4)}</ul></div></article></div><div role="contentinfo">{b(12)}</div></body>""",
    "shop": f"""<body><header><nav>{links(8)}</nav></header><main><h1>{g(3)}</h1><div class="description">{paragraphs(47, 22)}</div><div class="ads">{b(7)}</div></main>
<div class="popup modal"><p>{b(15)}</p></div><aside>{b(26)}</aside><footer>{links(9)}</footer></body>""",
    "letter": f"""<body><article><p>{g(2)},</p>{paragraphs(64, 5, 71)}<p>{g(1)}</p><p>{g(2)}</p></article><div class="breadcrumb">{links(3, 'span')}</div></body>""",
}
