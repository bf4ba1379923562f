"""Labelled pages, from which the extraction of main text learns its weights. Fixed values.

``{n}`` stands for n words of filler. Text under ``data-main`` is main text, text under ``data-main=no`` is not, and
neither is the rest. The attribute is a label only; the extraction never looks at it elsewhere.
"""

PAGES = (
    # A news page with an article element.
    '<body><header class="site-header masthead"><a href="/">{2}</a><p>{5}</p></header><nav class="navbar menu"><ul><li><a href="/a">{1}</a></li><li><a href="/b">{1}</a></li>'
    '<li><a href="/c">{2}</a></li></ul></nav><div class="ad advert">{9}</div><article data-main><header class="article-header"><h1>{8}</h1></header><p>{40}</p><p>{35} <a href="/d">{3}</a> {20}</p>'
    '<aside class="pullquote sponsored" data-main=no><p>{12}</p></aside><h2>{4}</h2><p>{60}</p><ul><li>{8}</li><li>{9}</li></ul><blockquote><p>{20}</p></blockquote>'
    '<div class="ad adslot" data-main=no>{8}</div><form class="newsletter signup" data-main=no><p>{9}</p><label>{2}</label><button>{1}</button></form><p>{30}</p>'
    '<footer class="article-footer tags" data-main=no>{6}</footer></article><section class="comments" id="comments"><h3>{1}</h3><div class="comment"><p>{25}</p></div>'
    '<div class="comment reply"><p>{14}</p></div></section><aside class="sidebar"><h3>{2}</h3><p>{15}</p></aside><footer class="footer"><p>{12}</p></footer></body>',
    # A blog without any.
    '<body class="has-sidebar"><div id="header" class="header"><h2><a href="/">{3}</a></h2><p>{7}</p></div><div class="notice cookie-notice cookie consent banner"><p>{18}</p><button>{1}</button></div>'
    '<div class="wrapper page layout"><div class="content post entry" data-main><h1>{6}</h1><p>{50}</p><p>{2}</p><h3>{4}</h3><p>{45} <a href="/x">{2}</a></p><pre>{30}</pre><p>{55}</p>'
    '<div class="share social" data-main=no><a href="/s">{1}</a><a href="/t">{1}</a></div></div><div class="sidebar widget widgets" id="sidebar"><h3>{2}</h3><ul><li><a href="/y">{4}</a></li>'
    '<li><a href="/z">{5}</a></li></ul><p>{16}</p></div></div><div id="disqus_thread" class="commentlist responses respond discussion"><p>{30}</p><p>{22}</p></div>'
    '<div class="footer copyright legal" id="footer"><p>{14}</p></div></body>',
    # A reference page in a main element, with a table, definitions and a breadcrumb.
    '<body><a class="skip" href="#m">{3}</a><div class="topbar toolbar login account">{4}</div><div class="breadcrumb breadcrumbs"><a href="/">{1}</a> <a href="/q">{2}</a></div><main class="main" data-main>'
    '<h1>{5}</h1><p>{30}</p><table><tr><th>{1}</th><th>{2}</th></tr><tr><td>{3}</td><td>{9}</td></tr></table><dl><dt>{2}</dt><dd>{12}</dd></dl><ol><li>{9}</li><li>{14}</li></ol>'
    '<figure><img src="i"><figcaption>{9}</figcaption></figure><p>{40}</p><div class="related recommended recommendations" data-main=no><h4>{2}</h4><ul><li><a href="/r">{6}</a></li></ul></div></main>'
    '<div class="pagination pager"><a href="/2">{1}</a></div><div class="promo promotion banner sponsor"><p>{12}</p></div><footer><small>{10}</small><ul><li><a href="/u">{1}</a></li></ul></footer></body>',
    # Plain markup with no names at all: paragraphs between linked lists.
    '<body><table><tr><td><a href="/1">{1}</a></td><td><a href="/2">{1}</a></td><td><a href="/3">{2}</a></td></tr></table><ul><li><a href="/4">{2}</a></li><li><a href="/5">{2}</a></li></ul>'
    '<div data-main><h1>{5}</h1><p>{40}</p><p>{30} <b>{2}</b> {10}</p><p>{3}</p><p>{45}</p><div>{25}</div></div><div><a href="/6">{3}</a> <a href="/7">{3}</a> <a href="/8">{2}</a></div><hr><div><small>{5}</small></div></body>',
    # Comments that are articles, a search form, an alert, a modal.
    '<body><div role="banner">{4}</div><div role="navigation" class="mainmenu submenu"><a href="/k">{1}</a></div><form class="search searchform" role="search"><input><button>{1}</button></form>'
    '<div class="alert notification" role="alert"><p>{14}</p></div><div class="article story main" role="main" data-main><h2>{7}</h2><p>{44}</p><p>{38}</p><p>{7}</p>'
    '<div class="advertisement ads" data-main=no><p>{11}</p></div><p>{33}</p></div><section id="reviews" class="comments-area"><article class="comment"><p>{28}</p></article>'
    '<article class="comment"><p>{17}</p></article></section><div role="complementary" class="rail"><p>{20}</p></div><div class="modal popup overlay subscribe subscription paywall"><p>{12}</p></div>'
    '<div role="contentinfo">{9}</div></body>',
    '<body class="no-sidebar"><nav>{6}</nav><header>{5}</header><div class="main-content with-sidebar container" data-main><p>{48}</p><p>{20}</p><nav class="toc" data-main=no><a href="#a">{2}</a></nav><p>{50}</p></div>'
    '<div class="tracking sitemap links"><a href="/w">{2}</a></div><aside>{10}</aside><form><p>{6}</p></form><footer>{8}</footer></body>',
    # A page of a publishing system, whose wrappers have names that elsewhere name parts; words outside the article have no names.
    '<body class="home single"><div id="page" class="site hfeed"><div><p>{7} <a href="/1">{2}</a></p><h1>{3}</h1><ul><li>{2}</li><li><a href="/2">{2}</a></li></ul>{6}</div>'
    '<div class="site-content content-area"><div id="primary" class="primary"><article class="post hentry" data-main><h1>{6}</h1><p>{60}</p>'
    '<div>{40}</div><h3>{3}</h3><p><a href="/3">{12}</a></p><ul><li><a href="/4">{5}</a></li><li>{9}</li></ul><p>{30}</p></article></div></div><div><h3>{2}</h3><p>{9}</p>'
    '<table><tr><td>{3}</td></tr></table><div>{8} <a href="/5">{2}</a></div><span>{4}</span></div></div></body>',
    # Headings between unnamed divisions.
    '<body><div><div><a href="/1">{1}</a> <a href="/2">{1}</a></div><div>{4}</div></div><div data-main><h1>{6}</h1><div>{60}</div><h2>{3}</h2><div>{50}</div><ul><li>{8}</li><li>{6}</li></ul>'
    '<table><tr><td>{9}</td><td>{9}</td></tr></table><p>{20}</p></div><div><div>{4}</div><div><a href="/3">{2}</a> <a href="/4">{2}</a></div></div></body>',
)
