"""Pages written by hand after common layouts, with their main text; none comes from the generator that trains the model."""

PAGES = {
    "bare paragraph": ("<html><body><p>Just a paragraph of text with nothing else around it at all.</p></body></html>", "Just a paragraph of text with nothing else around it at all."),
    "plain text": ("Only a line of text, without any markup.", "Only a line of text, without any markup."),
    "home page of the nineties": (
        "<HTML><HEAD><TITLE>My page</TITLE></HEAD><BODY BGCOLOR=white><CENTER><H1>Welcome to my garden</H1></CENTER><HR><P>I have kept bees since 1987. This page is about their winter quarters.<P>In October the hives are wrapped in straw.<BR>In March the straw comes off again.</BODY></HTML>",
        "Welcome to my garden I have kept bees since 1987. This page is about their winter quarters. In October the hives are wrapped in straw. In March the straw comes off again.",
    ),
    "weblog": (
        """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Sharpening chisels - Bench Notes</title><style>body{color:#333}</style></head><body class="post-template-default single single-post">
        <div id="page" class="site"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
        <header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">Bench Notes</a></p><p class="site-description">Woodwork by hand</p></div>
        <nav id="site-navigation" class="main-navigation"><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li><li class="menu-item"><a href="/contact">Contact</a></li></ul></nav></header>
        <div id="content" class="site-content"><main id="main" class="site-main"><article id="post-12" class="post-12 post type-post hentry"><header class="entry-header"><h1 class="entry-title">Sharpening chisels</h1></header>
        <div class="entry-content"><p>A dull chisel crushes the fibres instead of cutting them, and no amount of force will make up for it.</p><h2>The stone</h2><p>I use a <a href="/stones">water stone</a> of 1000 grit, soaked for ten minutes &amp; flattened before each session.</p><ul><li>Keep the bevel flat.</li><li>Use the whole stone.</li></ul><p>Ten strokes are usually enough.</p></div></article>
        <div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><p>Great advice, thank you.</p></li><li class="comment"><p>I prefer oil stones myself.</p></li></ol>
        <div id="respond" class="comment-respond"><h3>Leave a Reply</h3><form action="/post" method="post"><p><label for="c">Comment</label><textarea id="c"></textarea></p><button type="submit">Post Comment</button></form></div></div></main></div>
        <aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/a">Planing end grain</a></li><li><a href="/b">A simple mallet</a></li></ul></section></aside>
        <footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by a press. <a href="/privacy">Privacy Policy</a></div></footer></div><script>window.x = 1;</script></body></html>""",
        "Sharpening chisels A dull chisel crushes the fibres instead of cutting them, and no amount of force will make up for it. The stone I use a water stone of 1000 grit, soaked for ten minutes & flattened before each session. Keep the bevel flat. Use the whole stone. Ten strokes are usually enough.",
    ),
    "newspaper": (
        """<html><head><title>Bridge reopens</title></head><body><div class="cookie-banner" id="consent"><p>We use cookies to improve your experience.</p><button>Accept all</button></div>
        <header class="page-header"><a href="/">The Valley Courier</a><nav><a href="/local">Local</a> <a href="/sport">Sport</a> <a href="/opinion">Opinion</a></nav></header>
        <div class="layout"><div class="article"><h1>Old bridge reopens after two years</h1>
        <div class="article-body"><p>The old bridge over the river was opened to traffic again on Monday, two years after a flood had damaged its middle pier.</p><div class="ad"><p>Advertisement</p></div><p>"We are glad to have it back," said the mayor, who walked across first. Repairs had cost four million, twice what had been planned.</p>
        <div class="related-posts"><h3>Read more</h3><ul><li><a href="/1">Flood of the century</a></li><li><a href="/2">Ferry service ends</a></li></ul></div><p>Lorries of more than twelve tonnes will still have to take the motorway until a second inspection in the spring.</p></div></div>
        <aside class="sidebar"><h3>Most read</h3><ol><li><a href="/3">Bakery closes</a></li><li><a href="/4">School wins cup</a></li></ol></aside></div>
        <form class="newsletter"><label>Sign up for our newsletter</label><input type="email"><button>Subscribe</button></form><footer><p>Copyright 2023 The Valley Courier. All rights reserved.</p></footer></body></html>""",
        'Old bridge reopens after two years The old bridge over the river was opened to traffic again on Monday, two years after a flood had damaged its middle pier. "We are glad to have it back," said the mayor, who walked across first. Repairs had cost four million, twice what had been planned. Lorries of more than twelve tonnes will still have to take the motorway until a second inspection in the spring.',
    ),
    "encyclopaedia": (
        """<html><head><title>Lapwing</title></head><body><div id="mw-navigation"><h2>Navigation menu</h2><div class="portal"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random article</a></li></ul></div><form class="search"><input name="search"><button>Search</button></form></div>
        <div id="content" class="mw-body"><h1 id="firstHeading">Lapwing</h1><div id="bodyContent"><p>The <b>lapwing</b> is a wading bird of farmland and wet meadows. It is known for its slow, irregular wingbeat and its shrill call.</p><h2>Breeding</h2><p>Three or four eggs are laid in a ground scrape. The nest and young are defended <i>noisily</i> against all intruders, up to horses and cattle.</p><table><tr><th>Wingspan</th><td>82-87 cm</td></tr><tr><th>Mass</th><td>128-330 g</td></tr></table><p>Flocks gather in large numbers outside the breeding season.</p></div></div>
        <div id="footer"><ul><li>This page was last edited in May.</li><li><a href="/p">Privacy policy</a></li></ul></div></body></html>""",
        "Lapwing The lapwing is a wading bird of farmland and wet meadows. It is known for its slow, irregular wingbeat and its shrill call. Breeding Three or four eggs are laid in a ground scrape. The nest and young are defended noisily against all intruders, up to horses and cattle. Wingspan 82-87 cm Mass 128-330 g Flocks gather in large numbers outside the breeding season.",
    ),
    "table layout": (
        """<html><body><table width="100%"><tr><td width="150" valign="top"><a href="/">Home</a><br><a href="/pics">Pictures</a><br><a href="/links">Links</a></td><td valign="top"><h1>Restoring a tube radio</h1><p>The set came from an attic and had not been switched on for forty years.</p><p>First all paper capacitors were replaced, then the mains cord.</p></td></tr></table></body></html>""",
        "Restoring a tube radio The set came from an attic and had not been switched on for forty years. First all paper capacitors were replaced, then the mains cord.",
    ),
    "manual": (
        """<!DOCTYPE html><html><head><title>Install</title></head><body><nav class="toc"><ul><li><a href="#a">Overview</a></li><li><a href="#b">Install</a></li><li><a href="#c">Configure</a></li></ul></nav><main><h1>Install the server</h1><p>Unpack the archive into a folder of your choice.</p><pre><code>tar xf server.tar
./server --port 80</code></pre><p>The server answers on port 80 unless another is given.</p></main><footer>Version 2. <a href="/edit">Edit this page</a></footer></body></html>""",
        "Install the server Unpack the archive into a folder of your choice. tar xf server.tar ./server --port 80 The server answers on port 80 unless another is given.",
    ),
    "recipe": (
        """<html><body><header><div class="logo">Kitchen Table</div></header><ul class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/soups">Soups</a></li></ul><section class="story"><h1>Leek soup</h1><p>A soup for cold evenings that is ready in half an hour.</p><h2>Ingredients</h2><ul><li>three leeks</li><li>two potatoes</li><li>a litre of broth</li></ul><h2>Method</h2><ol><li>Cut the leeks into rings and fry them gently.</li><li>Add the potatoes and the broth, and cook for twenty minutes.</li></ol></section><div class="social-share"><a href="#">Share</a> <a href="#">Tweet</a></div><div class="footer">&copy; Kitchen Table</div></body></html>""",
        "Leek soup A soup for cold evenings that is ready in half an hour. Ingredients three leeks two potatoes a litre of broth Method Cut the leeks into rings and fry them gently. Add the potatoes and the broth, and cook for twenty minutes.",
    ),
    "nothing but a menu": ("""<html><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><script>render()</script></body></html>""", ""),
    "letter": ("<html><head><title>Letter</title></head><body><div><p>Dear Anna,</p><p>thank you for the parcel, which came on Friday. The children were delighted with the kite.</p><p>Yours, Maria</p></div></body></html>", "Dear Anna, thank you for the parcel, which came on Friday. The children were delighted with the kite. Yours, Maria"),
}
