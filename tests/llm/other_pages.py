"""Pages written by hand in layouts unlike those of the tables: (html, the main text's blocks)."""

PAGES = [
    (  # a blog of nested divisions, no article element
        """<html><head><title>Bread at home | Crumb diary</title></head><body><div id="wrap"><div id="head"><a href="/">Crumb diary</a><span>notes from a small kitchen</span></div>
<div id="topmenu"><a href="/a">About</a> | <a href="/r">Recipes</a> | <a href="/c">Contact</a></div>
<div id="content"><div class="post"><h2 class="post-title">Bread at home</h2><div class="post-meta">Posted on 3 May by Ana in <a href="/x">Baking</a></div>
<div class="post-body"><p>A good loaf needs four things: flour, water, salt and a great deal of patience.</p><p>Mix the flour and the water first, and leave them alone for an hour. Then add the salt.</p>
<h3>Baking</h3><p>Heat the oven as far as it goes. A heavy pot with a lid keeps the steam in, which gives the crust its shine.</p><ul><li>Forty minutes with the lid on.</li><li>Fifteen minutes without it.</li></ul></div>
<div class="share">Share: <a href="#">Mail</a> <a href="#">Print</a></div></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><b>Jo</b><p>I tried this on Sunday and it worked very well, thank you.</p></div><div class="comment"><b>Lee</b><p>How much salt do you use?</p></div></div></div>
<div id="sidebar"><h4>Archive</h4><ul><li><a href="/1">May</a></li><li><a href="/2">April</a></li></ul><h4>Newsletter</h4><form><input name="m"><button>Sign up</button></form></div>
<div id="footer">&copy; 2020 Crumb diary. All rights reserved.</div></div></body></html>""",
        ["Bread at home", "A good loaf needs four things: flour, water, salt and a great deal of patience.", "Mix the flour and the water first, and leave them alone for an hour. Then add the salt.", "Baking",
         "Heat the oven as far as it goes. A heavy pot with a lid keeps the steam in, which gives the crust its shine.", "Forty minutes with the lid on.", "Fifteen minutes without it."],
    ),
    (  # an old page laid out by a table
        """<html><body bgcolor=white><table width=100%><tr><td colspan=2><font size=5>County Railway Society</font></td></tr><tr><td class=menu width=150 valign=top><a href=index.htm>Home</a><br><a href=hist.htm>History</a><br><a href=links.htm>Links</a></td>
<td class=content valign=top><h1>The Marsh Line</h1><p>The line was opened in 1871 to carry clay from the pits to the harbour, a distance of nine miles.<p>Passengers were carried from 1880. There were two trains a day, and on Sundays none at all.
<p>It was closed after the flood of 1953; the bridge at Low Ferry can still be seen.</td></tr><tr><td colspan=2 class=footer><font size=1>Last updated 4 March 1999. <a href=mailto:x@y.example>Mail the webmaster</a></font></td></tr></table></body></html>""",
        ["The Marsh Line", "The line was opened in 1871 to carry clay from the pits to the harbour, a distance of nine miles.", "Passengers were carried from 1880. There were two trains a day, and on Sundays none at all.",
         "It was closed after the flood of 1953; the bridge at Low Ferry can still be seen."],
    ),
    (  # documentation
        """<!doctype html><html><head><title>Queues</title></head><body><header class="site-header"><a class="logo" href="/">toolkit</a><nav class="navbar"><a href="/docs">Docs</a><a href="/api">API</a><a href="/blog">Blog</a></nav></header>
<div class="layout"><aside class="toc"><ul><li><a href="#a">Making a queue</a></li><li><a href="#b">Taking from it</a></li></ul></aside><main role="main"><h1>Queues</h1><p>A queue holds messages until a worker takes them. Messages are taken in the order in which they came.</p>
<h2 id="a">Making a queue</h2><p>Call <code>make_queue</code> with a name. The name must not be in use.</p><pre>q = make_queue("mail", size=100)</pre><h2 id="b">Taking from it</h2><p>A worker that takes a message has a minute to finish it; after that another may have it.</p></main></div>
<footer class="site-footer"><p>Made by the toolkit team.</p><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul></footer></body></html>""",
        ["Queues", "A queue holds messages until a worker takes them. Messages are taken in the order in which they came.", "Making a queue", "Call make_queue with a name. The name must not be in use.", 'q = make_queue("mail", size=100)',
         "Taking from it", "A worker that takes a message has a minute to finish it; after that another may have it."],
    ),
    (  # news, with a notice, adverts and related stories inside the story
        """<html><head><title>Harbour to be dredged - The Coast Post</title><script type="application/ld+json">{"a":"<p>no</p>"}</script></head><body><div class="cookie-banner" role="dialog"><p>We and our partners use cookies.</p><button>Accept</button></div>
<header><div class="masthead"><a href="/">The Coast Post</a></div><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></nav></header>
<main><article class="story"><h1>Harbour to be dredged next spring</h1><p class="byline">By <a href="/k">K. Holm</a></p><p>The council voted on Tuesday to dredge the harbour, after two ferries ran aground within a month.</p><div class="ad-slot">Advertisement</div>
<p>&ldquo;We could not wait any longer,&rdquo; said the harbour master, who has asked for the work since 2015.</p><blockquote>Every ship that cannot come here goes elsewhere.</blockquote><aside class="related"><h4>Related stories</h4><ul><li><a href="/1">Ferry aground again</a></li><li><a href="/2">New crane arrives</a></li></ul></aside>
<p>The work will cost two million and take until the summer.</p></article><section class="reader-comments"><h2>Comments</h2><ol><li><p>About time too, if you ask me.</p></li></ol></section></main><footer><p>&copy; The Coast Post</p></footer></body></html>""",
        ["Harbour to be dredged next spring", "The council voted on Tuesday to dredge the harbour, after two ferries ran aground within a month.", "“We could not wait any longer,” said the harbour master, who has asked for the work since 2015.",
         "Every ship that cannot come here goes elsewhere.", "The work will cost two million and take until the summer."],
    ),
    (  # an encyclopedia's page with a table
        """<html><body><div id="mw-page"><div class="noprint" id="siteNotice"><p>Please give to our yearly appeal.</p></div><h1 class="firstHeading">Lake Arn</h1><div id="bodyContent"><p><b>Lake Arn</b> is a lake in the north of the province. It is the third largest in the country.</p>
<h2>Geography</h2><p>The lake lies 412 metres above the sea. Four rivers run into it, of which the Sel is the longest.</p><table><tr><th>Area</th><td>61 square kilometres</td></tr><tr><th>Depth</th><td>118 metres</td></tr></table><h2>History</h2><p>The first villages on its shore are thought to be four thousand years old.</p></div></div>
<div id="navigation" role="navigation"><h3>Navigation</h3><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li></ul></div><div id="foot"><ul id="footer-info"><li>This page was last edited on 1 June.</li></ul></div></body></html>""",
        ["Lake Arn", "Lake Arn is a lake in the north of the province. It is the third largest in the country.", "Geography", "The lake lies 412 metres above the sea. Four rivers run into it, of which the Sel is the longest.", "Area",
         "61 square kilometres", "Depth", "118 metres", "History", "The first villages on its shore are thought to be four thousand years old."],
    ),
    (  # hardly any markup
        """<html><head><title>x</title></head><body><h1>Notes on a walk</h1>We set out before seven, when the fog still lay on the river, and met nobody until the mill.<br><br>The mill is a ruin now. <p>From there the path climbs for an hour.</p><hr><a href="/">back to the index</a></body></html>""",
        ["Notes on a walk", "We set out before seven, when the fog still lay on the river, and met nobody until the mill. The mill is a ruin now.", "From there the path climbs for an hour."],
    ),
    (  # a shop
        """<html><body><div class="topbar"><a href="/login">Log in</a> <a href="/basket">Basket (0)</a></div><div class="nav-main"><ul><li><a href="/l">Lamps</a></li><li><a href="/c">Chairs</a></li></ul></div><div class="product main"><h1>Reading lamp Vera</h1><div class="description"><p>Vera is a lamp for people who read late. Its arm reaches across a bed, and its light falls on the page alone.</p>
<p>The shade is made of linen; the foot is cast iron, so that the lamp stands firmly.</p></div></div><div class="recommendations"><h3>Others also bought</h3><div class="card"><a href="/1">Chair Ida</a></div><div class="card"><a href="/2">Lamp Otto</a></div></div><div class="newsletter"><p>Ten per cent off your first order when you sign up.</p><form><input><button>Send</button></form></div>
<div class="footer-links"><a href="/t">Terms</a> <a href="/i">Imprint</a></div></body></html>""",
        ["Reading lamp Vera", "Vera is a lamp for people who read late. Its arm reaches across a bed, and its light falls on the page alone.", "The shade is made of linen; the foot is cast iron, so that the lamp stands firmly."],
    ),
]
