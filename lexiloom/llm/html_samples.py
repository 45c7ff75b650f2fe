"""Hand-labelled pages from which the block classifier's small table is made.

Kinds of pages as they are met on the web, with invented words. A block whose text
begins with ``+`` belongs to the main text; all others are menus, notices, adverts,
forms, comments and the like.
"""

SAMPLES = (
    # semantic elements, title in the article's own header, comments as nested articles
    """<html><head><title>Harbour news</title></head><body><header><h1>The Harbour Paper</h1><p>Founded long ago</p></header>
<nav><ul><li><a href=/>Home</a></li><li><a href=/w>Weather today</a></li><li><a href=/s>Ships</a></li></ul></nav>
<main><article><header><h1>+ New quay opens</h1><p>+ By a staff writer</p></header><p>+ The quay on the eastern side was opened on Monday by the mayor and the harbour master.</p>
<p>+ It cost more than planned.</p><p>+ <a href=/quay>Drawings of the quay and its cranes</a></p><h2>+ What comes next</h2><ul><li>+ Two cranes</li><li>+ <a href=/rail>A railway siding</a></li></ul><p>+ Done.</p>
<footer>Filed under harbour, quay</footer><section id="comments"><h2>Comments</h2><article><p>Great to see that the quay is open after all these years of waiting.</p></article><article><p>Too dear.</p></article></section></article></main>
<aside><h2>Most read</h2><p>A fisherman found a bottle with a letter that was written ninety years ago.</p></aside><footer><p>All rights reserved by the paper and its owners</p></footer></body></html>""",
    # marked divisions around an article element
    """<body class="has-sidebar"><div class="site-header"><a href=/>Garden Almanac</a></div><div class="content-sidebar-wrap"><article class="post"><h1>+ Pruning roses</h1><p>+ Roses are cut back when the frost is over and the buds begin to swell.</p>
<p>+ Use a sharp knife.</p><p class="share-price">+ A good knife costs about forty crowns in the shops of the town.</p><div class="share-buttons"><a href=#>Tweet</a> <a href=#>Mail</a></div>
<blockquote>+ Cut to an eye that looks outward.</blockquote><p>+ Burn what you cut.</p><div class="ad">Buy our roses at half the price until the end of the month</div><p>+ Then wait for the summer.</p></article>
<div class="sidebar"><p>About the almanac: it has come out every spring since the old queen reigned.</p><ul><li><a href=/1>Tulips</a></li><li><a href=/2>Dahlias</a></li></ul></div></div>
<div class="comment-list"><article class="comment"><p>My roses died when I did that, so beware of late frost in the hills.</p></article></div><div class="site-footer">Printed on the island</div></body>""",
    # a form around the whole page, without semantic elements
    """<body><form id="aspnetForm" action="/page.aspx"><div class="topmenu"><a href=/>Start</a> <a href=/a>Offices</a> <a href=/b>Staff and rooms</a></div><div><h1>+ Opening hours of the archive</h1><p>+ The archive is open on weekdays from nine until four, and on the first Saturday of the month.</p>
<p>+ Bring a pencil.</p><p>+ Readers who want to see maps should write two weeks before they come, so that the maps can be fetched from the store.</p></div><div><a href=/imprint>Imprint</a> | <a href=/privacy>Privacy</a></div></form></body>""",
    # only divisions without classes
    """<body><div><a href=/>Home</a></div><div><a href=/n>News</a></div><div><a href=/c>Contact us</a></div><div>You are here</div><div><h1>+ The ferry timetable changes</h1></div>
<div>+ From the first of May the ferry leaves the southern pier every forty minutes instead of every hour, and the last boat goes at eleven.</div><div>+ Tickets stay the same.</div><div>+ The company says that two more boats were bought in the north and that their crews have been trained over the winter months.</div>
<div>+ It hopes for a good summer.</div><div>+ More than a million people took the ferry last year, which was the most since the bridge was closed for repairs.</div><div><a href=/1>Bridge stays closed</a></div><div><a href=/2>Pier to be painted</a></div><div>Latest</div><div><a href=/3>Boat race on Sunday</a></div><div>Copyright by the port office</div></body>""",
    # a table layout
    """<body><table><tr><td><a href=/>Index</a></td><td><a href=/up>Up one level</a></td><td><a href=/next>Next page</a></td></tr></table><table><tr><td><a href=/i>Introduction</a><br><a href=/ii>Second part</a></td><td><h2>+ Part one: the mill</h2><p>+ The mill stood by the river and ground the corn of three villages, whose people came with their carts in the autumn.</p>
<p>+ It burnt down twice.</p><table><tr><th>+ Year</th><th>+ Sacks</th></tr><tr><td>+ 1801</td><td>+ 220</td></tr><tr><td>+ 1802</td><td>+ 340</td></tr></table><p>+ After the second fire the miller left, and his sons built a saw mill farther up the river, of which only the wheel is left today.</p></td></tr></table><hr><a href=/>Index</a> <a href=/next>Next page</a></body>""",
    # one short paragraph and nothing else
    "<body><p>+ Nothing here yet.</p></body>",
    "<html><head><title>Gone</title></head><body><h1>+ Moved</h1><p>+ This page has moved to the new server.</p></body></html>",
    # class names for the content, a cookie notice, a newsletter form, related links
    """<body><div class="cookie-banner"><p>We use cookies so that the pages work better for you and for all the others who come here.</p><button>Fine</button></div><div id="masthead"><span>Kitchen Notes</span></div><div class="breadcrumbs"><a href=/>Home</a> &gt; <a href=/soups>Soups</a></div>
<div class="entry-content"><h1>+ Onion soup</h1><p>+ Cut a pound of onions and let them go brown in butter, slowly, for three quarters of an hour.</p><ul><li>+ onions</li><li>+ butter</li><li>+ <a href=/broth>broth</a></li></ul><p>+ Add the broth.</p><p>+ Season with salt, pepper and a leaf of bay; let it boil once and serve it with bread and cheese.</p>
<div class="related-posts"><h3>You may like</h3><a href=/leek>Leek soup</a><a href=/pea>Pea soup with bacon</a></div></div><form class="newsletter"><p>Get a recipe every week straight into your mailbox, free of charge.</p><input name=m></form><div class="footer-links"><a href=/a>About</a> <a href=/b>Write to us</a></div></body>""",
    # a manual: headings, code, definition lists; menus at the side as plain lists
    """<body><ul><li><a href=#1>Install</a></li><li><a href=#2>Run</a></li><li><a href=#3>Remove the package</a></li></ul><h1>+ Manual of the clock program</h1><p>+ The program shows the time in the corner of the screen and rings when an hour is full.</p><pre>+ clock --start</pre><h2>+ Options</h2><dl><dt>+ -q</dt><dd>+ be quiet</dd><dt>+ -z ZONE</dt><dd>+ show the time of another zone, named by its largest town</dd></dl>
<p>+ See also <a href=/cal>the calendar program</a> for dates.</p><p>+ Errors are written to the system's log and nowhere else, so look there first.</p><p><a href=/prev>Previous</a> <a href=/next>Next</a></p></body>""",
    # a forum thread: the first post is the text, replies are comments
    """<body><div class="toolbar"><a href=/login>Log in</a></div><main><h1>+ How do I mend a kettle?</h1><div class="post-body"><p>+ The spout of my kettle came off when it fell from the stove, and solder does not hold on it.</p><p>+ Any ideas?</p></div><div class="replies"><p>Use silver solder and a lot of flux, then file it smooth and test it with cold water.</p><p>Buy a new one.</p></div></main></body>""",
    # long comments and long notices, a short article
    """<body><nav><a href=/>All notes</a></nav><div class="notice"><p>This service will be down for repairs on the night from Saturday to Sunday, and orders that come in meanwhile are handled on Monday by our staff.</p></div><article><h2>+ Lost: one glove</h2><p>+ Grey, left hand.</p></article><section class="comments"><p>I saw a grey glove on the bench by the pond on Tuesday, but somebody had taken it when I came back in the evening with my dog.</p><p>It was blue, I think, and it lay under the bench rather than on it, so perhaps there are two gloves about.</p></section></body>""",
    # divisions: link lists with words about them, text between text
    """<body><div>Read also</div><ul><li><a href=/1>Storm over the bay</a></li><li><a href=/2>Harvest was good</a></li></ul><div><h2>+ The lighthouse keeper</h2>+ He has kept the light for thirty years and has seen every ship that came in and went out, as he says himself.</div><div>+ His dog is called Anchor.</div><div>+ When the light was made electric, he was asked to go, but he stayed on as a guide for the guests who climb the tower in summer.</div><div>Tags: <a href=/t>tower</a>, <a href=/d>dog</a></div><div><a href=/all>All stories</a></div></body>""",
    # a list of teasers as articles
    """<body><header><a href=/>Hill Radio</a></header><main><article><h2>+ <a href=/1>Snow on the pass</a></h2><p>+ The pass is closed until further notice.</p></article><article><h2>+ <a href=/2>Choir on tour</a></h2><p>+ Forty singers leave on Friday.</p></article></main><aside class="promo"><p>Listen to us on your telephone with our new program.</p></aside></body>""",
    # menus and footers of plain divisions with text between the links
    """<body><div><a href=/>Town</a> - <a href=/map>Map</a> - <a href=/jobs>Jobs</a></div><h1>+ Market days</h1><p>+ The market is held on the square before the town hall every Wednesday and Saturday from seven in the morning, except on holidays.</p><p>+ Dogs must stay outside.</p><p>+ Stalls are let by the year; those who want one should ask in room twelve before the end of January, and bring their papers.</p><div>Phone 12 34</div><div><a href=/imp>Imprint</a> <a href=/data>Data protection</a> <a href=/top>Back to the top</a></div></body>""",
    # an article with paragraphs of all sizes and kinds
    """<body><nav><ul><li><a href=/>Front page</a><li><a href=/b>Back page</a></ul></nav><article><h1>+ A walk in seven parts</h1><p>+ First.<p>+ Second.<p>+ It rained.<p>+ <a href=/m>Map</a><p>+ We started before dawn, when the road was still empty and the dogs of the village slept, and went down to the river by the path that the monks had laid.<p>+ <a href=/p>Pictures of the path</a> <a href=/q>and of the river</a><p>+ The bridge was gone.<p>+ <b>We swam.</b><p>+ Fifth.<p>+ On the other side there was a house with smoke over the roof; an old man stood in the door, who did not ask where we came from but gave us soup and bread, and would not take money for it, as he had not seen guests since the spring.<p>+ Sixth.<ul><li>+ bread</li><li>+ <a href=/s>soup</a></li><li>+ <a href=/t>tea</a></li></ul><p>+ <a href=/e>The end</a></article><footer>Walks and paths, printed by the club</footer></body>""",
    # an article between adverts, short and long
    """<body><div class="ad">Boots for any weather, now with free delivery to all towns on the coast</div><article><p>+ Yes.</p></article><div class="ad">Boots</div><footer>Owned by nobody</footer></body>""",
    """<body><div class="advert-box">Tea</div><main><p>+ <a href=/x>All of it</a></p><p>+ No</p><table><tr><td>+ <a href=/y>one</a></td><td>+ <a href=/z>two</a></td></tr></table></main><div id="footer">Sold by weight in the shop by the gate, which opens at eight and closes when the tea is gone.</div></body>""",
    # words between links that belong to the text, in divisions
    """<body><div><a href=/>Library</a> <a href=/new>New books</a> <a href=/old>Old books</a></div><div>+ The story of salt is told in this book by a man who worked in the mines himself, as his father had done.</div><div>+ A <a href=/m>map of the mines</a> is added.</div><div>+ It is well made.</div><div>+ Whoever wants to know how white gold came over the mountains should read it, the more so as there is no other book about these roads.</div><div>Shelf <a href=/9>nine</a></div><div><a href=/p>Previous</a></div><div><a href=/n>Next</a></div><div>Open daily</div></body>""",
    # a page of one form with menus in it, text in paragraphs
    """<body><form action=/x><div><a href=/>Office of Weights</a></div><ul><li><a href=/1>Scales</a></li><li><a href=/2>Measures of length</a></li></ul><h2>+ Testing of scales</h2><p>+ Scales that are used in shops are tested every two years by an officer of this house, who comes without notice and brings his own weights.</p><p>+ The test is free.</p><p>+ A scale that fails gets a red seal and may not be used until it was mended by a maker whom the office knows.</p><p><a href=/top>To the top of the page</a></p></form></body>""",
    # forms in a page: not its text
    """<body><h1>+ Sailing school</h1><p>+ We teach sailing on the lake from April to October, in groups of at most six, and with boats of our own.</p><p>+ No child is too small.</p><p>+ The course takes a week and ends with a test on the water, after which you may hire our boats for the rest of the summer at half the price.</p><form action=/book><p>Your name and the week in which you want to come</p><input name=n><p>Send</p></form><form><label>Search the pages of the school</label></form></body>""",
    # articles that are lists of links
    """<body><article><a href=/0>+ Songs of the north</a><ul><li><a href=/1>+ The ship</a><li><a href=/2>+ The wind</a><li><a href=/3>+ The long night</a><li><a href=/4>+ Harvest</a><li><a href=/5>+ The miller's three daughters</a><li><a href=/6>+ Snow</a><li><a href=/7>+ The bell</a><li><a href=/8>+ Over the hills</a></ul><a href=/9>+ More songs</a></article><nav><a href=/>All books</a></nav></body>""",
    """<body><nav><a href=/>Wiki</a></nav><main><h1>+ Rivers</h1><p>+ <a href=/a>Alder</a>, <a href=/b>Birch water</a> and <a href=/c>Clay brook</a></p><table><tr><th>+ <a href=/n>Name</a></th><th>+ <a href=/l>Length</a></th></tr><tr><td>+ <a href=/a>Alder</a></td><td>+ 12</td></tr><tr><td>+ <a href=/b>Birch water</a></td><td>+ 9</td></tr></table><h2>+ <a href=/s>Sources</a></h2><ol><li>+ <a href=/s1>Survey of the valley</a></li><li>+ <a href=/s2>Maps of the mills</a></li></ol></main><footer><a href=/>Wiki</a></footer></body>""",
    # forms within articles
    """<body><article><h1>+ Bread at home</h1><p>+ Mix flour, water and salt, and let the dough stand overnight in a cool place.</p><form action=/vote><p>Do you bake?</p><label>Yes, every week</label><label>No</label></form><p>+ Bake it hot.</p><p>+ The crust gets thin if a bowl of water stands in the oven.</p></article><footer>Baker's book</footer></body>""",
    """<body><main><p>+ The museum shows looms from four centuries, most of them in working order.</p><p>+ Guided tours are held daily.</p><form><p>Send me the museum's letter once a month</p><p>Mail</p></form></main></body>""",
    # articles whose text stands between links, with nothing behind them
    """<body><article><p>+ <a href=/a>All letters</a></p><p>+ Dear reader,</p><p>+ <a href=/b>Your last letter</a></p><p>+ reached me in the mountains.</p><p>+ <a href=/c>The photographs</a></p><p>+ came too.</p><p>+ <a href=/d>Mine</a></p><p>+ Yours</p></article></body>""",
    """<body><article><h2>+ <a href=/1>Number one</a></h2><p>+ Sold.</p><h2>+ <a href=/2>Number two, the small house by the lake</a></h2><p>+ Free.</p><h2>+ <a href=/3>Number three</a></h2><p>+ To be let from the spring.</p></article></body>""",
    """<body><main><ul><li>+ <a href=/i>Introduction</a></li><li>+ <a href=/n>Names of the stars</a></li><li>+ <a href=/p>Paths of the planets</a></li></ul><p>+ Read them in this order.</p></main></body>""",
)
