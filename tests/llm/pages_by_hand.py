"""Sixty pages written and labelled by hand: thirty layouts without telling names, each with two articles.

None of them trains the model. ``ARTICLE`` stands for an article's elements; all other text is off.
"""

ARTICLES = [
    (
        "<h1>The mill on the upper Lea</h1><p>The mill was built in 1782 by two brothers, and it ground rye for six villages.</p><p>A flood took the wheel in 1866. The owner, short of money, put in a <a href='/t'>turbine</a> instead.</p><h2>What is left</h2><p>Only the lower floor still stands; the stones lie in the yard.</p>",
        ["The mill on the upper Lea", "The mill was built in 1782 by two brothers, and it ground rye for six villages.", "A flood took the wheel in 1866. The owner, short of money, put in a turbine instead.", "What is left", "Only the lower floor still stands; the stones lie in the yard."],
    ),
    (
        "<h2>Mending a leaking tap</h2><p>Turn the water off first.</p><ol><li>Take off the cap and undo the screw below it.</li><li>Lift out the washer, which is nearly always the culprit.</li></ol><blockquote>Cheap washers last a year, good ones ten.</blockquote><p>Put everything back in reverse order, and open the water slowly so that the pipes don't knock.</p>",
        ["Mending a leaking tap", "Turn the water off first.", "Take off the cap and undo the screw below it.", "Lift out the washer, which is nearly always the culprit.", "Cheap washers last a year, good ones ten.", "Put everything back in reverse order, and open the water slowly so that the pipes don't knock."],
    ),
]

NAV = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/shop'>Shop</a></li></ul>"
LINE = "<a href='/'>Home</a> | <a href='/a'>Archive</a> | <a href='/i'>Imprint</a>"
NEWS = "<h3>Latest</h3><ul><li><a href='/1'>Harvest fair opens on Friday</a></li><li><a href='/2'>Road to the quarry closed</a></li></ul>"

LAYOUTS = [
    f"<body><nav>{NAV}</nav><div class='wrap'>ARTICLE</div><footer>Copyright 2023 by the society</footer></body>",
    f"<body><div>{NAV}</div><div>ARTICLE</div></body>",
    f"<body><nav>{LINE}</nav><section>ARTICLE</section></body>",
    "<body><div class='container'><div class='row'><div class='col-md-8'>ARTICLE</div></div></div></body>",
    f"<body><table width=100%><tr><td>{NAV}</td><td>ARTICLE</td></tr></table></body>",
    f"<body><div id='single'>ARTICLE</div><div>{LINE}</div></body>",
    f"<body><div class='nav'>{NAV}</div>ARTICLE</body>",
    f"<body><div class='nav'>{LINE}</div><div><div><div>ARTICLE</div></div></div><p><small>&copy; 2021 Upper Lea Trust</small></p></body>",
    f"<body><header><p>The Village Paper</p></header><div class='grid'><div class='col'>ARTICLE</div><aside>{NEWS}</aside></div></body>",
    f"<body><div id='page'><header>{NAV}</header><div id='inner'>ARTICLE</div><footer><p>All rights reserved.</p></footer></div></body>",
    f"<body><center><p>{LINE}</p></center>ARTICLE<hr><center>{LINE}</center></body>",
    f"<body><div class='outer'><div class='left'>{NAV}</div><div class='right'>ARTICLE</div></div></body>",
    "<body><main>ARTICLE</main><footer><p>Printed on recycled paper. Write to us at any time.</p></footer></body>",
    f"<body><main><div class='box'>ARTICLE</div><div class='box'>{NEWS}</div></main></body>",
    f"<body><button>Menu<div class='layout'>ARTICLE</div><footer>{LINE}</footer></body>",
    "<body><form action=/s><label>Find</label><input name=q><button>Go</button></form><div class='holder'>ARTICLE</div></body>",
    f"<body><section><nav>{NAV}</nav></section><section>ARTICLE</section><section><h3>Elsewhere</h3>{NAV}</section></body>",
    "<body><div class='cookie-bar'><p>We use cookies. Carry on if that is fine with you.</p><button>Fine</button></div><div class='app'><div>ARTICLE</div></div></body>",
    f"<body><table><tr><td colspan=2>{LINE}</td></tr><tr><td>{NAV}</td><td><div>ARTICLE</div></td></tr></table></body>",
    "<body><div class='t-123'>ARTICLE</div><div class='comments'><p>I walked there last summer, it was lovely.</p><p>Thank you for this, very useful indeed.</p></div></body>",
    f"<body><nav>{NAV}</nav><div class='x1 y2'><div class='x3'>ARTICLE<div class='ad'>Boots at half price, this week only!</div></div></div></body>",
    f"<body><div role='navigation'>{LINE}</div><div role='main'>ARTICLE</div><div role='contentinfo' class='bottom'>Made by hand in the valley</div></body>",
    f"<body><div class='hero'><img src=a.jpg></div><div class='block'>ARTICLE</div><div class='widget'>{NEWS}</div></body>",
    "<body><div class='container'><svg><title>Logo</title><text>LOGO</text></svg><div class='columns'><div class='column'>ARTICLE</div></div></div><footer>Call us on 555 0100</footer></body>",
    "<body><div><section><div><section>ARTICLE</section></div></section></div><noscript>Please turn on scripts.</noscript></body>",
    f"<body><div class='more-content'>ARTICLE</div><div class='related'>{NEWS}</div></body>",
    f"<body><ul class='menu'><li><a href='/a'>About</a></li><li><a href='/b'>Visit</a></li></ul><div class='sheet'>ARTICLE</div><address>Upper Lea 4, 2nd floor</address></body>",
    f"<body><div class='site'><div class='topbar'>{LINE}</div><div class='mid'><div class='a'>ARTICLE</div><div class='b sidebar'>{NEWS}<p>Subscribe to our letter, it comes out monthly.</p></div></div></div></body>",
    f"<body><div><p>{LINE}</p></div><div><center>ARTICLE</center></div></body>",
    "<body><div class='frame'><header class='masthead'><h2>Lea Valley Times</h2><p>News since 1911</p></header><div class='paper'>ARTICLE</div><form><p>Join our list</p><input name=mail></form></div></body>",
]

PAGES = [(k, layout.replace("ARTICLE", html), main) for k, layout in enumerate(LAYOUTS) for html, main in ARTICLES]
