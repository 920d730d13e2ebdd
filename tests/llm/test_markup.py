import random

import pytest

from cairn.llm import boilerplate
from cairn.llm.markup import clean_markup, convert, label, min_cut

CASES = [
    ("<p>A <b>bold</b> word&nbsp;here &amp; there</p>", ["html"], "A bold word here & there"),
    ("text <span sty", ["html"], "text"),
    ("x </td></tr", ["html"], "x  |"),
    ("<h2>Title</h2><ul><li>a<li>b</ul>", ["html"], "## Title\n\n- a\n- b"),
    ("== Head ==\n[[a|b]] and [[c]]\n{{cite|x|1}}\n[[Category:d]]", ["wiki"], "## Head\nb and c"),
    ("an {{lang|xx|word}} here", ["wiki"], "an word here"),
    ("end [[cut of", ["wiki"], "end cut of"),
    ("'''bold", ["wiki"], "bold"),
    ("# Head\n\n**b** and `c` [t](/u)\n\n```\ncode *x*\n```", ["markdown"], "# Head\n\nb and c t\n\n```\ncode *x*\n```"),
    ("| a | b |\n|---|---:|\n| 1 | 2 |", ["markdown"], "a | b\n\n1 | 2"),
    ("Title here\n=====\ntext", ["markdown"], "Title here\n\ntext"),
    ("note[^3]\n\n[^3]: more", ["markdown"], "note\n\nmore"),
    ("see \\emph{this} in $x_1^2$ at 5\\%", ["latex"], "see this in $x_1^2$ at 5%"),
    ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", ["latex"], "- a\n\n- b"),
    ("\\[ \\frac{1}{n} \\]", ["latex"], "$\\frac{1}{n}$"),
    ("cut $\\frac{4", ["latex"], None),
    ("```\nx <b>y</b>\n```", ["html", "markdown"], None),
]
PLAIN = [
    "Files lay in D:\\dump\\52 on the old machine. A ticket cost $77 then and $52 later.",
    "The test holds if k < 9 and n > 72. Type map<string, double> holds 96 keys. R&D spent 8 % & more.",
    "The check is written a == b, never a = b. The product 5 * 59 * 2 is even. ~17 pages, 'so called', were lost...",
    "Scale 1:40; see note^42. Reading (see [12], [13]) differs [sic]. From x_1 to x_79 -> no change. C# and C++.",
    "In the log the field min_cosine_34 is #85 of 60. Set A = {a, b, c} has 56 members [1]. Ratio A | B | C stays.",
    "- first point\n- second point\n\n1. gather\n2. sort",
    "* a\n* b\n",
]


@pytest.mark.parametrize(("text", "kinds", "clean"), CASES)
def test_markup(text, kinds, clean):
    got = convert(text)
    assert got[1] == kinds
    if clean is not None:
        assert got[0] == clean


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert convert(text) == (text, [])


def test_min_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 1.5)) for _ in range(2 * n)]
        # terminal capacities are |odds|: content costs max(0, odds), residue max(0, -odds)
        full = lambda labels: sum(max(0, -o) if x else max(0, o) for o, x in zip(odds, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])
        least = min(full([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert full(min_cut(odds, edges)) == pytest.approx(least)


def test_weak_evidence_needs_company():
    assert convert("a \\, b")[1] == ["latex"]  # a spacing command
    assert convert("a \\_ b")[1] in ([], ["latex"])
    assert convert("{{Infobox\n| name = x\n| si")[1] == ["wiki"]
    assert convert("| name = x\n")[1] == []


def test_frame(spark):
    rows = [(1, "[[a]]", "x"), (1, "[[a]]", "x"), (None, None, "y"), (2, "", None), (3, "plain " * 50_000 + "<b>x</b>", None)]
    df = spark.createDataFrame(rows, "id bigint, body string, kinds string")
    out = clean_markup(df, ["id"], "body").collect()
    assert len(out) == 5
    got = {r["id"]: r for r in out}
    assert got[1]["clean"] == "a" and got[None]["clean"] is None and got[2]["clean"] == "" and got[3]["kinds"] == ["html"]
    assert clean_markup(df.limit(0), ["id"], "body").count() == 0


PAGE = (
    '<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/s">Subscribe</a></li><li>Log in</li></ul></nav><h1>The mill</h1>'
    "<p>The mill was rebuilt in 1809 and kept its <a href='w'>wheel</a>.</p><h2>Parts</h2><ul><li>a wheel</li><li>two stones</li></ul><pre>grind(x)</pre>"
    "<p>Area $x^2$</p><footer><p>All rights reserved.</p><div>Contact</div></footer></body></html>"
)


def test_navigation_and_footer_go():
    clean = convert(PAGE)[0]
    assert clean == "# The mill\n\nThe mill was rebuilt in 1809 and kept its wheel.\n\n## Parts\n\n- a wheel\n\n- two stones\n\n```\ngrind(x)\n```\n\nArea $x^2$"


def test_the_cut_decides_borderline_text():
    pages = [
        '<ul><li><a href="a">Rivers</a></li><li>Opening hours</li><li><a href="b">Products</a></li><li>Login</li><li><a href="c">Subscribe</a></li></ul>',
        '<div><div><a href="a">Start</a></div><div>Suche</div><div><a href="b">Kontakt</a></div></div>',
        '<ul><li><a href="a">Accueil</a></li><li>Recherche</li><li><a href="b">Contact</a></li></ul>',
        "<div><div>The river rises in the hills and flows to the sea.</div><div><a href='x'>The old stone bridge over the river at the mill</a></div><div>It was built by the guild in 1809 and is still in use.</div></div>",
    ]
    flipped = borderline = 0
    for page in pages:
        for n, residue in zip(*label(page)):
            if n.kind is None and page[n.start : n.end].strip() and abs(n.odds) < 2.4:
                borderline += 1
                flipped += residue != (n.odds > 0)
    assert borderline >= 4 and flipped > borderline / 2
    assert convert(pages[0])[0] == "" and "mill" in convert(pages[3])[0]


def test_the_fit_separates_its_sample():
    right = sum((boilerplate.log_odds(boilerplate.Block(bool(a), bool(k), [t], len(t) if link else 0)) > 0) == bool(y) for t, link, a, k, y in boilerplate.SAMPLE)
    assert right >= 0.95 * len(boilerplate.SAMPLE)


def test_long_groups_close():
    assert convert("{\\bf " + "x" * 450 + "} end")[0] == "x" * 450 + " end"
    assert convert("[^" + "n" * 90 + "]: more **bold " + "y" * 300)[1] == ["markdown"]
