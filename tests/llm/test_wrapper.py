import itertools
import random

import pytest

from specweave.llm import markup, wrapper

SCHEMA = "page_id long, url string, html string, host string, slot int, kept string"


@pytest.fixture
def texts(spark):
    def made(rows, raw=False):
        df = wrapper.main_text(spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(4))
        got = df.collect()
        assert all(r.n_chars == len(r.text) for r in got)
        return sorted((r.page_id, r.url, r.text) for r in got) if raw else {r.page_id: r.text for r in got}

    return made


def words(rng, n):
    return " ".join(f"{rng.choice('bcdfg')}{rng.randint(0, 10**6)}" for _ in range(n))


def blocks(page):
    shape, found = markup.shaped(markup.parsed(page))
    marks = markup.regions(shape)
    return [b.text for b in found if marks[b.slot][0] != "t"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("a &lt;b&gt; &amp;c &copy; &#228;&#x20AC; &amp &unknown;", ["a <b> &c © ä€ & &unknown;"]),
        ("<p>one<p>two  \n three<br>four</p>five", ["one", "two three four", "five"]),
        ("<p><b>bold<br><p>next</b> on", ["bold", "next on"]),
        ("x<script>var t='</p>';</script>y<style>p{}</style>z<!-- <p>no --> !", ["xyz !"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("2 < 3 <4 and <> </> <p title='a>b' class=x y=\"<p>\">in</p>", ["2 < 3 <4 and <>", "in"]),
        ("<p>a<button>press<div>deep</div></button>b</p><p hidden>h</p><div style='display: none'>n</div>", ["a b"]),
        ("<head><title>t</title><p>body starts", ["body starts"]),
        ("<div><p>a<script>never closed <p>b", ["a"]),
        ("<p>a<b", ["a"]),
        ("<nav>m</nav><div class='siteSidebar'>s</div><div role=navigation>n</div><article class=comment>r</article><p id=ad-1>x", []),
        ("<body class='has-sidebar'><div class='content-with-sidebar'><main>m</main></div>", ["m"]),
        ("<article><header><h1>T</h1></header><p>a</p><aside>s</aside><footer>f</footer></article><header>h</header>", ["T", "a"]),
        ("&nbsp;<p>&nbsp; a&nbsp;b</p>", ["a b"]),
        ("", []),
        ("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after", ["deep", "after"]),
        ("</p></div><p>odd</i></table></p>end", ["odd", "end"]),
    ],
)
def test_reading(page, want):
    assert blocks(page) == want


def best_match(a, b):
    """Weight of the best match of two trees by trying all orders of children."""
    if a[0] != b[0]:
        return 0
    best = 0
    for n in range(min(len(a[3]), len(b[3])) + 1):
        for left in itertools.combinations(a[3], n):
            for right in itertools.combinations(b[3], n):
                weights = [best_match(x, y) for x, y in zip(left, right)]
                if all(weights):
                    best = max(best, sum(weights))
    return 1 + (a[1] == b[1]) + best


def test_alignment_against_all_matches():
    rng = random.Random(1)

    def tree(depth):
        return [rng.choice("ab"), rng.choice("xy"), "", [tree(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)]]

    for _ in range(300):
        a, b = tree(2), tree(2)
        a[0] = b[0] = "r"
        align = markup.Alignment(b)
        places = align.places(a)
        assert align._weight(a, b) == best_match(a, b)
        inside = [p for p in places if p >= 0]
        assert len(places) == markup._sized(a) and len(set(inside)) == len(inside)
    same = tree(3)
    assert markup.Alignment(same).places(same) == list(range(markup._sized(same)))


def test_long_lists_of_children_are_matched_by_rank():
    one = [["p", str(k), "", []] for k in range(600)]
    a, b = ["r", "", "", one], ["r", "", "", [["q", "", "", []], *one]]
    assert markup.Alignment(b).places(a) == [0, *range(2, 602)]


def test_long_lists_of_children_are_matched_like_short_ones(monkeypatch):
    rng = random.Random(4)

    def tree(depth, width):
        return [rng.choice("ab"), rng.choice("xy"), "", [tree(depth - 1, 3) for _ in range(rng.randint(0, width) if depth else 0)]]

    cases = [(tree(3, 3), tree(3, 3)) for _ in range(200)] + [(tree(2, 60), tree(2, 60)) for _ in range(20)]
    for a, b in cases:
        a[0] = b[0] = "r"
        short = markup.Alignment(b)
        want, weight = short.places(a), short._weight(a, b)
        monkeypatch.setattr(markup, "MOST_CELLS", 0)
        monkeypatch.setattr(markup, "MOST_KEPT", 3)
        monkeypatch.setattr(markup, "SHORT", rng.choice([0, 20]))
        align = markup.Alignment(b)
        assert (align.places(a), align._weight(a, b)) == (want, weight)
        monkeypatch.undo()


def test_long_lists_of_children_keep_their_order():
    """What moved to the front has no place there: the best match goes on without it."""
    one = [["p", str(k), "", []] for k in range(600)]
    same = [["div", "", "", [["p", "x", "", []]]], ["div", "", "", [["ul", "y", "", []]]]]
    a, b = ["r", "", "", [["p", "599", "", []], *one[:599], *same]], ["r", "", "", [*one, *same[1:]]]
    got = markup.Alignment(b).places(a)
    # after the 599 equal ones the moved one's place stays free, and of both divs the one with the same list below is met
    assert got[1] < 0 and got[2:601] == list(range(1, 600))
    assert got[601] < 0 and got[602] < 0 and got[603:] == [601, 602]


def plain_host(rng, host, n, first=0):
    """Pages without telling markup: what is constant or goes round is template, optional blocks come and go."""
    rows, want = [], {}
    tips = [words(rng, 6) for _ in range(3)]
    for k in range(first, first + n):
        paragraphs = [words(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        extra = f"<div class=z><blockquote>{words(rng, 5)}</blockquote></div>" if rng.random() < 0.3 else ""
        page = (
            "<div id=top><div>Home</div><div>Latest &amp; best</div></div>"
            + ("<div class=q><em>On sale today</em></div>" if k % 3 else "")
            + f"<div class=t{k}><h2>title {k}</h2><p>Share this page</p>{body}{extra}<p>Thanks for reading</p></div>"
            + f"<div class=tip><span>{rng.choice(tips)}</span></div><ul><li><a href=/{k}>next {words(rng, 3)}</a><li><a>more {k}</a></ul>"
            + "<div>All rights reserved</div>"
        )
        rows.append((k, f"https://{host}/{k}", page))
        quote = [extra.split(">")[2].split("<")[0]] if extra else []
        want[k] = "\n".join([f"title {k}", *paragraphs, *quote])
    return rows, want


def test_template_is_learned_from_pages_of_a_host(texts):
    rng = random.Random(2)
    rows, want = plain_host(rng, "a.example", 60)
    more, others = plain_host(rng, "B.example:80", 200, 100)
    got = texts(rows + more)
    assert got == want | others


def test_copies_say_nothing_of_a_template(texts):
    page = "<div><h1>Title</h1><p>some text of its own</p><p>more</p></div>"
    rows = [(k, "http://c.example/x", page) for k in range(50)]
    rows += [(100 + k, f"http://d.example/{k}", f"<p>only {k}</p>") for k in range(2)]
    got = texts(rows)
    assert {got[k] for k in range(50)} == {"Title\nsome text of its own\nmore"}
    assert (got[100], got[101]) == ("only 0", "only 1")


def test_articles_keep_what_goes_round(texts):
    rng = random.Random(3)
    said = [words(rng, 8) for _ in range(3)]
    rows, want = [], {}
    for k in range(90):
        own, link = words(rng, 6), words(rng, 3)
        article = f"<h1>{own}</h1><p>{said[k % 3]}</p><p><a href=x>{link}</a></p>"
        rows.append((k, "http://e.example", f"<div>{k} views</div><article>{article}</article>"))
        want[k] = f"{own}\n{said[k % 3]}\n{link}"
    assert texts(rows) == want


def test_odd_rows(texts):
    long_text = "<p>" + "word &amp; " * 100_000
    rows = [(1, "http://f.example", None), (2, None, "<p>no host"), (None, "no url", "<p>no id"), (3, "http://f.example", "")]
    rows += [(4, "http://f.example", "<p>twice")] * 2 + [(5, "http://g.example", long_text)] + [(None, None, None)]
    known = [r for r in rows if r[0] is not None]
    assert sorted(texts(known, raw=True), key=str) == sorted(
        [
            (1, "http://f.example", ""),
            (2, None, "no host"),
            (3, "http://f.example", ""),
            (4, "http://f.example", "twice"),
            (4, "http://f.example", "twice"),
            (5, "http://g.example", ("word & " * 100_000).strip()),
        ],
        key=str,
    )
    assert texts([r for r in rows if r[0] is None][:1]) == {None: "no id"}
    assert texts([(None, None, None)]) == {None: ""}
    assert texts([]) == {}
