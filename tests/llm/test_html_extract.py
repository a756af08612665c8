import itertools
import time

import numpy as np
import pytest

from textharbor.llm import crf, html_extract
from textharbor.llm.dom_blocks import Contexts, blocks_of
from textharbor.llm.labelled_pages import labelled_page


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.learn(html_extract.made_pages(spark))


def texts(page):
    return [b.text for b in blocks_of(page, Contexts())]


def names(page, text):
    return set(next(b.features for b in blocks_of(page, Contexts()) if b.text == text))


@pytest.mark.parametrize("page, wanted", [
    ("", []),
    ("plain", ["plain"]),
    ("<p>a<p>b", ["a", "b"]),
    ("<p>a b\n\tc&nbsp;&amp;&lt;d&gt; &eacute;</p>", ["a b c &<d> é"]),
    ("<p>o<b>n</b>e<br>two</p>", ["one two"]),
    ("<title>t</title><p>a</p><script>if (a<b) '<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><p>b", ["a", "b"]),
    ("<head><title>t</title><meta x><p>a", ["a"]),
    ("<p>a</div></p></p>b</section>", ["a", "b"]),
    ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<h2>a</h3>b", ["a", "b"]),
    ("a < b > c <3", ["a < b > c <3"]),
    ("<p title='>'>a</p><p x=\">\">b", ["a", "b"]),
    ("<p>a</p><a href='x", ["a"]),
    ("<p>a<!-- never closed <p>b", ["a"]),
    ("<script>never closed <p>b", []),
    ("<p>cut &am", ["cut &am"]),
    ("<p>a<textarea>b</textarea><svg><text>c</text></svg>d", ["ad"]),
    ("<P CLASS=x>A</P><BR>", ["A"]),
])
def test_blocks(page, wanted):
    assert texts(page) == wanted


def test_features_follow_the_ancestors():
    page = '<body><div class="siteSide-bar x" role=main><ul><li><a href=/>far</a></ul></div><article><p>near</article>'
    assert {"in=div", "in=li", "c=site", "c=side", "c=bar", "c=role-main", "near=x", "leaf=li", "part=body", "linked=3"} <= names(page, "far")
    assert {"in=article", "part=article", "leaf=p", "linked=0"} <= names(page, "near")
    assert not {"c=site", "in=ul", "in=div"} & names(page, "near")


@pytest.mark.parametrize("unit", ["<", "<a ", "<a '", "<p><b>", "<div>", "</p>", "<!--", "<a href=\"", "&amp;", "<li>", "x "])
def test_time_is_linear(unit):
    began = time.process_time()
    blocks_of(unit * (1 << 18), Contexts())
    assert time.process_time() - began < 10


def chain_score(scores, moves, starts, labels):
    total = starts[labels[0]] + sum(s for s, y in zip(scores, labels) if y)
    return total + sum(moves[a][b] for a, b in zip(labels, labels[1:]))


def test_viterbi_finds_the_best_of_all_sequences():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        scores, moves, starts = rng.normal(size=n).tolist(), rng.normal(size=(2, 2)).tolist(), rng.normal(size=2).tolist()
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: chain_score(scores, moves, starts, y))
        assert crf.viterbi(scores, moves, starts) == list(best)
    assert crf.viterbi([], [[0, 0], [0, 0]], [0, 0]) == []


def test_likelihood_and_gradient():
    """The likelihood against a sum over all sequences, the gradient against differences."""
    rng = np.random.default_rng(2)
    chains = [[[0, 1], [2], [1, 3]], [[3]], [[0], [0, 2], [1], [2, 3], []]]
    labels = [[1, 0, 1], [0], [0, 1, 1, 0, 1]]
    table = crf.Chains.of(chains, labels)
    at = rng.normal(size=10)

    def value(at):
        return crf.likelihood(at[:4], at[4:8].reshape(2, 2), at[8:], table)[0]

    wanted = 0
    for chain, ys in zip(chains, labels):
        scores = [at[spot].sum() for spot in chain]
        every = [chain_score(scores, at[4:8].reshape(2, 2), at[8:], y) for y in itertools.product((0, 1), repeat=len(chain))]
        wanted += chain_score(scores, at[4:8].reshape(2, 2), at[8:], ys) - np.logaddexp.reduce(every)
    assert abs(value(at) - wanted) < 1e-9
    _, *parts = crf.likelihood(at[:4], at[4:8].reshape(2, 2), at[8:], table)
    slope = np.concatenate([p.ravel() for p in parts])
    for i, step in enumerate(np.eye(10) * 1e-5):
        assert abs((value(at + step) - value(at - step)) / 2e-5 - slope[i]) < 1e-4


def test_held_out_pages(model):
    wrong = total = 0
    for seed in range(50_000, 50_400):
        page = labelled_page(seed)
        blocks = blocks_of(page, Contexts())
        kept = crf.viterbi([sum(model.weights.get(f, 0) for f in b.features) for b in blocks], model.moves, model.starts)
        wrong += sum(bool(k) != bool(b.label) for k, b in zip(kept, blocks))
        total += len(blocks)
    assert wrong < 0.015 * total


PAGES = [
    ("""<html><head><title>Site</title></head><body><div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div>
     <header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><main><article><h1>Title</h1>
     <p>First &amp; foremost, a paragraph of the article.</p><div class="ad">Buy now, it is cheap.</div><p>Last.</p>
     <section id="comments"><h2>Comments</h2><p>I liked it a lot.</p></section></article></main>
     <aside class="sidebar"><p>Other stories you may like.</p></aside><form><label>Name</label><input></form>
     <footer><p>&copy; 2020 Site.</p></footer></body></html>""", "Title\n\nFirst & foremost, a paragraph of the article.\n\nLast."),
    ("""<body><div id="menu"><a href=1>One</a> | <a href=2>Two</a></div><div class="post-content"><h1>Über</h1><p>Text, text and
     more text follows here.<p>Ende.</div><div class="footer">Impressum</div>""", "Über\n\nText, text and more text follows here.\n\nEnde."),
    ("", ""), (None, ""), ("<nav><a href=/>Home</a></nav>", ""),
]


def test_hand_written_pages(spark, model):
    rows = [(i, "u", h, "x", "y", "z") for i, (h, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0], "x", "y", "z"), (None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row string, n_chars string")
    got = [(r.row.page_id, r.row.row, r.text, r.n_chars) for r in html_extract.extract(table, model).collect()]
    wanted = [(i, "y", t, len(t)) for i, (_, t) in enumerate(PAGES)]
    assert sorted(got, key=repr) == sorted([*wanted, wanted[0], (None, None, "", 0)], key=repr)
    assert html_extract.extract(table.limit(0), model).count() == 0


def test_a_very_long_page(spark, model):
    page = "<body><nav><a href=/>Home</a></nav><article>" + "<p>A sentence of the article, again.</p>" * 80_000 + "</article><footer>&copy;</footer>"
    table = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    (row,) = html_extract.extract(table, model).collect()
    assert row.text == "\n\n".join(["A sentence of the article, again."] * 80_000) and row.n_chars == len(row.text)


def test_learning_needs_labelled_pages(spark):
    empty = spark.createDataFrame([(None,), ("",)], "html string")
    with pytest.raises(ValueError):
        html_extract.learn(empty)
