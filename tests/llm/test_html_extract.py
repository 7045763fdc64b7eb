"""HTML blocks, the network's gradients, and extraction."""

import random

import numpy as np
import pytest

from pkgpulse.llm import html_extract as X
from pkgpulse.llm.html_blocks import blocks

SF = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c<br>d&amp;e&nbsp;f</p><div>x<span>y</span><p>z") == ["a b c d&e f", "xy", "z"]
    assert texts("<style>p{}</style><script>var t='</p>';</script><!-- <p>no</p> --><!DOCTYPE html><?x?>1 < 2 <3") == ["1 < 2 <3"]
    assert texts("<p>one<p>two<ul><li>a<li>b</ul><textarea>no</textarea>t") == ["one", "two", "a", "b", "t"]
    assert texts("<a href='x>y' class=\"q\">in</a> out <title>no") == ["in out"]
    assert texts("<p>cut &am") == ["cut &am"] and texts("<p>cut<foot") == ["cut"] and texts('<p>x<a href="y') == ["x"]
    assert texts(None) == texts("") == texts("<div> \n </div>") == []
    assert texts("<P>中 &#20013; &eacute;</P>") == ["中 中 é"]
    # a paragraph left open does not swallow what follows, and a path holds no inline elements
    assert [b.path for b in blocks("<article class='Post main'><p><b>a<br><p>b</article><footer>c")] == [
        ("article", ".post", ".main", "p"), ("article", ".post", ".main", "p"), ("footer",),
    ]
    assert [(b.linked, b.path) for b in blocks("<li><a href=x>ab</a> c")] == [(2, ("li",))]


def test_gradients_match_differences():
    net = X.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x = rng.random((3, 5, X.N_INPUT))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    y = (rng.random((3, 5)) < 0.5).astype(float)

    def loss():
        z = net.logits(x, mask)[0]
        return np.where(mask, np.logaddexp(0, z) - y * z, 0).sum() / mask.sum()

    for name, grad in net.gradients(x, mask, y).items():
        flat, slope = net.p[name].reshape(-1), grad.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert slope[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-5), name


@pytest.fixture(scope="module")
def network():
    return X.train([])


def test_labels_of_unseen_pages(network):
    rng = random.Random(4321)
    right = total = 0
    for _ in range(150):
        page, labels = X.generated_page(rng, "unseen words of another kind appear here".split())
        found = blocks(page)
        right += int((network.label([found])[0] == np.array(labels[: len(found)])).sum())
        total += len(found)
    assert right / total > 0.97


def test_labels_do_not_depend_on_the_batch(network):
    rng = random.Random(5)
    pages = [blocks(X.generated_page(rng, ["a", "bc", "def"])[0]) for _ in range(40)] + [[]]
    pages.append(blocks("<article>" + "<p>many words stand here.</p>" * 9000 + "</article><footer>end</footer>"))
    together = network.label(pages)
    assert all((a == network.label([p])[0]).all() for a, p in zip(together, pages, strict=True))
    assert together[-1][:-1].all() and not together[-1][-1]


def test_table(spark):
    article = "<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>T</h1><p>One &amp; two.</p></article><footer>F</footer>"
    rows = [(1, "u", article, "x"), (1, "u", article, "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "<nav>only</nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in X.extract(df, generated=300).collect()), key=str)
    assert got == [(0, "v", "", 0), (1, "u", "T\nOne & two.", 12), (1, "u", "T\nOne & two.", 12), (2, None, "", 0), (4, "w", "", 0)]
    assert X.extract(df.limit(0), generated=20).collect() == []


def test_given_pages_give_their_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in X.extract(pages).collect()}
    want = {r.page_id: "\n".join(b.text for b in blocks(r.html) if "article" in b.path) for r in pages.collect()}
    assert got == want


def test_references_are_decoded_piece_by_piece():
    """Markup ends a character reference: pieces are decoded before they are joined."""
    text = lambda page: [b.text for b in blocks(page)]
    assert text("<p>&am<b>p;x</b></p>") == ["&amp;x"]
    assert text("<p>a &lt;<i>b</i>&gt; &amp;amp; c</p>") == ["a <b> &amp; c"]
