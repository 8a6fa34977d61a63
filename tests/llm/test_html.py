import duckdb
import numpy as np
import pytest

from ledgerlens.llm import html_extract as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages():
    return [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()]


@pytest.fixture(scope="module")
def model(pages):
    return H.train(pages[:100])


def test_gradients():
    rng = np.random.default_rng(1)
    m = H.BiLSTM(rng)
    m.p = {k: v.astype("f8") for k, v in m.p.items()}
    x, lengths = rng.normal(size=(5, 3, H.DIM)), np.array([5, 3, 1])
    y = (rng.random((5, 3)) > 0.5).astype("f8")
    _, grad = m.gradients(x, lengths, y)
    for k, p in m.p.items():
        i = tuple(rng.integers(0, s) for s in p.shape)
        old, e = p[i], 1e-3
        p[i] = old + e
        up = m.gradients(x, lengths, y)[0]
        p[i] = old - e
        down = m.gradients(x, lengths, y)[0]
        p[i] = old
        assert abs((up - down) / (2 * e) - grad[k][i]) < 1e-4


def test_blocks():
    page = ("<html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><p>a &amp; b\n <b>c</b> &eacute;<p>d"
            "<!-- <p>no</p> --><ul><li>x<li>y</ul>tail<br>more <a href='>'>link</a><textarea>no</textarea> &lt;end")
    assert [b.text for b in H.blocks_of(page)] == ["a & b c é", "d", "x", "y", "tail more link <end"]
    assert H.blocks_of(None) == [] and H.blocks_of("") == [] and H.blocks_of("<p>") == []


def test_unseen_pages_and_layouts(model, pages):
    for page, text in zip(pages[100:], H.extract_pages(model, pages[100:])):
        assert text == "\n".join(b.text for b in H.blocks_of(page) if "article" in b.path)
    rng = np.random.default_rng(3)
    right = total = 0
    for page in pages[100:200]:
        b = H.blocks_of(page)
        blocks, labels = H.altered(b, H.weak_labels(b), rng)
        right += int((H.label(model, [blocks])[0] == np.array(labels, bool)).sum())
        total += len(labels)
    assert right / total > 0.97


def test_without_usable_sample_pages(spark):
    page = "<body><nav><a href='/'>Home</a></nav><article>" + "<p>Some words of a long article, one after the other.</p>" * 3_000 + "</article></body>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    text = H.extract(df, H.fit(df)).first().text
    assert text.count("\n") == 2_999 and "Home" not in text


def test_rows(spark, model, pages):
    long_page = "<article>" + "<p>Some words of a long article.</p>" * 5_000 + "</article>"
    rows = [(1, "u", pages[101], "x"), (1, "u", pages[101], "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", long_page, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract(df, model, also=("url",)).toPandas()
    assert len(out) == 5 and out.text.isna().sum() == 0
    assert out[out.page_id == 2].text.tolist() == [""]
    got = out[out.page_id == 1].text.tolist()
    assert got[0] == got[1] == H.extract_pages(model, [pages[101]])[0]
    assert H.extract(df.limit(0), model).count() == 0


def test_elements_inside_a_line_do_not_end_its_block():
    texts = lambda page: [b.text for b in H.blocks_of(page)]
    assert texts("<p>foo <img src=x> bar<br>baz <input name=q> qux<br/><br/>end</p><p>next</p>") == ["foo bar baz qux end", "next"]
    assert texts("<p>press <button class=b>Send</button> now</p>") == ["press now"]
