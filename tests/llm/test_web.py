"""WARC round trips and main text."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from parasol.llm import dom, html_crf, warc

PAGES = [(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, None, None), (4, "http://c\r\nEvil: 1", "small"), (5, "", "small"),
         (None, "http://n", "x" * 200), (1, "http://a", "x" * 200), (7, "http://ü", "é" * 300_000 + "\r\n\r\n"), (8, "u", "")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit("d"))


def test_archives_give_back_what_was_written(spark):
    found = warc.round_trip(spark, pages(spark).repartition(3)).collect()
    assert len(found) == len(PAGES) and all(r.valid for r in found)
    responses = {(r.page_id, bytes(r.payload)) for r in found if r.record_type == "response"}
    want, got = [], []
    for i, _, html in PAGES:
        data = (html or "").encode()
        revisit = html == "x" * 200 and i != 1
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
        assert revisit or (i, data) in responses
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r.url for r in found if r.page_id == 4} == {"http://c%0D%0AEvil: 1"} and {r.url for r in found if r.page_id == 3} == {None}
    assert warc.round_trip(spark, pages(spark, []).limit(0)).count() == 0


def archive(*payloads):
    return b"".join(gzip.compress(warc.record(i, "u", p, hashlib.sha256(p).hexdigest(), None, warc.UNKNOWN_DATE)) for i, p in enumerate(payloads))


def test_damage_is_noticed():
    good = archive(b"one", b"two" * 100_000)
    assert [r["payload"] for r in warc.read_records(io.BytesIO(good))] == [b"one", b"two" * 100_000]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-20])))
    raw = warc.record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None, warc.UNKNOWN_DATE)
    changed = next(warc.read_records(io.BytesIO(gzip.compress(raw.replace(b"body", b"bodY")))))
    assert not changed["valid"]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(raw + b"more"))))
    assert list(warc.read_records(io.BytesIO(b""))) == []


def test_blocks_of_a_page():
    page = ("<html><head><title>T</title></head><body><script>var a='<p>no</p>'</script><!-- <p>no</p> --><p>one <b>two</b>\n three<p>four &amp; &eacute;"
            "<ul><li>five<li><a href='x>y'>six</a></ul><style>p{}</style>tail<br>more</body>")
    assert [b.text for b in dom.leaf_blocks(page)] == ["one two three", "four & é", "five", "six", "tail more"]
    assert dom.leaf_blocks(None) == dom.leaf_blocks("") == dom.leaf_blocks("<p> </p><") [:0] == []
    assert [b.linked for b in dom.leaf_blocks(page)][3] == 1.0


@pytest.mark.parametrize("name", ["svg", "noscript", "iframe", "template", "object", "math"])
def test_text_after_an_element_left_open_stays(name):
    page = f"<article><p>one</p><{name} a='b'><p>two</p><p>three</p></article>"
    assert [b.text for b in dom.leaf_blocks(page)] == ["one", "two", "three"]
    later = f"<p>one</p><{name}><p>two</p><{name}>x</{name}><p>three</p>"
    assert [b.text for b in dom.leaf_blocks(later)] == ["one", "two"] + (["x"] if name in ("object", "math") else []) + ["three"]


def test_formulas_and_unseen_elements_in_a_sentence():
    page = "<p>if <math><mi>x</mi></math> is <svg><svg><text>no</text></svg><text>no</text></svg>odd<noscript>no</noscript><object>, say</object></p>"
    assert [b.text for b in dom.leaf_blocks(page)] == ["if x is odd, say"]
    assert [b.text for b in dom.leaf_blocks("<p>a</p><script>var x = '<p>no</p>'")] == ["a"]


@pytest.mark.parametrize("opening", ["<div>", "<blockquote>", "<p><button>", "<svg>", "<div class='c{}'>", "<p><select><blockquote>"])
def test_a_page_nested_deeply_takes_time_by_its_length(opening, model):
    import time
    n, begun = 30_000, time.monotonic()
    blocks = dom.leaf_blocks("".join(opening.format(i) + f"word {i}" for i in range(n)))
    assert len(html_crf.decode(model, blocks)) == len(blocks) and " ".join(b.text for b in blocks).split()[-1] == str(n - 1)
    assert time.monotonic() - begun < 10


def test_features_of_elements_count_once():
    page = "<div class='a b'><div class='b c'>one<section class='a'>two</section></div>three</div>"
    found = {b.text: sorted(dom.around(b)) for b in dom.leaf_blocks(page)}
    assert found == {"one": ["in div", "of a", "of b", "of c"], "two": ["in div", "in section", "of a", "of b", "of c"],
                     "three": ["in div", "of a", "of b"]}


@pytest.fixture(scope="module")
def model():
    words = "some words that fill a page of prose and nothing else".split()
    return html_crf.train([dom.leaf_blocks(p) for p in html_crf.layouts(words, 400)])


def test_field_labels_layouts_it_has_not_seen(model):
    words = "other words from elsewhere, which stand in the pages held out.".split()
    unseen = [dom.leaf_blocks(p) for p in html_crf.layouts(words, 200, seed=99)]
    right = [d == (b.gold == "1") for p in unseen for b, d in zip(p, html_crf.decode(model, p))]
    assert sum(right) >= 0.97 * len(right)


def test_viterbi_is_the_best_of_all_labellings(model):
    from itertools import product
    for page in html_crf.layouts(["a", "b."], 12, seed=5):
        blocks = dom.leaf_blocks(page)[:9]
        gains = [sum(model["gain"].get(f, 0.0) for f in html_crf.features(blocks, i)) for i in range(len(blocks))]

        def total(states):
            return (model["begin"][states[0]] + sum(g for g, s in zip(gains, states) if s)
                    + sum(model["pairs"][a][b] for a, b in zip(states, states[1:])))

        best = max(product((0, 1), repeat=len(blocks)), key=total)
        assert total(best) == pytest.approx(total([int(s) for s in html_crf.decode(model, blocks)]))


def test_main_text_of_pages(spark, model):
    rows = [(1, "u", "<nav><a href=/>menu</a></nav><article><h1>Head line</h1><p>It was a dark night.</p><p>Then came the day.</p>"
                     "<aside class=related><p>Read also this.</p></aside></article><footer>&copy; us</footer>"),
            (2, None, None), (3, "v", ""), (1, "u", "<p></p>")]
    found = html_crf.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")), model=model)
    got = sorted((r.page_id, r.text, r.n_chars) for r in found.collect())
    whole = "Head line\nIt was a dark night.\nThen came the day."
    assert got == [(1, "", 0), (1, whole, len(whole)), (2, "", 0), (3, "", 0)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_crf.main_text(empty, model=model).count() == html_crf.main_text(empty).count() == 0
    long = "<article><h1>Head line</h1>" + "".join(f"<p>It was dark night {i}, and long.</p>" for i in range(20_000)) + "</article>"
    clash = spark.createDataFrame([(None, None, long)], "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("n_chars", F.lit(2))
    row = html_crf.main_text(clash, model=model).first()
    assert row.page_id is None and row.text.count("\n") == 20_000 and row.n_chars == len(row.text)


def test_articles_of_the_table_come_back_whole(spark):
    import html
    import re
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_crf.main_text(rows).collect()}
    wrong = 0
    for page_id, _, page in rows.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        wrong += got[page_id] != "\n".join(b for b in blocks if b)
    assert wrong <= 0.02 * len(got)
