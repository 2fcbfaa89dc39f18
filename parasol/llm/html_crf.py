"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into the blocks that hold text themselves. Each block has features
of its ancestors (tags; words of their class, id and role) and of its text
(length, punctuation, links, place on the page, likeness to the title). The field
has two states, main text or not, with weights for each feature and state and for
each pair of neighbouring states. It is trained by gradient ascent on the
conditional likelihood (forward-backward over all training pages at once) and
decoded by Viterbi, page by page.

*Labelled pages.* ``layouts`` writes pages of many layouts whose blocks are
labelled as they are written: with and without sectioning elements, with menus,
headers, sidebars, notices, adverts, forms, footers and reader comments before,
inside and after the article, also of pages whose text is full of odd signs. The
words that fill them come from ``SAMPLE_PAGES`` pages of the table, the ones with
the smallest hashed ids, up to ``SAMPLE_CHARS`` characters of each. In training,
features are left out at random, so that no single one carries the decision.

A null or empty page, or one without text, has an empty text; an empty table gives
an empty one. Null ids and urls stay null. Repeated rows are extracted each for
itself. Pages of any length and depth are read whole, in time by their length.
Where both states are equally likely, a block is not main text. Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parasol.llm.common import ship_by_value
from parasol.llm.dom import Block, Element, around, leaf_blocks

ship_by_value(__name__)

SAMPLE_PAGES = 200  # pages whose words fill the labelled layouts
SAMPLE_CHARS = 20_000
LAYOUT_PAGES = 500
LEFT_OUT = 0.15
STEPS = 150
RIDGE = 0.02
OUTPUT_BYTES = 8 << 20


def features(blocks: list[Block], i: int) -> list[str]:
    """Names of the features of block ``i``: its own and its elements'."""
    return own_features(blocks, i) + list(around(blocks[i]))


def own_features(blocks: list[Block], i: int) -> list[str]:
    """Names of the features of block ``i`` but those of its elements."""
    b = blocks[i]
    words = b.text.split(" ")
    n = len(words)
    punctuated = sum(w[-1] in ".,;:!?…" for w in words)
    found = ["any", "tag " + b.tag, f"words {min(n.bit_length(), 8)}", f"linked {int(b.linked * 4)}",
             f"marks {min(int(8 * punctuated / n), 4)}", f"ends {b.text[-1] in '.!?…'}",
             f"place {4 * i // len(blocks)}", f"letters {sum(map(str.isalpha, b.text)) * 4 // len(b.text)}"]
    if b.title and (b.text.startswith(b.title[:40]) or b.title.startswith(b.text)):
        found.append("title")
    if b.text[0] in "©℗®":
        found.append("sign")
    if i and (b.around.path if b.around else -1) == (blocks[i - 1].around.path if blocks[i - 1].around else -1):
        found.append("like before")
    return found


# Layouts: (label, elements around, elements of its blocks, (fewest, most) blocks, (fewest, most) words, punctuated).
_MENU = ("<nav>", "<nav class='menu'>", "<div class='nav main-menu'>", "<ul id='navigation'>", "<div role='navigation'>",
         "<div class='breadcrumbs'>", "<div id='topbar'>", "<ul class='tabs'>", "<nav class='pagination'>")
_HEAD = ("<header>", "<div id='header'>", "<div class='site-header masthead'>", "<header class='top'>", "<div role='banner'>")
_FOOT = ("<footer>", "<div id='footer'>", "<div class='site-footer'>", "<footer class='copyright'>", "<div role='contentinfo'>",
         "<div class='legal'>")
_SIDE = ("<aside>", "<div class='sidebar'>", "<div id='sidebar-right'>", "<aside class='related'>", "<div class='widget'>",
         "<div class='related-posts'>", "<div class='recommended'>", "<div role='complementary'>", "<aside class='toc'>")
_NOTE = ("<div class='cookie-notice'>", "<div id='consent-banner'>", "<div class='newsletter subscribe'>", "<div class='popup'>",
         "<div class='notice'>", "<div class='share social'>", "<div class='alert'>", "<div role='alert'>", "<div class='promo'>",
         "<dialog>", "<div class='byline meta'>", "<div class='paywall'>")
_AD = ("<div class='ad'>", "<div class='advert'>", "<div class='ads banner'>", "<div id='ad-top'>", "<div class='sponsored'>",
       "<aside class='advertisement'>", "<section class='ad-slot'>", "<div class='ad-container'>", "<p class='sponsor'>")
_FORM = ("<form>", "<form class='search'>", "<div class='login'><form>", "<form id='contact'>", "<fieldset>", "<form class='signup'>")
_TALK = ("<div class='comments'>", "<section id='comments'>", "<div class='comment-list'>", "<ol class='commentlist'>",
         "<div class='discussion replies'>", "<section class='reader-comments'>", "<div class='user-comment'>", "<div id='disqus-thread'>",
         "<section class='responses'><article class='comment'>")
_MAIN = ("<article>", "<main>", "<div class='content'>", "<div id='content'>", "<div class='post-body'>", "<main><article>",
         "<div class='entry-content'>", "<div class='article-text'>", "<section class='story'>", "<div>", "<article class='post'>",
         "<div role='main'>", "<td>")
_P = ("<p>",)
NOISE = ("", "!!", "###", "&&&", "***", " 7,", "%")
OTHER = {
    "menu": (_MENU, ("<li><a>", "<a>", "<li>", "<div><a>"), (2, 8), (1, 3), 0.1),
    "head": (_HEAD, ("<p>", "<div>", "<h1>", "<h2>", "<a>"), (1, 3), (1, 8), 0.2),
    "foot": (_FOOT, ("", "<p>", "<div>", "<li><a>", "<small>"), (1, 3), (2, 30), 0.4),
    "side": (_SIDE, ("<li><a>", "<p>", "<h3>", "<div>"), (1, 6), (2, 25), 0.4),
    "note": (_NOTE, ("<p>", "", "<div>", "<button>"), (1, 2), (2, 30), 0.5),
    "ad": (_AD, ("", "<p>", "<div>", "<a>"), (1, 2), (2, 40), 0.5),
    "form": (_FORM, ("<p>", "<label>", "<div>", "<button>", "<legend>"), (1, 4), (1, 12), 0.3),
    "talk": (_TALK, ("<p>", "<li><p>", "<div class='comment'><p>", "<h3>"), (1, 6), (2, 60), 0.7),
}


def _closing(opening: str) -> str:
    return "".join(f"</{part.split()[0].rstrip('>')}>" for part in reversed(opening.split("<")[1:]))


def layouts(words: list[str], pages: int, seed: int = 7) -> list[str]:
    """Labelled pages: elements carry ``data-gold``, 1 for main text and 0 for the rest."""
    pick = random.Random(seed)
    words, noisy = words or ["word"], False

    def phrase(low: int, high: int, punctuated: float) -> str:
        n = int(low * (high / low) ** pick.random())
        found = [pick.choice(words) + (pick.choice(NOISE) if noisy else "") for _ in range(n)]
        return escape(" ".join(found).rstrip(".,") + ("." if pick.random() < punctuated and not noisy else ""))

    def labelled(opening: str, label: int) -> str:
        return opening.replace(">", f" data-gold='{label}'>", 1)

    def region(kind: str) -> str:
        around, leaves, count, size, punctuated = OTHER[kind]
        opening, leaf = pick.choice(around), pick.choice(leaves)
        sign = "&copy; " if kind == "foot" and pick.random() < 0.6 else ""
        inner = "".join(sign + leaf + phrase(*size, punctuated) + _closing(leaf) for _ in range(pick.randint(*count)))
        return labelled(opening, 0) + inner + _closing(opening)

    def main() -> tuple[str, str]:
        opening, heading = pick.choice(_MAIN), phrase(2, 14, 0.2)
        inner = [f"<h1>{heading}</h1>"] if pick.random() < 0.8 else []
        for _ in range(int(1.2 + pick.random() ** 2 * 14)):
            kind = pick.random()
            if kind < 0.85:
                inner.append(f"<p>{phrase(1, 150, 0.9)}" + ("</p>" if pick.random() < 0.9 else ""))
            elif kind < 0.9:
                inner.append(f"<h2>{phrase(1, 8, 0.1)}</h2>")
            elif kind < 0.94:
                inner.append("<ul>" + "".join(f"<li>{phrase(2, 20, 0.5)}</li>" for _ in range(pick.randint(1, 4))) + "</ul>")
            elif kind < 0.97:
                inner.append(f"<blockquote>{phrase(5, 40, 0.9)}</blockquote>")
            else:
                inner.append(f"<pre>{phrase(3, 40, 0.2)}</pre>")
        for kind in ("ad", "note", "side", "talk", "form"):
            if pick.random() < 0.15:
                place = len(inner) if kind == "talk" else pick.randint(1, len(inner)) if inner else 0
                inner.insert(place, region(kind))
        return heading, labelled(opening, 1) + "".join(inner) + _closing(opening)

    found = []
    for _ in range(pages):
        noisy = pick.random() < 0.3  # pages of odd signs, whose text looks like no prose
        heading, body = main()
        before = [region(k) for k in ("head", "menu", "note", "ad", "side", "form") if pick.random() < 0.45]
        after = [region(k) for k in ("talk", "side", "ad", "form", "note", "menu", "foot") if pick.random() < 0.4]
        title = f"<head><title>{heading}</title></head>" if pick.random() < 0.8 else ""
        found.append(f"<html>{title}<body>{''.join(before)}{body}{''.join(after)}</body></html>")
    return found


def train(pages: list[list[Block]], seed: int = 7) -> dict:
    """Weights of (feature: two states) and of neighbouring states, from pages whose blocks have gold labels."""
    pick = random.Random(seed)
    pages = [p for p in pages if p]
    names: dict[str, int] = {}
    row, column, gold, page_of, place = [], [], [], [], []
    for p, blocks in enumerate(pages):
        for i, block in enumerate(blocks):
            for f in features(blocks, i):
                if f == "any" or pick.random() >= LEFT_OUT:
                    row.append(len(gold))
                    column.append(names.setdefault(f, len(names)))
            gold.append(int(block.gold == "1"))
            page_of.append(p)
            place.append(i)
    row, column, gold, page_of, place = map(np.array, (row, column, gold, page_of, place))
    n, longest = len(gold), int(place.max()) + 1
    length = np.bincount(page_of)
    weights, pairs, begin = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (weights, pairs, begin)]
    truth = np.eye(2)[gold]
    target = np.stack([np.bincount(column, truth[row, s], len(names)) for s in (0, 1)], 1)
    inner = np.flatnonzero(place[1:] > 0) + 1
    pair_target = np.zeros((2, 2))
    np.add.at(pair_target, (gold[inner - 1], gold[inner]), 1)
    begin_target = truth[place == 0].sum(axis=0)

    def logsum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, STEPS + 1):
        scores = np.stack([np.bincount(row, weights[column, s], n) for s in (0, 1)], 1)
        grid = np.zeros((len(pages), longest, 2))
        grid[page_of, place] = scores
        forward, backward = np.zeros_like(grid), np.zeros_like(grid)
        forward[:, 0] = begin + grid[:, 0]
        for t in range(1, longest):
            forward[:, t] = logsum(forward[:, t - 1, :, None] + pairs, 1) + grid[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = logsum(pairs + (grid[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where((t + 1 < length)[:, None], ahead, 0)
        whole = logsum(forward[np.arange(len(pages)), length - 1], 1)
        belief = np.exp(forward[page_of, place] + backward[page_of, place] - whole[page_of, None])
        both = np.exp(forward[page_of[inner], place[inner] - 1][:, :, None] + pairs
                      + (grid[page_of[inner], place[inner]] + backward[page_of[inner], place[inner]])[:, None, :]
                      - whole[page_of[inner], None, None]).sum(axis=0)
        expected = np.stack([np.bincount(column, belief[row, s], len(names)) for s in (0, 1)], 1)
        slopes = (target - expected - RIDGE * n / 100 * weights, pair_target - both, begin_target - belief[place == 0].sum(axis=0))
        for w, slope, (m, v) in zip((weights, pairs, begin), slopes, moments):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope ** 2 - v)
            w += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    gain = weights[:, 1] - weights[:, 0]
    return {"gain": {f: float(gain[i]) for f, i in names.items()}, "pairs": pairs.tolist(), "begin": begin.tolist()}


def decode(model: dict, blocks: list[Block]) -> list[bool]:
    """The likeliest states of a page's blocks: whether each is main text."""
    if not blocks:
        return []
    gain, ((stay, enter), (leave, go_on)), (out, main) = model["gain"].get, model["pairs"], model["begin"]
    sums: dict[Element | None, float] = {None: 0.0}  # gains of an element's features and its ancestors', once for each element
    back = []
    for i in range(len(blocks)):
        path, element = [], blocks[i].around
        while element not in sums:
            path.append(element)
            element = element.parent
        for inner in reversed(path):
            sums[inner] = sums[inner.parent] + sum(gain(f, 0.0) for f in inner.fresh)
        score = sums[blocks[i].around] + sum(gain(f, 0.0) for f in own_features(blocks, i))
        if i:
            from_out, from_main = (out + enter >= main + go_on), (out + stay >= main + leave)
            back.append((not from_main, not from_out))
            out, main = max(out + stay, main + leave), max(out + enter, main + go_on)
        main += score
    states = [main > out]
    for to_out, to_main in reversed(back):
        states.append(to_main if states[-1] else to_out)
    return states[::-1]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> dict:
    """A model trained on the labelled layouts with the words of at most ``sample`` pages."""
    rows = pages.select(F.col(html_col).alias("html"), F.xxhash64(id_col).alias("h")).where("html IS NOT NULL")
    # The hashes are picked first, so that only the sample's pages leave their tasks.
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = rows.where(F.col("h") <= last).select("h", F.substring("html", 1, SAMPLE_CHARS).alias("html")).limit(sample) if last is not None else None
    texts = [r["html"] for r in sorted(chosen.collect())] if chosen is not None else []
    words = [w for t in texts for b in leaf_blocks(t) for w in b.text.split(" ")]
    return train([leaf_blocks(page) for page in layouts(words, LAYOUT_PAGES)])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: dict | None = None) -> DataFrame:
    """Per page: id, url, its main text, blocks joined by line feeds, and the text's length in code points."""
    shipped = pages.sparkSession.sparkContext.broadcast(model or fit(pages, id_col, html_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shipped.value
        for batch in batches:
            texts, since, held = [], 0, 0
            for i, html in enumerate(batch["html"]):
                blocks = leaf_blocks(html.as_py())
                texts.append("\n".join(b.text for b, kept in zip(blocks, decode(field, blocks)) if kept))
                held += len(texts[-1])
                if held >= OUTPUT_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(since, len(texts))
                    yield pa.RecordBatch.from_arrays([part["id"], part["url"], pa.array(texts, pa.string())], ["id", "url", "text"])
                    texts, since, held = [], i + 1, 0

    found = rows.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
