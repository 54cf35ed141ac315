"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each page is a chain of leaf blocks; a block is main text or not. Features are the block's tag, the tags and
class words of its ancestors, and its text (length, links, end, signs of notices), each alone and with the
neighbour's length. The weights are trained by gradient steps on the likelihood of labelled pages and the best
labelling of a page is found by Viterbi. The labelled pages come with this module: they are drawn from page
layouts with random words, so training is the same everywhere and takes ``TRAINING_PAGES`` pages.

Defined results: null and empty pages, and pages without main text, give an empty text; repeated rows are handled
one by one; a page that ends early is read as far as it goes; other columns are left out by the query only.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import row_slices, text_buffers
from plumbline.llm.html_blocks import leaf_blocks

TRAINING_PAGES = 800


def features(blocks: list[tuple[str, float, tuple, str]]) -> list[list[str]]:
    sizes = [min(9, len(b[0]).bit_length()) for b in blocks]
    out = []
    for i, (text, linked, ancestors, tag) in enumerate(blocks):
        words = text.count(" ") + 1
        low = text.lower()
        own = [
            "bias", f"in:{tag}", f"size:{sizes[i]}", f"words:{min(6, words.bit_length())}", f"link:{int(linked * 4)}",
            f"end:{text[-1] if text[-1] in '.!?:,;' else 'x'}", f"before:{sizes[i - 1] if i else -1}",
            f"after:{sizes[i + 1] if i + 1 < len(sizes) else -1}", *ancestors,
        ]
        if "©" in low or "copyright" in low or "all rights reserved" in low:
            own.append("rights")
        if "cookie" in low or "privacy" in low or "subscribe" in low or "newsletter" in low:
            own.append("notice")
        out.append(own)
    return out


class Field:
    """Two states; one weight per feature and state, one per transition, one per state at each end."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.state = np.zeros((0, 2))
        self.step, self.begin, self.end = np.zeros((2, 2)), np.zeros(2), np.zeros(2)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.state[r].sum(axis=0) if r else np.zeros(2) for r in rows])

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-4) -> "Field":
        for rows, _ in pages:
            for row in rows:
                for f in row:
                    self.index.setdefault(f, len(self.index))
        self.state = np.zeros((len(self.index), 2))
        squares = [np.full_like(x, 1e-6) for x in (self.state, self.step, self.begin, self.end)]
        coded = [([[self.index[f] for f in r] for r in rows], np.array(labels)) for rows, labels in pages if rows]
        order = random.Random(5)
        for _ in range(rounds):
            order.shuffle(coded)
            for rows, labels in coded:
                emit = self.scores(rows)
                node, edge = self._marginals(emit)
                n = len(rows)
                # Gradient: what is there less what the model expects.
                there = np.zeros((n, 2))
                there[np.arange(n), labels] = 1
                steps = np.zeros((2, 2))
                np.add.at(steps, (labels[:-1], labels[1:]), 1)
                full = np.zeros_like(self.state)
                np.add.at(full, np.concatenate(rows), np.repeat(there - node, [len(r) for r in rows], axis=0))
                for weights, gradient, square in zip(
                    (self.state, self.step, self.begin, self.end),
                    (full, steps - edge, there[0] - node[0], there[-1] - node[-1]), squares,
                ):
                    gradient = gradient - decay * weights
                    square += gradient * gradient
                    weights += rate * gradient / np.sqrt(square)
        return self

    def _marginals(self, emit):
        n = len(emit)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = self.begin + emit[0]
        for i in range(1, n):
            forward[i] = emit[i] + np.logaddexp(*(forward[i - 1][:, None] + self.step))
        backward[-1] = self.end
        for i in range(n - 2, -1, -1):
            x = self.step + (emit[i + 1] + backward[i + 1])[None, :]
            backward[i] = np.logaddexp(x[:, 0], x[:, 1])
        total = np.logaddexp(*(forward[-1] + self.end))
        node = np.exp(forward + backward - total)
        edge = np.zeros((2, 2))
        if n > 1:
            edge = np.exp(forward[:-1, :, None] + self.step[None] + (emit[1:] + backward[1:])[:, None, :] - total).sum(axis=0)
        return node, edge

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        known = self.index
        emit = self.scores([[known[f] for f in r if f in known] for r in rows])
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = (self.begin + emit[0]).tolist()
        back = []
        for e0, e1 in emit[1:].tolist():
            from0, from1 = a + s00 < b + s10, a + s01 < b + s11
            a, b = (b + s10 if from0 else a + s00) + e0, (b + s11 if from1 else a + s01) + e1
            back.append((from0, from1))
        now = int(b + self.end[1] > a + self.end[0])
        out = [now]
        for choice in reversed(back):
            now = int(choice[now])
            out.append(now)
        return out[::-1]


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page of some layout and the label of each of its leaf blocks."""
    r = random.Random(seed)
    letters = "abcdefghijklmnoprstuvwéäöüñ"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(4, 22).capitalize() + "."
    text = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    out: list[str] = []
    labels: list[int] = []

    def block(tag: str, content: str, label: int, attrs: str = "") -> None:
        out.append(f"<{tag}{attrs}>{content}" + ("" if tag == "p" and r.random() < 0.15 else f"</{tag}>"))
        labels.append(label)

    def links(name: str) -> None:
        out.append("<ul>" if name else "")
        for _ in range(r.randint(2, 8)):
            block("li" if name else "p", f'<a href="/{word()}">{words(1, 3)}</a>', 0)
        out.append("</ul>" if name else "")

    def box(tag: str, names: list[str], fill) -> None:
        name = r.choice(names)
        out.append(f'<{tag} {r.choice(["class", "class", "id"])}="{name}">' if name else f"<{tag}>")
        fill()
        out.append(f"</{tag}>")

    def prose(n: int, label: int) -> None:
        for _ in range(n):
            block("p", text(1, 4), label)

    def menu():
        box("nav", ["", "", "menu", "nav main-nav", "breadcrumb"], lambda: links("ul")) if r.random() < 0.7 else box(
            "div", ["menu", "nav", "navigation", "navbar", "breadcrumbs", "topbar"], lambda: links("ul"))

    def head():
        tag = r.choice(["header", "header", "div"])
        named = ["header", "site-header", "masthead", "page-header", "top banner"]
        box(tag, ["", *named] if tag == "header" else named,
            lambda: (block(r.choice(["h1", "div", "p"]), words(1, 5), 0), prose(r.randint(0, 1), 0)))

    def advert():
        box(r.choice(["div", "aside", "section"]), ["ad", "ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot"],
            lambda: block(r.choice(["p", "div"]), text(1, 2), 0) if r.random() < 0.6 else (out.append(text(1, 2)), labels.append(0)))

    def side():
        box(r.choice(["aside", "aside", "div"]), ["sidebar", "side", "related", "widget", "recommended", "rail", "share social", "popular"],
            lambda: (block(r.choice(["h3", "h4"]), words(1, 3), 0), links("ul") if r.random() < 0.6 else prose(r.randint(1, 2), 0)))

    def notice():
        box(r.choice(["div", "section"]), ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "newsletter", "subscribe", "popup modal"],
            lambda: block(r.choice(["p", "p", "button"]), r.choice(["We use cookies to improve this site. ", "Subscribe to our newsletter. ", ""]) + text(1, 2), 0))

    def form():
        out.append(f'<form class="{r.choice(["search", "login", "contact", "signup"])}">')
        block("label", words(1, 3), 0)
        block("button", words(1, 2), 0)
        out.append("</form>")

    def comments():
        def fill():
            block(r.choice(["h2", "h3"]), words(1, 3), 0)
            for _ in range(r.randint(1, 4)):
                box(r.choice(["div", "li", "article"]), ["comment", "comment", "reply", "comment-body", "response"], lambda: prose(r.randint(1, 2), 0))
        box(r.choice(["section", "div", "div"]), ["comments", "comments", "discussion", "responses", "comment-list", "disqus"], fill)

    def foot():
        tag = "footer" if r.random() < 0.7 else "div"
        named = ["footer", "site-footer", "legal", "bottom", "copyright"]
        box(tag, ["", *named] if tag == "footer" else named, lambda: (
            (out.append(f"&copy; {word()}.example.com &middot; {text(1, 1)}"), labels.append(0)) if r.random() < 0.5 else
            block("p", f"Copyright {r.randint(1999, 2030)} {words(1, 4)}. All rights reserved.", 0),
            links("ul") if r.random() < 0.3 else None))

    def article():
        block(r.choice(["h1", "h1", "h2"]), words(3, 12), 1)
        for i in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.1:
                line = r.choice(["All rights reserved.", "Subscribe to our newsletter.", "Privacy and cookies."]) if r.random() < 0.3 else words(1, 4).capitalize() + "."
                block("p", line, 1)
            elif x < 0.62:
                block("p", ("<b>" if r.random() < 0.15 else "") + text(1, 6) + ("<br>" if r.random() < 0.1 else ""), 1)
            elif x < 0.72:
                block(r.choice(["h2", "h3"]), words(2, 6), 1)
            elif x < 0.80:
                out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    block("li", words(3, 14), 1)
                out.append("</ul>")
            elif x < 0.86:
                block("blockquote", text(1, 3), 1)
            elif x < 0.9:
                out.append("<table>")
                for _ in range(2):
                    out.append("<tr>")
                    block("td", words(1, 5), 1)
                    block("td", words(1, 5), 1)
                    out.append("</tr>")
                out.append("</table>")
            elif x < 0.94:
                block("pre", words(4, 20), 1)
            else:
                r.choice([advert, side, notice])()

    before = [f for f, p in ((menu, 0.8), (head, 0.5), (advert, 0.5), (notice, 0.3), (side, 0.2), (form, 0.2)) if r.random() < p]
    after = [f for f, p in ((side, 0.4), (advert, 0.3), (comments, 0.45), (form, 0.2), (notice, 0.2), (foot, 0.8)) if r.random() < p]
    r.shuffle(before)
    out.append("<!DOCTYPE html><html><head><style>p{margin:0}</style><script>var t=\"</p>\";</script></head><body>")
    for f in before:
        f()
    if r.random() < 0.08:
        pass  # a page without an article
    else:
        tag, names = r.choice([
            ("article", [""]), ("article", ["", "post", "story"]), ("main", ["", "content"]),
            ("div", ["content", "post-content", "entry-content", "article-body", "story", "main", "text"]), ("section", ["article", "content", "body"])])
        wrapped = r.random() < 0.3
        out.append('<div class="container">' if wrapped else "")
        box(tag, names, article)
        out.append("</div>" if wrapped else "")
    for f in after:
        f()
    out.append("" if r.random() < 0.1 else "</body></html>")
    return "".join(out), labels


def train(pages: int = TRAINING_PAGES) -> Field:
    data = []
    for seed in range(pages):
        page, labels = labelled_page(seed)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            data.append((features(blocks), labels))
    return Field().train(data)


def main_text(page: str, model: Field, wanted) -> str:
    blocks = leaf_blocks(page, wanted)
    if not blocks:
        return ""
    labels = model.viterbi(features(blocks))
    return "\n\n".join(b[0] for b, label in zip(blocks, labels) if label)


def _extract(model, width: int):
    def run(batches):
        field = model.value
        wanted = frozenset(field.index)
        for batch in batches:
            _, offsets = text_buffers(batch.column(width))
            for a, b in row_slices(offsets):
                texts = [main_text(p or "", field, wanted) for p in batch.column(width).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(width)), pa.array(texts, pa.string())],
                    [*batch.schema.names[:width], "text"])

    return run


def extract(pages: DataFrame, *, html_col: str = "html", model: Field | None = None) -> DataFrame:
    """``pages`` with ``text`` in place of the html; a column of that name is replaced."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    own = [c for c in pages.columns if c not in (html_col, "text")]
    rows = pages.select(*own, F.col(html_col).cast("string").alias(html_col))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != html_col] + ["text string"])
    return rows.mapInArrow(_extract(shared, len(own)), schema)
