"""Main text of web pages: a recurrent labeller of blocks.

A page becomes its sequence of leaf blocks (html_blocks.py), each with a vector of its tag path and its hashed words. A
bidirectional LSTM in numpy reads the whole sequence and gives each block the probability of being main text, so what
stands around a block (a heading before, a list of links behind) counts as much as the block. The blocks it keeps are
joined in page order.

The pages carry no labels, so the network is trained on pages that a seeded generator writes: articles in varying
wrappers with menus, headers, footers, sidebars, notices, adverts, forms and reader comments, in which the main text is
known. Their number is a parameter and does not depend on the input.

A null or empty page, and one without main text, gives an empty text. Nothing of a kept block is dropped or cut. Very long
pages run alone. A block whose logit is exactly 0 (a tie) is not main text.
Repeated rows are extracted one by one. Columns beyond page_id, url and html are ignored.
"""

from __future__ import annotations

import functools
import html as escapes
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm.common import slices, small_batches, table
from decidra.llm.html_blocks import MARK, WIDTH, blocks, vectors

UNITS = 12


# --- training pages ---------------------------------------------------------------------------------------------------


def training_page(rng: random.Random) -> str:
    """A page whose main text blocks have the attribute MARK."""
    syllables = [a + b for a in ("th", "er", "on", "qu", "re", "st", "la", "de", "sch", "ó", "é", "n", "tr") for b in ("e", "an", "is", "or", "ung", "a", "ió", "eau")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    noise = rng.choice(["", "", "", "!!", "###", "***", "&"])

    def words(a: int, b: int) -> str:
        text = " ".join(word() + noise for _ in range(rng.randint(a, b)))
        return escapes.escape(text.capitalize() + rng.choice([".", ".", "", "!"]))

    def prose() -> str:
        return " ".join(words(1, 25) for _ in range(rng.choice([1, 1, 2, 4])))

    def tag(name: str, inner: str, kind: str = "", main: bool = False) -> str:
        named = f' {rng.choice(["class", "class", "id"])}="{kind}"' if kind else ""
        return f"<{name}{named}{' ' + MARK if main else ''}>{inner}</{name}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def menu() -> str:
        return rng.choice([lambda: tag("nav", links(rng.randint(2, 9))), lambda: tag("div", links(rng.randint(2, 9)), rng.choice(["menu", "nav", "navbar", "breadcrumb", "topnav"]))])()

    def header() -> str:
        inner = tag(rng.choice(["h1", "div", "p", "a"]), words(1, 4)) + (tag("p", words(3, 9)) if rng.random() < 0.5 else "") + (menu() if rng.random() < 0.4 else "")
        return rng.choice([lambda: tag("header", inner), lambda: tag("div", inner, rng.choice(["header", "masthead", "topbar", "site-header"]))])()

    def footer() -> str:
        inner = rng.choice([lambda: f"&copy; {word()}.example.com &middot; {words(3, 14)}", lambda: tag("p", f"&copy; {words(2, 6)}") + links(3), lambda: tag("p", words(4, 20))])()
        return rng.choice([lambda: tag("footer", inner), lambda: tag("div", inner, rng.choice(["footer", "site-footer", "bottom", "copyright"]))])()

    def advert() -> str:
        inner = rng.choice([lambda: words(3, 18), lambda: tag("p", prose()), lambda: f'<a href="/x">{words(3, 10)}</a>'])()
        return tag(rng.choice(["div", "div", "aside", "section"]), inner, rng.choice(["ad", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo"]))

    def sidebar() -> str:
        inner = "".join(tag("h3", words(1, 4)) + rng.choice([links(4), tag("p", prose())]) for _ in range(rng.randint(1, 2)))
        return rng.choice([lambda: tag("aside", inner), lambda: tag("div", inner, rng.choice(["sidebar", "related", "widget", "side"]))])()

    def notice() -> str:
        return tag(rng.choice(["div", "section"]), tag("p", prose()) if rng.random() < 0.6 else words(4, 20), rng.choice(["cookie", "notice", "alert", "newsletter", "consent", "popup", "subscribe", "share", "social", "disclaimer"]))

    def form() -> str:
        return "<form>" + "".join(rng.choice([f"<label>{words(1, 3)}</label><input>", f"<button>{words(1, 2)}</button>", tag("p", words(3, 12)), f"<select><option>{words(1, 2)}</option><option>{words(1, 2)}</option></select>"]) for _ in range(rng.randint(1, 4))) + "</form>"

    def comments() -> str:
        one = lambda: tag(rng.choice(["div", "li", "article"]), tag("b", word()) + tag("p", prose()), rng.choice(["comment", "reply", "comment", "user-comment"]))
        return tag(rng.choice(["section", "div", "ol"]), (tag("h2", words(1, 2)) if rng.random() < 0.5 else "") + "".join(one() for _ in range(rng.randint(1, 5))), rng.choice(["comments", "responses", "discussion", "comments"]))

    def main() -> list[str]:
        out = [tag("h1", words(2, 12), main=True)] if rng.random() < 0.9 else []
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            kind = rng.random()
            if kind < 0.62:
                out.append(tag("p", prose(), main=True))
            elif kind < 0.72:
                out.append(f"<p {MARK}><b>{prose()}<br>")
            elif kind < 0.78:
                out.append(tag(rng.choice(["h2", "h3", "h4"]), words(1, 7), main=True))
            elif kind < 0.84:
                out.append(tag(rng.choice(["ul", "ol"]), "".join(tag("li", words(2, 14), main=True) for _ in range(rng.randint(1, 4)))))
            elif kind < 0.88:
                out.append(rng.choice([tag("blockquote", prose(), main=True), tag("blockquote", tag("p", prose(), main=True)), tag("pre", words(3, 20), main=True)]))
            elif kind < 0.92:
                out.append("<table>" + "".join("<tr>" + "".join(tag("td", words(1, 4), main=True) for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.96:
                out.append(tag("p", f'{words(2, 8)} <a href="/a">{words(1, 4)}</a> {words(1, 8)}', main=True))
            else:
                out.append(tag("div", prose(), main=True))
            if rng.random() < 0.08:
                out.append(rng.choice([advert, notice, sidebar, form])())
        return out

    def article() -> str:
        inner = main()
        if rng.random() < 0.15:
            inner.append(comments())
        if rng.random() < 0.2:
            inner = ["<section>", *inner, "</section>"] if rng.random() < 0.5 else [tag("div", "".join(inner), rng.choice(["content", "body", "text"]))]
        return rng.choice([
            lambda: tag("article", "".join(inner)), lambda: tag("article", "".join(inner)), lambda: tag("main", "".join(inner)), lambda: tag("main", tag("article", "".join(inner))),
            lambda: tag("div", "".join(inner), rng.choice(["content", "post", "entry", "article-body", "story", "main"])),
        ])()

    some = lambda *makers: "".join(rng.choice(makers)() for _ in range(rng.choice([0, 1, 1, 2])))
    body = (header() if rng.random() < 0.4 else "") + (menu() if rng.random() < 0.8 else "") + some(advert, notice, form, sidebar)
    body += article() + some(comments, sidebar, advert, form, notice) + (footer() if rng.random() < 0.9 else "")
    # words on outer tags tell nothing: some name what the page is without
    outer = ["wrap", "container", "page", "row", "", "no-sidebar", "single ad-free", "widget-area", "comments-open", "has-banner", "nav-below", "logged-in footer-dark", "site", "content-area"]
    while rng.random() < 0.35:
        body = tag(rng.choice(["div", "div", "section", "main"]), body, rng.choice(outer))
    named = lambda: f' class="{rng.choice(outer)}"' if rng.random() < 0.5 else ""
    head = f"<head><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if rng.random() < 0.9 else ""
    return f"<!DOCTYPE html><html{named()}>{head}<body{named()}>{body}</body></html>"


# --- the network ------------------------------------------------------------------------------------------------------


def start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"skip": np.zeros(WIDTH, np.float32), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.1, (WIDTH, 4 * UNITS)).astype(np.float32)
        p["h" + d] = rng.normal(0, 0.2, (UNITS, 4 * UNITS)).astype(np.float32)
        p["c" + d] = np.concatenate([np.zeros(UNITS), np.ones(UNITS), np.zeros(2 * UNITS)]).astype(np.float32)
        p["o" + d] = rng.normal(0, 0.3, UNITS).astype(np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(p: dict[str, np.ndarray], d: str, gates: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, page, unit) in one direction. Padding leaves the state as it is."""
    n = UNITS
    h = c = np.zeros((gates.shape[1], n), gates.dtype)
    out, kept = np.zeros((*gates.shape[:2], n), gates.dtype), []
    steps = range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1)
    for t in steps:
        a = gates[t] + h @ p["h" + d]
        s = _sigmoid(a[:, : 3 * n])
        i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(a[:, 3 * n :])
        m = mask[t][:, None]
        before_h, before_c = h, c
        new_c = f * c + i * g
        th = np.tanh(new_c)
        h, c = np.where(m, o * th, h), np.where(m, new_c, c)
        out[t] = h
        if keep:
            kept.append((t, i, f, o, g, th, before_h, before_c, m))
    return out, kept


def forward(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits (time, page) of padded pages x (time, page, feature)."""
    logit = x @ p["skip"] + p["bias"]
    states = {}
    for d in "fb":
        states[d] = _run(p, d, x @ p["x" + d] + p["c" + d], mask, keep)
        logit = logit + states[d][0] @ p["o" + d]
    return (logit, states) if keep else logit


def backward(p: dict[str, np.ndarray], x: np.ndarray, states: dict, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    g = {"skip": np.einsum("tb,tbw->w", dlogit, x), "bias": dlogit.sum(keepdims=True).reshape(1)}
    n = UNITS
    for d in "fb":
        out, kept = states[d]
        g["o" + d] = np.einsum("tb,tbu->u", dlogit, out)
        dh = dc = np.zeros(out.shape[1:], np.float32)
        dgates, g["h" + d] = np.zeros((*out.shape[:2], 4 * n), np.float32), np.zeros_like(p["h" + d])
        for t, i, f, o, gg, th, before_h, before_c, m in reversed(kept):
            dh = dh + dlogit[t][:, None] * p["o" + d]
            own_h, own_c = dh * m, dc * m
            dcell = own_c + own_h * o * (1 - th * th)
            da = np.concatenate([dcell * gg * i * (1 - i), dcell * before_c * f * (1 - f), own_h * th * o * (1 - o), dcell * i * (1 - gg * gg)], 1)
            dgates[t] = da
            g["h" + d] += before_h.T @ da
            dh = da @ p["h" + d].T + dh * ~m
            dc = dcell * f + dc * ~m
        g["c" + d] = dgates.sum((0, 1))
        g["x" + d] = x.reshape(-1, x.shape[2]).T @ dgates.reshape(-1, 4 * n)
    return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, pages))
    x, mask = np.zeros((most, len(pages), WIDTH), np.float32), np.zeros((most, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, True
    return x, mask


@functools.cache
def train(pages: int = 600, epochs: int = 8, batch: int = 20, rate: float = 0.02, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights after Adam on the blocks of generated pages."""
    rng = random.Random(seed)
    made = [b for b in (blocks(training_page(rng)) for _ in range(pages)) if b]
    data = [(vectors(b), np.array([x[3] for x in b], np.float32)) for b in made]
    data.sort(key=lambda x: len(x[0]))
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    p, order, t = start(seed), np.random.default_rng(seed), 0
    m, v = {k: 0 for k in p}, {k: 0 for k in p}
    for epoch in range(epochs):
        for k in order.permutation(len(groups)):
            x, mask = padded([d[0] for d in groups[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, own) in enumerate(groups[k]):
                y[: len(own), j] = own
            logit, states = forward(p, x, mask, keep=True)
            d = ((_sigmoid(logit) - y) * mask / mask.sum()).astype(np.float32)
            t += 1
            for name, grad in backward(p, x, states, d).items():
                grad = grad + 1e-5 * p[name]
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.99 * v[name] + 0.01 * grad * grad
                p[name] = (p[name] - rate * (1 - 0.9 * epoch / epochs) * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return p


def label(p: dict[str, np.ndarray], pages: list[np.ndarray], most: int = 4000) -> list[np.ndarray]:
    """For each page (vectors), which of its blocks are main text. Pages of like length run together, `most` blocks at once
    (or one page). Sums are in double precision and rounded, so what a page runs with does not change its labels."""
    p = {k: x.astype(np.float64) for k, x in p.items()}
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    group: list[int] = []

    def run() -> None:
        x, mask = padded([pages[k] for k in group])
        logit = forward(p, x.astype(np.float64), mask)
        for j, k in enumerate(group):
            out[k] = np.round(logit[: len(pages[k]), j], 9) > 0

    for k in sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k])):
        if group and len(pages[k]) * (len(group) + 1) > most:
            run()
            group = []
        group.append(k)
    if group:
        run()
    return out


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    small_batches(pages.sparkSession)
    weights = weights or train()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 20):
            found = [blocks(h) for h in batch["html"].to_pylist()]
            kept = label(weights, [vectors(b) for b in found])
            texts = ["\n".join(b[0] for b, k in zip(bs, keep.tolist(), strict=True) if k) for bs, keep in zip(found, kept, strict=True)]
            yield pa.record_batch({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return source.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
