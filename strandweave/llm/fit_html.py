"""Fits the weights of `html_extract`: logistic regression over blocks of made-up page layouts.

A layout is drawn part by part: menus, headers, adverts, notices, sidebars, forms, comments and footers around an
article, each with landmark tags, telling names, or neither. Every text starts with a word that says which it is and that
no feature looks at. `python -m strandweave.llm.fit_html` prints the weights.
"""

from __future__ import annotations

import random

import numpy as np

from strandweave.llm.html_extract import FEATURES, features, parse

CONTENT, BESIDE = "qcontent", "qbeside"
_BESIDE = {
    "ad": ("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner-top"), "notice": ("cookie-notice", "consent", "gdpr-banner", "notice", "popup"),
    "side": ("sidebar", "widget", "related", "popular", "sidebar-inner", "trending"), "comments": ("comments", "comment-list", "user-thread", "discussion", "replies", "reader-comments", "disqus"),
    "head": ("header", "masthead", "topbar", "site-header"), "foot": ("footer", "site-footer", "footer-widgets"), "social": ("share", "social", "sharing-buttons", "tags"),
}
_ARTICLE = ("post", "entry-content", "story", "article-body", "main", "post has-sidebar", "share-story", "post tags-news", "text", "content with-comments", "story no-sidebar")


class Layouts:
    """A stream of pages."""

    def __init__(self, seed: int = 1):
        self.r = random.Random(seed)

    def text(self, kind: str, low: int, high: int, stop: float = 0.9) -> str:
        n, out = self.r.randint(low, high), [kind]
        while len(out) < n + 1:
            out += ["".join(self.r.choice("abcdeinorst") for _ in range(self.r.randint(2, 9))) for _ in range(min(n + 1 - len(out), self.r.randint(4, 14)))]
            if self.r.random() < stop:
                out[-1] += self.r.choice(".,.?")
        return " ".join(out)

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{self.text(BESIDE, 1, 5, 0)}</a></{tag}>' for _ in range(n))

    def wrap(self, inside: str, tags: tuple[str, ...], names: tuple[str, ...], named: float) -> str:
        tag = self.r.choice(tags) if self.r.random() < 0.5 else "div"
        name = f' {self.r.choice(("class", "id"))}="{self.r.choice(names)}"' if self.r.random() < named else ""
        return f"<{tag}{name}>{inside}</{tag}>"

    def beside(self, part: str, named: float) -> str:
        r, names = self.r, _BESIDE.get(part, ())
        if part == "nav":
            return self.wrap("<ul>" + self.links(r.randint(2, 9)) + "</ul>", ("nav", "menu"), ("nav", "menu", "navbar", "main-navigation", "breadcrumbs"), named)
        if part == "comments":
            inner = "".join(f"<{t}>{self.text(BESIDE, 2, 60)}</{t}>" for t in r.choices(("p", "div", "li"), k=r.randint(1, 6)))
            return self.wrap(inner, ("section", "div", "aside"), names, 1.0)  # nothing else tells them from an article
        if part == "form":
            return f"<form>{self.text(BESIDE, 1, 12)}<input><button>{self.text(BESIDE, 1, 2, 0)}</button></form>"
        if part == "foot":
            t = r.choice(("p", "div", "span", "span"))
            return self.wrap(f"<{t}>&copy; {self.text(BESIDE, 2, 40, 0.6)}</{t}>" + (self.links(r.randint(0, 5)) if r.random() < 0.5 else ""), ("footer",), names, named)
        if part == "head":
            t = r.choice(("p", "div", "span", "h2"))
            return self.wrap(f"<{t}>{self.text(BESIDE, 1, 8, 0.3)}</{t}>", ("header",), names, named)
        if part == "side":
            return self.wrap((f"<h3>{self.text(BESIDE, 1, 4, 0)}</h3>" if r.random() < 0.5 else "") + (self.links(r.randint(1, 6)) if r.random() < 0.6 else f"<p>{self.text(BESIDE, 3, 40)}</p>"), ("aside",), names, max(named, 0.7))
        if part == "social":
            return self.wrap(self.links(r.randint(1, 5), r.choice(("li", "span"))), ("div",), names, named)
        inside = self.text(BESIDE, 2, 50)  # adverts and notices
        return self.wrap(f"<p>{inside}</p>" if r.random() < 0.5 else inside, ("div", "section"), names, 0.95)

    def article(self, named: float, marked: float) -> str:
        r, out = self.r, []
        plain = "p" if r.random() < 0.75 else "div"
        if r.random() < 0.9:
            h = f"<h1>{self.text(CONTENT, 2, 12, 0.3)}</h1>"
            out.append(f"<header>{h}</header>" if r.random() < 0.2 else h)
        tiny = r.random() < 0.2
        for _ in range(r.randint(1, 2 if tiny else 12)):
            kind = r.random() * (0.7 if tiny else 1)
            if kind < 0.7:
                out.append(f"<{plain}>{self.text(CONTENT, 1, 6 if tiny else 90)}</{plain}>")
            elif kind < 0.78:
                out.append(f"<h2>{self.text(CONTENT, 1, 7, 0.1)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.text(CONTENT, 2, 25, 0.6)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{self.text(CONTENT, 4, 40)}</blockquote>")
            elif kind < 0.96:
                out.append(f'<p>{self.text(CONTENT, 3, 40)} <a href="/y">more</a> {self.text("and", 3, 30)}</p>')
            else:
                out.append(self.beside(r.choice(("ad", "social", "side")), 1.0))
        inside = "".join(out) + (self.beside("comments", 1.0) if r.random() < 0.15 else "")
        tag = r.choice(("article", "main", "article")) if r.random() < marked else "div"
        name = f' class="{r.choice(_ARTICLE)}"' if r.random() < named else ""
        return f"<{tag}{name}>{inside}</{tag}>"

    def page(self) -> str:
        r = self.r
        named, marked = r.choice((0.0, 0.5, 1.0)), r.choice((0.0, 0.5, 1.0))
        before = [p for p in ("head", "nav", "notice", "ad", "social") if r.random() < 0.5]
        after = [p for p in ("side", "ad", "comments", "form", "nav", "notice", "foot", "social") if r.random() < 0.45]
        parts = [*(self.beside(p, named) for p in before), self.article(named, marked), *(self.beside(p, named) for p in after)]
        return f"<html><head><title>{self.text(BESIDE, 2, 8, 0)}</title></head><body>{''.join(parts)}</body></html>"


def samples(pages: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: content) of the blocks of that many layouts."""
    made, xs, ys = Layouts(seed), [], []
    for _ in range(pages):
        parsed = parse(made.page())
        xs.append(features(parsed))
        ys += [CONTENT in b.text for b in parsed.blocks]
    return np.concatenate(xs), np.array(ys, float)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + l2 * w)
    return w


def main() -> None:
    x, y = samples(4000)
    print([round(v, 2) for v in fit(x, y).tolist()], dict(zip(FEATURES, fit(x, y).round(2).tolist(), strict=True)))


if __name__ == "__main__":
    main()
