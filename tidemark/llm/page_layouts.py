"""Seeded pages of many layouts, on which the content classifier is trained: main text carries a mark in every chunk."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MARK = ""
_PARTS = "an be con der el fra gen hin il jo ka lo mi nor or pe qui ra se ti un ver wo xi ya zu th st ly".split()


class Layouts:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.pool = ["".join(self.rng.choice(_PARTS, int(k))) for k in self.rng.integers(1, 5, 3000)]

    def one(self, *options: str) -> str:
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        return " ".join([self.pool[i] for i in self.rng.integers(len(self.pool), size=n).tolist()])

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(int(self.rng.integers(low, high + 1))):
            text = self.words(2, 18)
            if self.chance(0.3):
                text = text.replace(" ", ", ", 1)
            out.append(text.capitalize() + self.one(".", ".", ".", "!", "?"))
        text = " ".join(out)
        return text.replace(" ", self.one("&amp;&amp; ", "### ", "*** "), 9) if self.chance(0.05) else text

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(int(self.rng.integers(low, high + 1)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else " | ".join(items)

    def wrap(self, inner: str, tags: tuple[str, ...], tokens: tuple[str, ...], bare: float = 0.1) -> str:
        tag = self.one(*tags)
        token = self.one(*tokens)
        token = token if self.chance(0.7) else f"{self.one('site', 'c', 'block', 'x1', 'module')}{self.one('-', '_')}{token}"
        attribute = "" if (tag != "div" and self.chance(0.5)) or self.chance(bare) else f' {self.one("class", "class", "id")}="{token}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def header(self) -> str:
        named = self.chance(0.25)
        inner = f"<h1>{self.words(1, 3)}</h1>" if named else self.one(f"<div>{self.words(1, 3)}</div>", f'<a href="/">{self.words(1, 3)}</a>')
        inner += f"<p>{self.words(2, 6)}</p>" if self.chance(0.5) else ""
        return self.wrap(inner + (self.search() if self.chance(0.3) else "") + (self.menu() if self.chance(0.3) else ""), ("header", "div"), ("header", "masthead", "topbar", "top", "site-header"), 0.0 if named else 0.1)

    def menu(self) -> str:
        return self.wrap(self.links(3, 9), ("nav", "div", "ul"), ("nav", "menu", "navigation", "navbar", "breadcrumb"))

    def search(self) -> str:
        choice = "<select>" + "".join(f"<option>{self.words(1, 2)}</option>" for _ in range(4)) + "</select>" if self.chance(0.3) else ""
        return f'<form action="/s"><label>{self.words(1, 2)}</label>{choice}<input name="q"><button>{self.words(1, 2)}</button></form>'

    def unseen(self) -> str:
        return self.one(f"<noscript><p>{self.sentences(1, 2)}</p></noscript>", f"<template><div>{self.sentences(1, 2)}</div></template>", f"<svg><title>x</title><text>{self.words(1, 3)}</text></svg>")

    def form(self) -> str:
        inner = f"<p>{self.sentences(1, 2)}</p><label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button>"
        return f"<form>{inner}</form>" if self.chance(0.5) else self.wrap(inner, ("div", "section"), ("newsletter", "subscribe", "signup", "contact-form", "login"), 0)

    def advert(self) -> str:
        inner = self.one(self.sentences(1, 2), f'<a href="/x">{self.sentences(1, 1)}</a>', f"<p>{self.sentences(1, 3)}</p>", f"<h3>{self.words(1, 4)}</h3><p>{self.sentences(1, 2)}</p>")
        return self.wrap(inner, ("div", "div", "aside", "section"), ("ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot"), 0)

    def notice(self) -> str:
        return self.wrap(self.one(f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 2)) + (f"<button>{self.words(1, 1)}</button>" if self.chance(0.5) else ""), ("div", "div", "section", "dialog"), ("cookie-notice", "notice", "alert", "consent", "popup", "warning", "paywall"), 0)

    def sidebar(self) -> str:
        inner = "".join(f"<h3>{self.words(1, 3)}</h3>{self.one(self.links(2, 7), f'<p>{self.sentences(1, 3)}</p>')}" for _ in range(int(self.rng.integers(1, 4))))
        return self.wrap(inner, ("aside", "div", "section"), ("sidebar", "widget", "related", "side", "popular", "rail"), 0)

    def share(self) -> str:
        return self.wrap(self.links(2, 5), ("div", "ul"), ("share", "social", "toolbar", "follow"), 0)

    def comments(self) -> str:
        each = []
        for _ in range(int(self.rng.integers(1, 6))):
            inner = self.one(f"<b>{self.words(1, 2)}</b>", f'<span class="author">{self.words(1, 2)}</span>', f"<h4>{self.words(1, 2)}</h4>", "") + f"<p>{self.sentences(1, 5)}</p>"
            each.append(self.wrap(inner, ("div", "li", "article", "section"), ("comment", "comment-body", "reply", "review"), 0.3))
        inner = self.one(f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 3)}</h3>", "") + "".join(each) + (self.form() if self.chance(0.4) else "")
        return self.wrap(inner, ("section", "div", "ol"), ("comments", "responses", "discussion", "comment-list", "disqus", "thread", "reader-comments"), 0)

    def footer(self) -> str:
        inner = self.one("&copy; ", "") + self.sentences(1, 2) + (self.links(2, 6) if self.chance(0.5) else "")
        return self.wrap(inner, ("footer", "div"), ("footer", "site-footer", "copyright", "legal", "bottom"))

    def content(self) -> str:
        m = MARK
        parts = [self.one(*[f"<h1>{m}{self.words(1, 9)}</h1>"] * 4, f"<header><h1>{m}{self.words(2, 9)}</h1></header>", "")]
        if self.chance(0.25):
            parts.append(f"<{(tag := self.one('h2', 'h2', 'h3', 'p'))}>{m}{self.words(2, 9)}</{tag}>")
        if self.chance(0.5):
            lead = self.one(*[f' class="{x}"' for x in ("lead", "intro", "summary", "standfirst", "teaser", "dek")], *[""] * 6)
            parts.append(f"<{(tag := self.one('div', 'div', 'div', 'p'))}{lead}>{m}{self.sentences(1, 2)}</{tag}>")
        if self.chance(0.3):
            parts.append(f"<p><b>{m}{self.sentences(1, 2)}<br>")
        extra: list[Callable[[], str]] = [self.advert, self.share, self.notice, self.form, self.sidebar]
        for _ in range(int(self.rng.choice([1, 2, 4, 8, 14]))):
            parts.append(
                self.one(
                    *[f"<p>{m}{self.sentences(1, 8)}</p>"] * 6, f"<p>{m}{self.sentences(1, 2)}<p>{m}{self.sentences(1, 3)}", f"<h2>{m}{self.words(1, 6)}</h2><p>{m}{self.sentences(2, 5)}</p>",
                    "<ul>" + "".join(f"<li>{m}{self.sentences(1, 1)}</li>" for _ in range(4)) + "</ul>", f"<blockquote><p>{m}{self.sentences(1, 3)}</p></blockquote>", *[f"<div>{m}{self.sentences(1, 3)}</div>"] * 2,
                    f"<table><tr><td>{m}{self.words(1, 3)}</td><td>{m}{self.words(1, 3)}</td></tr></table>", f'<p>{m}{self.sentences(1, 3)} <a href="/y">{m}{self.words(1, 3)}</a> {m}{self.sentences(1, 2)}</p>',
                    f"<figure><figcaption>{m}{self.words(3, 9)}</figcaption></figure>", f"<p>{m}{self.sentences(1, 3)} <math><mi>{m}{self.words(1, 1)}</mi><mo>=</mo><mn>{m}7</mn></math></p>", f"<object><p>{m}{self.sentences(1, 2)}</p></object>",
                )
            )
            if self.chance(0.12):
                parts.append(extra[int(self.rng.integers(len(extra)))]())
        return "".join(parts)

    def page(self) -> str:
        body = self.wrap(self.content(), ("article", "main", "div", "section", "td", "article"), ("content", "post", "article-body", "story", "entry", "main", "page-text"), 0.2)
        if body.startswith("<td"):
            body = f"<table><tr>{self.one('', '<td>' + self.links(3, 6) + '</td>')}{body}</tr></table>"
        if self.chance(0.3):
            body = self.wrap(body + (self.comments() if self.chance(0.3) else "") + (self.sidebar() if self.chance(0.3) else ""), ("main", "div", "div"), ("main", "wrapper", "container", "page", "layout"), 0.3)
        some = lambda p, f: f() if self.chance(p) else ""
        start = self.one(*["<html><head><title>x</title></head><body>"] * 5, "<html><head><title>x</title><link rel=x>", "<title>x</title>")
        return start + some(0.5, self.header) + some(0.7, self.menu) + some(0.15, self.unseen) + some(0.3, self.notice) + some(0.5, self.advert) + some(0.3, self.sidebar) + body + some(0.3, self.share) + some(0.4, self.comments) + some(0.4, self.sidebar) + some(0.2, self.form) + some(0.2, self.advert) + some(0.8, self.footer) + "</body></html>"
