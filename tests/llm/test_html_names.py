"""Class names and ids on ordinary markup do not cost a page its main text."""

import pytest

from setlist.llm import html_main

P, Q = "<p>One text, with commas, and more of it, here.</p>", "<p>A second text, long, with commas, too.</p>"
ONE, TWO = "One text, with commas, and more of it, here.", "A second text, long, with commas, too."


@pytest.mark.parametrize("html, text", [
    (f"<body><div id='page' class='site has-sidebar'><article>{P}{Q}</article></div>", f"{ONE}\n\n{TWO}"),
    (f"<div class='sidebar-layout'><div class='sidebar'><p>side</p></div><article>{P}{Q}</article></div>", f"{ONE}\n\n{TWO}"),
    (f"<article>{P}<section id='search-algorithms'>{Q}</section></article>", f"{ONE}\n\n{TWO}"),
    (f"<article>{P}{P}{P}<section id='social-effects'>{Q}</section></article>", f"{ONE}\n\n{ONE}\n\n{ONE}\n\n{TWO}"),
    (f"<article>{P}<h2 id='related-work'>Related</h2>{Q}</article>", f"{ONE}\n\nRelated\n\n{TWO}"),
    (f"<article><div class='post no-comments'>{P}</div>{Q}</article>", f"{ONE}\n\n{TWO}"),
    (f"<div class='post no-comments category-social'>{P}{Q}</div>", f"{ONE}\n\n{TWO}"),
    # Boilerplate still goes.
    (f"<article>{P}{Q}<div class='related'><p>other</p></div></article>", f"{ONE}\n\n{TWO}"),
    (f"<main><article>{P}{Q}</article><div id='comments' class='comments-area'><article class='comment-body'>{P}{P}{P}{P}</article></div></main>", f"{ONE}\n\n{TWO}"),
    (f"<div class='post'>{P}{Q}<p>By <span class='share'>me</span></p></div><div class='widget'><p>w</p></div>", f"{ONE}\n\n{TWO}\n\nBy me"),
])
def test_names_do_not_drop_main_text(html, text):
    assert html_main.main_text(html) == text


C = "<p>A comment, longer than the article, with many, many commas, and words, and more, and more, and still more of it, too.</p>"


@pytest.mark.parametrize("html", [
    f"<body><div id=story>{P}</div><div class='comments'>{C}{C}{C}</div></body>",
    f"<body><div id=story>{P}</div><div class='sidebar'>{C}{C}{C}</div></body>",
    f"<article>{P}<div class='comments'>{C}{C}{C}</div></article>",
    f"<article>{P}<div class='advert-box'>{C}</div><div id='comments'>{C}{C}</div></article>",
    f"<main>{P}<section id='comment-list'><article>{C}</article><article>{C}</article></section></main>",
    f"<div id='comments'><h1>Comments</h1><article>{C}</article></div><article>{P}</article>",
    f"<div class='content'>{P}</div><ol class='commentlist'><li>{C}</li><li>{C}</li></ol><div class='ad'>{C}</div>",
    f"<div class='content'>{P}</div><div class='promo'>{C}{C}</div><div class='newsletter signup'>{C}{C}{C}</div>",
])
def test_comments_and_sidebars_go_whatever_their_size(html):
    assert html_main.main_text(html) == ONE


@pytest.mark.parametrize("html, text", [
    (f"<div class='modal-page'><h1>Head</h1>{P}{Q}</div>", f"Head\n\n{ONE}\n\n{TWO}"),
    (f"<div class='widget-area'><main>{P}{Q}</main></div>", f"{ONE}\n\n{TWO}"),
    (f"<article>{P}<pre><code>x = 1 <span class='token comment'># why</span></code></pre></article>", f"{ONE}\n\nx = 1 # why"),
    (f"<article>{P}<h2 id='comments'>Comments on it</h2>{Q}</article>", f"{ONE}\n\nComments on it\n\n{TWO}"),
])
def test_wrappers_code_and_headings_stay(html, text):
    assert html_main.main_text(html) == text


# --- a plain scorer: the same rules over a tree of elements, for well-formed pages with p and div only


def plain(tree):
    """Text of (tag, children) trees: children are trees or text; points by the formulas of the method, best container and its siblings."""
    nodes, blocks = [], []

    def walk(tree, parent):
        me = len(nodes)
        nodes.append((tree[0], parent))
        for child in tree[1]:
            if isinstance(child, str):
                blocks.append((me, child))
            else:
                walk(child, me)

    walk(tree, None)
    points = {}
    for node, text in blocks:
        value, above, depth = 1 + text.count(",") + min(len(text) / 100, 3), nodes[node][1], 0
        while above is not None and depth < 5:
            points[above] = points.get(above, 0) + (value if depth == 0 else value / (2 * depth))
            above, depth = nodes[above][1], depth + 1
    best = max(points, key=lambda n: (points[n], -n))
    top, parent = {best}, nodes[best][1]
    if nodes[best][0] != "body":
        top |= {n for n in points if nodes[n][1] == parent and points[n] >= max(1.0, 0.2 * points[best])}
        top |= {n for n, _ in blocks if nodes[n][1] == parent}

    def under(n):
        while n is not None and n not in top:
            n = nodes[n][1]
        return n is not None

    return "\n\n".join(text for n, text in blocks if under(n))


def markup(tree):
    return f"<{tree[0]}>" + "".join(c if isinstance(c, str) else markup(c) for c in tree[1]) + f"</{tree[0]}>"


def test_scoring_against_a_plain_scorer():
    import random

    rng = random.Random(9)

    def paragraph():
        return ("p", [" ".join(rng.choice(["word", "words,", "more", "text,", "again"]) for _ in range(rng.randrange(3, 60)))])

    def box(depth):
        return ("div", [box(depth - 1) if depth and rng.random() < 0.45 else paragraph() for _ in range(rng.randrange(1, 5))])

    for _ in range(400):
        tree = ("body", [box(3) for _ in range(rng.randrange(1, 4))])
        assert html_main.main_text(f"<html>{markup(tree)}</html>") == plain(tree)
