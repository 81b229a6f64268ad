"""Pages made of known text blocks and boilerplate: the text must come back, and nothing else."""

import random

import pytest

from quarry.llm import html_extract

PROSE = {
    "en": "the of and to in that it was for on with as by at from house river light walked small stone garden winter remembered nothing letter window evening".split(),
    "de": "der die und das den von zu mit sich auf ist im nicht eine als Haus Fluss Garten Winter Abend Fenster Brief größer später überall Straße".split(),
    "fr": "le la les de des et en un une du que est pour dans par maison rivière été fenêtre lettre soir jardin hiver première".split(),
    "ru": "дом река свет зима письмо окно вечер сад камень помнил ничего который после улица город утро тихо большой".split(),
    "el": "σπίτι ποτάμι φως χειμώνας γράμμα παράθυρο βράδυ κήπος πέτρα θυμάμαι τίποτα δρόμος πόλη πρωί".split(),
}
JUNK = ["Home", "Sign in", "Buy one get one free", "We use cookies", "Follow us on", "Copyright 2024 Example", "Top stories", "Great post, thanks!"]


def prose(rng, words, n):
    return (" ".join(rng.choice(words) for _ in range(n)) + ".").capitalize()


def boilerplate(rng, words):
    junk = f"{rng.choice(JUNK)} {prose(rng, words, rng.randint(2, 40))}"
    links = "".join(f"<li><a href='/{k}'>{rng.choice(words)} {k}</a>" for k in range(rng.randint(3, 8)))
    return rng.choice(
        [
            f"<nav><ul>{links}</ul></nav>",
            f"<ul class='main-menu'>{links}</ul>",
            f"<aside><p>{junk}</aside>",
            f"<div class='ad-slot'><div><p>{junk}</div></div>",
            f"<div id='cookieConsent' role='alertdialog'>{junk}<button>OK</button></div>",
            f"<form action='/s'><label>{junk}</label><input name=q><select><option>a<option>b</select></form>",
            f"<div hidden><p>{junk}</p></div>",
            f"<div style='display: none'>{junk}</div>",
            f"<script>var s = \"<p>{junk}</p>\";</script><style>p {{ color: red }}</style><!-- {junk} -->",
            f"<p class=share>{junk}",
            f"<section class='related-posts'><article><p>{junk}</p></article></section>",
            f"<svg><title>{junk}</title><path d='M0'/></svg>",
        ]
    )


def block(rng, words):
    """A block of text as markup, and what it reads."""
    text = prose(rng, words, rng.choice([1, 3, 8, 30, 60]))
    kind = rng.randrange(9)
    if kind == 0:
        return f"<h2 id='search'>{text}</h2>", text
    if kind == 1:
        return f"<p>{text}", text
    if kind == 2:
        head, _, rest = text.partition(" ")
        return f"<p>{head} <span hidden>{rng.choice(JUNK)}</span>\n\t <b>{rest}</b></p>", f"{head} {rest}".strip()
    if kind == 3:
        return f"<figure><img src='x.png' alt='a > b'><figcaption>{text}</figcaption></figure>", text
    if kind == 4:
        return f"<p>© &amp; &lt;b&gt; {text}</p>", f"© & <b> {text}"
    if kind == 5:
        return f"<p>{text} <a href='https://example.org/?a=1&b=2'>{text}</a></p>", f"{text} {text}"
    if kind == 6:
        return f"<blockquote class='entry-content'>{text}<br>{text}</blockquote>", f"{text} {text}"
    if kind == 7:
        return f"<div id='tag-3'>{text}</div>", text
    return f"<ul><li>{text}<li>{text}</ul>", f"{text}\n{text}"


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_articles_come_back(lang):
    rng, words = random.Random(lang), PROSE[lang]
    for _ in range(150):
        parts, want = [], []
        for _ in range(rng.randint(1, 12)):
            markup, text = block(rng, words)
            parts.append(markup)
            want.append(text)
            if rng.random() < 0.3:
                parts.append(boilerplate(rng, words))
        comments = f"<section id='comments'><article class='comment'><p>{prose(rng, words, 40)}</p></article></section>"
        tag = rng.choice(["article", "main"])
        body = f"<{tag} class='post has-sidebar'><header><h1>{words[0]}</h1></header>{''.join(parts)}</{tag}>{comments}"
        wrapper = rng.choice(["<div class='layout sidebar-right'>{}</div>", "<form id='aspnet'>{}</form>", "<div class='site-header-wrapper'>{}</div>", "{}", "<table><tr><td>{}</table>"])
        page = f"<html><head><title>{words[1]}</title></head><body class='ads'>{boilerplate(rng, words)}{wrapper.format(body)}{boilerplate(rng, words)}<footer><p>{prose(rng, words, 30)}</footer>"
        assert html_extract.extract(page) == "\n".join([words[0], *want])


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_pages_without_containers(lang):
    """Only density, length, links and neighbours can tell here: paragraphs among menus and notices."""
    rng, words = random.Random(lang), PROSE[lang]
    for _ in range(60):
        want = [prose(rng, words, n) for n in [60, *(rng.choice([4, 30, 60]) for _ in range(5)), 60]]
        menu = "".join(f"<li><a href='/{k}'>{rng.choice(words)}</a></li>" for k in range(6))
        page = f"<div id=top>{'<ul>' + menu + '</ul>'}</div><h1>{words[0]}</h1>" + "".join(f"<p>{t}</p>" for t in want) + f"<div><ul>{menu}</ul></div><p>© {prose(rng, words, 3)}</p>"
        assert html_extract.extract(page) == "\n".join([words[0], *want])


def test_density_decides_inside_an_article():
    long = prose(random.Random(1), PROSE["en"], 60)
    menu = "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(5))
    assert html_extract.extract(f"<article><p>{long}</p><ul>{menu}</ul><p>{long}</p><div class='widget'>{long}</div><p><a href=x>One link</a></p></article>") == f"{long}\n{long}\n{long}\nOne link"
    assert html_extract.extract(f"<article><ul>{menu}</ul><p>short</p><ul>{menu}</ul><p>{long}</p></article>") == long


@pytest.mark.parametrize(
    "source",
    ["<article>" + "<a \"x>" * 40_000, '<p title="x' * 30_000, "<title>" * 30_000, "<" * 60_000, "<div>" * 30_000 + "</b>" * 30_000, "<p><table><td>" + "<div>" * 30_000 + "<span hidden>" * 3000 + "</i>" * 30_000],
)
def test_broken_markup_takes_linear_time(source):
    import time

    began = time.process_time()
    html_extract.extract(source)
    assert time.process_time() - began < 10
