"""Whole extraction of small random pages against a brute-force version over a tree, and hard pages."""

import random
import time
from collections import Counter

import pytest

from evmatch.llm import html

ARTICLE = " ".join(f"word{k}" for k in range(80))
NAMES = ["", "ad", "entry ad-free", "left-sidebar", "comments", "note", "no-sidebar", "widget"]


class Node:
    def __init__(self, tag, name, parts):
        self.tag, self.name, self.parts = tag, name, parts


def grown(rng, deep=0):
    tag = rng.choice(["div", "div", "section", "article", "nav", "p", "span", "aside"] if deep < 4 else ["p", "span"])
    parts = []
    for _ in range(rng.randint(0, 4)):
        parts.append(" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 6))) + " " if rng.random() < 0.5 or deep > 4 or tag == "p" else grown(rng, deep + 1))
    return Node(tag, rng.choice(NAMES), parts)


def written(node):
    inner = "".join(p if isinstance(p, str) else written(p) for p in node.parts)
    return f"<{node.tag}{f' class={chr(34)}{node.name}{chr(34)}' if node.name else ''}>{inner}</{node.tag}>"


def brute(root, weights):
    tokens, path = [], []

    def walk(node):
        path.append(node)
        tokens.append((node.tag, "", tuple(path)))
        for p in node.parts:
            if isinstance(p, str):
                tokens.append(("", p, tuple(path)))
            else:
                walk(p)
        path.pop()
        tokens.append((f"/{node.tag}", "", tuple(path)))

    walk(root)
    words = lambda ts: sum(len(t[1].split()) for t in ts)
    holds = lambda node: words([t for t in tokens if node in t[2]])
    nodes = [t[2][-1] for t in tokens if t[0] and t[0][0] != "/"]
    marked = [n for n in nodes if n.tag == "article"]
    best = max(marked, key=holds, default=None)  # the first of equals
    around = next((t[2] for t in tokens if best and t[2] and t[2][-1] is best), ())

    inner = lambda t: best in t[2] and t[2][-1] is not best
    doubted = lambda n: n.tag in html.APART or n.tag != "article" and any(map(html.against, n.name.split()))
    below = lambda n: n[2][n[2].index(best) + 1 :]
    plain = [k for k, t in enumerate(tokens) if not t[0] and t[1].split() and best in t[2] and not any(map(doubted, below(t)))]

    def within(node):
        if node.tag in html.APART:
            return True
        if node.tag == "article":
            return False
        if any(weights.apart(w, 0) for w in node.name.split()):
            return True
        bad = [html.PART.findall(w) for w in node.name.split() if html.against(w)]
        at = [k for k, t in enumerate(tokens) if not t[0] and t[1].split() and node in t[2]]
        if not bad or node.tag not in html.PARTS or not at and not any(set(p) <= html.APART_NAMES for p in bad):
            return False
        edge = bool(at) and bool(plain) and (at[-1] < plain[0] or at[0] > plain[-1])
        small = holds(node) <= html.SMALL and html.SHARE * holds(node) <= holds(best)
        return any(set(p) <= html.APART_NAMES for p in bad) and (small or edge) or edge and any(set(p) & html.READERS for p in bad)

    def says(node):
        if best and any(inner(t) and t[2][-1] is node for t in tokens if t[2]):
            return within(node)
        if node.tag in html.APART:
            return True
        big = node in around and 2 * holds(node) > words(tokens)
        return node.tag != "article" and not big and any(weights.apart(w) for w in node.name.split())

    away = [any(map(says, t[2])) for t in tokens]
    scores = [weights.score(t[0]) if t[0] else words([t]) * (-1.0 if a else 1.0) for t, a in zip(tokens, away, strict=True)]
    runs = [(sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    most = max(s for s, _, _ in runs)
    if most <= 1e-9:
        return ""
    _, lo, hi = next((s, a, b) for s, a, b in sorted(runs, key=lambda r: (-r[2], r[1])) if s > most - 1e-9)
    inside = [t[2] for t, a in zip(tokens[lo:hi], away[lo:hi], strict=True) if not t[0] and not a]
    if not inside:
        return ""
    common = [n for n in inside[0] if all(n in p for p in inside)]
    whole = common[-1] if common else None
    articles = [k for k, n in enumerate(common) if n.tag == "article"]
    for node in common[articles[-1] if articles else 0 :][::-1]:
        whole = node if weights.content(node.tag, tuple(node.name.split())) else whole
    held = [k for k, t in enumerate(tokens) if whole in t[2]]
    lo, hi = min(lo, held[0]), max(hi, held[-1] + 1)
    text = "".join(("\n" if t[0].lstrip("/") in html.BLOCK else "") if t[0] else "" if a else t[1] for t, a in zip(tokens[lo:hi], away[lo:hi], strict=True))
    return "\n".join(" ".join(b.split()) for b in text.split("\n") if b.strip())


@pytest.mark.parametrize("taught", [{}, {("div", True): 5, ("div", False): 50, ("p", True): 90, ("p", False): 2, (".note", False): 400, (".widget", True): 500}])
def test_small_pages_against_brute_force(taught):
    rng, weights, seen = random.Random(7), html.Weights(taught), Counter()
    for _ in range(400):
        root = Node("div", "", [grown(rng) for _ in range(rng.randint(1, 3))])
        page = written(root)
        expected = brute(root, weights)
        assert html.main_text(page, weights) == expected, page
        seen[bool(expected)] += 1
    assert min(seen.values()) > 20


@pytest.mark.parametrize("name", ["no-sidebar", "single has-sidebar", "entry ad-free", "post comments-open", "post share-enabled"])
def test_names_that_speak_of_a_state(name):
    for tag in ("body", "article", "div"):
        page = f"<{tag} class='{name}'><h1>One</h1><p>{ARTICLE}</p></{tag}><div id='comments'><p>{ARTICLE} {ARTICLE}</p></div>"
        assert html.main_text(page, html.Weights({})) == f"One\n{ARTICLE}"


def test_controls_and_formulas_inside_an_article_stay():
    page = f"<article><p>{ARTICLE}</p><p><button>press</button> <label>here</label> <math><mi>x</mi></math></p><form><label>no</label></form></article>"
    assert html.main_text(page, html.Weights({})) == f"{ARTICLE}\npress here x"


def test_a_part_behind_many_tags_stays():
    links = "".join(f"<li><a href='/{k}'>n{k}</a></li>" for k in range(300))
    page = f"<body><nav><a>x</a></nav><article><p>{ARTICLE}</p><ul>{links}</ul><p>the end</p></article><footer>f</footer></body>"
    assert html.main_text(page, html.Weights({})).split("\n") == [ARTICLE, *(f"n{k}" for k in range(300)), "the end"]


def test_quotes_that_never_close():
    for page in ('<a title="x>link</a> and <b class="c">more</b>', "<a title='x>link</a> and <b>more</b>", '<a title=" >link</a> and more'):
        assert html.main_text(f"<article><p>{ARTICLE} {page}</p></article>", html.Weights({})) == f"{ARTICLE} link and more"
    assert html.main_text(f"<p>{ARTICLE} <a title='a > b' href=\"c\">d</a></p>", html.Weights({})) == f"{ARTICLE} d"


@pytest.mark.parametrize("piece", ["<div class='a b'>word ", "<svg>word ", '<a title="x>word ', "<a b='word ", "</x><p>w ", "<", "<!", "<a ===", "<!-- <p", "&amp"])
def test_time_grows_with_the_page(piece):
    weights, took = html.Weights({}), []
    for n in (12_500, 100_000):
        began = time.process_time()
        html.main_text(piece * n, weights)
        took.append(time.process_time() - began)
    assert took[1] < max(4, 24 * took[0])


FIRST, LAST = " ".join(f"one{k}" for k in range(60)), " ".join(f"two{k}" for k in range(60))
OWN_PARTS = [
    "<section id='related-work'>{}</section>", "<div class='share-price'>{}</div>", "<section class='search-results'>{}</section>",
    "<div class='skip-list'>{}</div>", "<div class='widget-theory'>{}</div>", "<span class='alert-level'>{}</span>", "<p class='notice'>{}</p>",
    "<menu>{}</menu>", "<dialog open>{}</dialog>", "<object>{}</object>", "<header><h1>{}</h1></header>", "<code><span class='comment'>{}</span></code>",
]


@pytest.mark.parametrize("part", OWN_PARTS)
@pytest.mark.parametrize("text", ["twelve words", "more " * 100])
def test_names_alone_take_nothing_from_an_article(part, text):
    text = " ".join(text.split())
    for page in (f"<p>{FIRST}</p>{part.format(text)}<p>{LAST}</p>", f"<p>{FIRST}</p><p>{LAST}</p>{part.format(text)}", f"{part.format(text)}<p>{FIRST}</p><p>{LAST}</p>"):
        found = html.main_text(f"<nav><a>home</a></nav><article>{page}</article><footer>f</footer>", html.Weights({}))
        assert sorted(found.split()) == sorted(f"{FIRST} {LAST} {text}".split())


@pytest.mark.parametrize(
    "part",
    [
        "<div class='related-posts'><a href='/1'>some other story</a> or <a href='/2'>yet another story</a></div>",
        "<div class='share-bar'>tell your friends <button>now</button></div>",
        "<div class='ad'>buy this thing now</div>",
        "<dialog>closed</dialog>",
        "<menu><li><button>copy</button></li></menu>",
        "<nav>contents</nav>",
        "<form>name <input></form>",
    ],
)
def test_names_with_evidence_are_believed(part):
    page = f"<article><h1>T</h1><p>{FIRST}</p>{part}<p>{LAST}</p></article>"
    assert html.main_text(page, html.Weights({})) == f"T\n{FIRST}\n{LAST}"


def test_readers_comments_at_the_end_of_an_article_go():
    thread = "".join(f"<div class='comment'><p>{'I think so too ' * 30}</p></div>" for _ in range(5))
    for name in ("comments", "comments-area", "comment-list"):
        assert html.main_text(f"<article><p>{FIRST}</p><p>{LAST}</p><section class='{name}'>{thread}</section></article>", html.Weights({})) == f"{FIRST}\n{LAST}"


def test_labelled_articles_teach_a_name_and_its_repeated_texts():
    same = "sign up to read a new story every single day of the week " * 10
    page = lambda k: f"<article><p>{FIRST}</p><div class='promo-box'>{same}</div><section class='related-work'>{f'w{k} ' * 400}</section><p>{LAST}</p></article>"
    counts = Counter()
    for k in range(5):
        counts += html.labelled(page(k))
    weights = html.Weights(counts)
    assert weights.content("section", ("related-work",)) and not weights.apart("related-work")
    assert html.main_text(page(9), weights) == f"{FIRST}\n{'w9 ' * 399}w9\n{LAST}"
