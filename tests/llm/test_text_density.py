from __future__ import annotations

import math
import random
import time

from splitforge.llm import text_density as D

from .helpers import saved

BODY = "The river rose in the night and the town woke to water in the lower streets. " * 3


def page(main: str) -> str:
    return f"""<!doctype html><html><head><title>T</title><style>p {{ color: red }}</style><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site</h1><nav><a href=/>Home</a> <a href=/a>About</a></nav></header>
<div id="sidebar"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>
{main}
<div class="advert">Buy now</div><form><input value=x><button>Send</button></form>
<section class="comments"><p>First! I am a reader and I comment at length on what I have just read here.</p></section>
<div class="cookie-notice">We use cookies</div><footer>All rights</footer></body></html>"""


def test_article_without_clutter():
    text = D.main_text(page(f"<article><h1>Flood &amp; rain</h1><p>{BODY}</p>\n<p>It   was\n  <b>cold</b>&nbsp;then.<br>And &#233;t&eacute;.</p><ul><li>one<li>two</ul></article>"))
    assert text.split("\n") == ["Flood & rain", BODY.strip(), "It was cold then. And été.", "one", "two"]


def test_density_finds_the_body_without_article():
    text = D.main_text(page(f"<div><div class=c><p>{BODY}</p><p>{BODY}</p></div></div>"))
    assert text == f"{BODY.strip()}\n{BODY.strip()}"


def test_text_in_sibling_containers_is_all_kept():
    lead = [f"{x}: rain fell for nine days on the upper valley, and then it stopped for one." for x in ("First", "Second", "Third")]
    body = [f"{x}: by noon the bridge had gone and the lower mill stood in four feet of water." for x in ("Fourth", "Fifth", "Sixth", "Seventh", "Eighth")]
    a, b = ("".join(f"<p>{t}</p>" for t in part) for part in (lead, body))
    box = "<div class=box><a href=1>Maps</a> <a href=2>Photos</a></div>"
    want = "\n".join(lead + body)
    links = "<ul>" + "".join(f"<li><a href={k}>Story number {k}</a>" for k in range(8)) + "</ul>"
    assert D.main_text(page(f"<div class=part>{a}</div>{box}<div class=part>{b}</div>")) == want
    assert D.main_text(page(f"<div class=lead>{a}</div><div class=body>{b}</div>{links}")) == want


def test_clutter_marks_do_not_drop_the_main_text():
    text = BODY.strip()
    article = f"<article><p>{BODY}</p></article>"
    for wrap in ("<div class='content-sidebar-wrap'>", "<div class='layout has-sidebar'>", "<div class=sidebar>", "<form>", "<div style='display:none'>"):
        end = f"</{wrap[1:5].rstrip('>').strip()}>"
        assert D.main_text(page(f"{wrap}{article}<div class=sidebar>Aside</div>{end}")) == text
    inside = f"<article><h2 id='search-results'>Results</h2><p>{BODY}</p><section id='related-work'><p>{BODY}</p></section><div id='sharing-data'>Data</div><div class='share-social'>Share</div></article>"
    assert D.main_text(page(inside)) == f"Results\n{text}\n{text}\nData"
    assert D.main_text(f"<body><form><nav><a href=/>Home</a></nav><div><p>{BODY}</p><p>{BODY}</p></div></form></body>") == f"{text}\n{text}"
    assert D.main_text(f"<main><form><p>{BODY}</p></form></main>") == text
    assert D.main_text(page(f"<article><p>{BODY}</p></article><section class=comments><article><p>{BODY * 3}</p></article></section>")) == text


def test_a_head_may_stay_open():
    for start in ("<body>", "<p>", "<div>"):
        assert D.main_text(f"<html><head><meta charset=utf-8><title>T</title><style>p {{}}</style>{start}{BODY}") == BODY.strip()
    assert D.main_text(f"<head><title>T</title>{BODY}") == BODY.strip()


def test_broken_and_empty_pages():
    assert D.main_text("") == D.main_text("   \n") == ""
    assert D.main_text("plain text only") == "plain text only"
    assert D.main_text(f"<p>{BODY}<p>{BODY}</div></b>") == f"{BODY.strip()}\n{BODY.strip()}"
    assert D.main_text("<script>alert(1)") == ""
    assert "<" not in D.main_text(f"<div <p>{BODY}</p>")
    deep = "<div>" * 3000 + BODY + "</div>" * 3000
    assert D.main_text(deep) == BODY.strip()


def brute(tree) -> str:
    """The text by densities that are counted anew for every element, from their definition."""
    n = len(tree.parent)
    phrase = [i > 0 and tree.tag[i] in D._PHRASE for i in range(n)]
    under = [[j for j in range(n) if not tree.dropped[j] and i in chain(tree, j)] for i in range(n)]
    size = lambda nodes, link: sum(len("".join(p[1].split())) for p in tree.pieces if p and p[0] in nodes and (not link or any(tree.tag[k] == "a" for k in chain(tree, p[0]))))
    body = next((i for i in range(n) if tree.tag[i] == "body" and size(set(under[i]), False)), 0)
    chars, links = ([size(set(u), link) for u in under] for link in (False, True))
    if not chars[body]:
        return ""
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if phrase[i] or tree.dropped[i] or not chars[i]:
            continue
        tags = max(sum(j != i and not phrase[j] for j in under[i]), 1)
        link_tags = max(sum(j != i and tree.tag[j] == "a" for j in under[i]), 1)
        share = links[body] / chars[body]
        base = math.log(chars[i] / max(chars[i] - links[i], 1) * max(links[i], 0) + share * chars[i] + math.e) + math.e - 1
        density[i] = chars[i] / tags * math.log(max(chars[i] / max(links[i], 1) * tags / link_tags, 1.0)) / math.log(base)
    for i in range(n):
        def above(j):  # the nearest element that is no phrase
            j = tree.parent[j]
            return j if j < 0 or not phrase[j] or j == i else above(j)
        children = [j for j in under[i] if j != i and not phrase[j] and above(j) == i]
        total[i] = sum(density[j] for j in reversed(children)) or density[i]
    best = lambda i: max(under[i], key=lambda j: (round(total[j], 9), -len(chain(tree, j)), -j))
    core = best(body)
    path = [k for k in chain(tree, core) if body in chain(tree, k) and not phrase[k]]
    threshold = min([density[k] for k in path] or [0.0])
    marked, todo = set(), [body]
    while todo:
        i = todo.pop()
        if i in marked or tree.dropped[i] or not chars[i] or density[i] < threshold - 1e-12 and not phrase[i]:
            continue
        marked |= {j for j in range(n) if best(i) in chain(tree, j)}
        todo += [j for j in range(n) if tree.parent[j] == i]
    return render(tree, lambda k: k in marked and not tree.dropped[k])


def chain(tree, j: int) -> list[int]:
    out = []
    while j >= 0:
        out.append(j)
        j = tree.parent[j]
    return out


def render(tree, stays) -> str:
    lines, now = [], ""
    for piece in [*tree.pieces, None]:
        if piece is None:
            lines.append(" ".join(now.split()))
            now = ""
        elif stays(piece[0]):
            now += piece[1]
    return "\n".join(x for x in lines if x)


def test_density_equals_brute_force_and_decides():
    rng, changed = random.Random(8), 0
    for _ in range(60):
        text = lambda n: " ".join(rng.choice(["rain", "fell", "over", "the", "town"]) for _ in range(rng.randrange(1, n)))

        def part(depth: int) -> str:
            kind = rng.randrange(6)
            if kind < 2 or not depth:
                return f"<p>{text(40)} <b>{text(6)}</b></p>"
            if kind == 2:
                return "<ul>" + "".join(f"<li><a href=x>{text(4)}</a>" for _ in range(rng.randrange(1, 6))) + "</ul>"
            if kind == 3:
                return f"<div class=sidebar>{text(9)}</div><span>{text(5)}</span>"
            return "<div>" + "".join(part(depth - 1) for _ in range(rng.randrange(1, 5))) + "</div>"

        page = "<body>" + "".join(part(3) for _ in range(rng.randrange(1, 6))) + "</body>"
        tree = D._Tree(page)
        got = D.main_text(page)
        assert got == brute(tree)
        changed += got != render(tree, lambda k: not tree.dropped[k])
    assert changed > 20  # the density is what decides these pages


def test_related_work_and_phrases_stay():
    for inner in (f"<h1>Short</h1><p><b>{BODY}<br></b></p>", f"<h2>On</h2><p>{BODY}</p><div class='related-work'><p>{BODY}</p></div>", f"<p>{BODY}</p><p>Yes.</p><p><i>No.</i></p>"):
        want = render(D._Tree(f"<body>{inner}</body>"), lambda k: True)
        assert D.main_text(page(f"<article>{inner}</article>")) == D.main_text(page(f"<div class=text>{inner}</div>")) == want


def test_headlines_before_the_core_stay():
    body = "".join(f"<p>{BODY}</p>" for _ in range(5))
    want = "\n".join(["Head line"] + [BODY.strip()] * 5)
    assert D.main_text(f"<body><h1>Head line</h1><div>{body}</div></body>") == want
    assert D.main_text(f"<body><div><h2>Head <b>line</b></h2><div><div>{body}</div></div></div></body>") == want
    assert D.main_text(page(f"<div><h1>Head line</h1><div class=text>{body}</div></div>")) == want
    linked = f"<body><h1><a href=/>Site name</a></h1><div>{body}</div></body>"
    beside = f"<body><div class=x><h3>More</h3><a href=1>One</a> <a href=2>Two</a></div><h1>Head line</h1><div>{body}</div></body>"
    assert D.main_text(linked) == "\n".join([BODY.strip()] * 5)
    assert D.main_text(beside) == want
    assert D.main_text("<h1>" * 50_000 + BODY) == BODY.strip()


def test_related_parts_of_an_article_go_only_as_links():
    prose = f"<article><p>{BODY}</p><div class='related'><p>{BODY}</p> <a href=1>more</a></div></article>"
    links = f"<article><p>{BODY}</p><div class='related'><h3>More</h3><ul><li><a href=1>One other story</a><li><a href=2>Two other stories</a></ul></div></article>"
    assert D.main_text(page(prose)) == f"{BODY.strip()}\n{BODY.strip()}\nmore"
    assert D.main_text(page(links)) == BODY.strip()
    for name in ("related share", "related-comments", "recommended hidden' hidden='"):
        assert D.main_text(page(f"<article><p>{BODY}</p><div class='{name}'><p>{BODY}</p></div></article>")) == BODY.strip()
    assert D.main_text(page(f"<article><p>{BODY}</p></article><div class=related><p>{BODY}</p></div>")) == BODY.strip()


def test_long_and_deep_pages_take_linear_time():
    n = 100_000
    began = time.time()
    assert D.main_text("<div class=x id='y'>" * n + BODY + "</div>" * n) == BODY.strip()
    assert D.main_text("<span class=x>" * n + BODY) == BODY.strip()
    assert D.main_text("<h1 class=x>" * n + BODY + "</em>" * n) == BODY.strip()
    assert D.main_text(f"<p>{BODY}</p>" + "<a " * n) == f"{BODY.strip()}\n" + " ".join(["<a"] * n)
    assert D.main_text(f"<p>{BODY}</p><!-- " + "<a " * n) == BODY.strip()
    assert len(D.main_text(f"<article>{f'<p>{BODY}</p>' * 20_000}</article>").split("\n")) == 20_000
    assert time.time() - began < 60


def test_query(spark, tmp_path):
    rows = [(1, "u", page(f"<article><p>{BODY}</p></article>"), 5), (2, None, None, None), (None, "u", "", 1), (1, "u", page(f"<article><p>{BODY}</p></article>"), 5), (3, "u", f"<main><p>{BODY * 2000}</p></main>", 1)]
    schema = "page_id long, url string, html string, text int"
    saved(spark.createDataFrame(rows, schema), str(tmp_path), "pages")
    got = sorted((tuple(r) for r in D.op9_text_density(spark, str(tmp_path)).collect()), key=str)
    long = (BODY * 2000).strip()
    assert got == sorted([(1, "u", BODY.strip(), len(BODY.strip()))] * 2 + [(2, None, "", 0), (None, "u", "", 0), (3, "u", long, len(long))], key=str)
    saved(spark.createDataFrame([], schema), str(tmp_path), "pages")
    assert D.op9_text_density(spark, str(tmp_path)).count() == 0
