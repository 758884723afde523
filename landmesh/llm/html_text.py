"""HTML extraction: flat text blocks, classified by a decision tree.

A page becomes a list of text blocks. Each has its number of words and its link density (the share
of words inside links), those of the two blocks before and the two after it, whether it or a
neighbour is a heading, and whether it stands inside an element that by the meaning of its tag
holds no main text (navigation, footer, aside, form), or inside one whose class, id or role names
such a part (advert, cookie, sidebar, comment), or after a heading that begins the comments or a
list of other articles. A link counts for all blocks that it goes around. A tree trained on a small
labelled table of pages says which blocks are main text; it becomes a column expression over the
array of blocks.

The labelled table has the pages of LABELLED, written by hand, and `drawn` ones, put together by
rules from parts of pages with random lengths. `accuracy` measures the tree on pages drawn anew.
"""

from __future__ import annotations

import html as html_lib
import random
import re

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from landmesh.llm.common import table

#: Places of the blocks whose words and links a block's features have, from itself.
NEIGHBOURS = (0, -1, -2, 1, 2)
FEATURES = [f"{kind}{k:+d}" for k in NEIGHBOURS for kind in ("words", "links")] + ["heading", "heading_before", "heading_after", "aside", "named"]
#: Drawn pages of the labelled table, and the tree's depth.
DRAWN, DEPTH = 800, 10

#: Elements whose content is no text (fixed values).
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "select", "textarea", "button", "canvas", "audio", "video"}
#: Elements that do not end a block (fixed values).
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rt", "rp"}
#: Elements that hold no main text by the meaning of their tags (fixed values); a header does outside of MAIN only.
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements without content, and those that end where another of their kind begins (fixed values).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ALONE = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
#: Words of class, id and role that name furniture, as a whole and as a beginning (fixed values).
NAMES = {"ad", "ads", "adv", "banner", "notice", "notices", "alert", "consent", "gdpr", "nav", "menu", "footer", "header", "masthead", "share", "sharing", "social", "popular", "trending", "widget", "popup", "modal", "overlay", "pager", "reply", "replies", "respond", "login", "signup", "complementary", "contentinfo", "search", "dialog", "toolbar", "outbrain", "taboola", "disqus", "skip"}
BEGINNINGS = ("advert", "sponsor", "promo", "cookie", "sidebar", "related", "recommend", "teaser", "comment", "discussion", "newsletter", "subscri", "breadcrumb", "navig", "navbar", "paginat", "copyright", "feedback")
#: Words of names that are about the whole page, not about the element (fixed values).
WHOLE = {"has", "with", "no", "without", "wrapper", "container", "page", "layout", "site"}
#: Headings of at most SHORT words that hold one of these begin the comments or other articles (fixed values).
COMMENTS = ("comment", "kommentar", "comentario", "replies", "réponses", "related", "recommended", "advertisement")
SHORT = 4

_NAMED = re.compile(r"""(?:\bclass|\bid|\brole)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"']")
_SKIP_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)" + ("|(?=<body)" if tag in ("head", "title") else ""), re.I) for tag in SKIPPED}

#: Pages whose blocks begin with + (main text) or - (not).
LABELLED = [
    "<body><nav><ul><li><a>-Home</a></li><li><a>-News today</a></li></ul></nav><div class=ad>-Buy the best shoes in town now for less.</div><article><h1>+Council approves the new bridge</h1><p>+The council approved the bridge on Monday after a long debate about its cost and its route.</p><p>+Work starts soon.</p><p>+It</p></article><footer>-&copy; 2020 Daily News, all rights reserved to the owners.</footer></body>",
    "<body><header><a>-Site name</a><p>-Your local paper since the old days</p></header><main><h2>+A short guide</h2><p>+First, read the <a>manual</a> and keep it near you while you work on the engine.</p><ul><li>+Oil</li><li>+A clean cloth and some patience</li></ul></main><aside>-About the author: she has written many guides for this site over the last ten years.</aside></body>",
    "<body><div><a>-Start</a> | <a>About</a> | <a>Contact</a></div><div><p>+The old mill at the river was built by two brothers who came from the south with nothing but their tools.</p><p>+It burned down twice, and each time the village helped to build it again within a single summer.</p></div><div><a>-Imprint</a> <a>Privacy</a></div></body>",
    "<body><div role=navigation><a>-A</a><a>-B</a></div><main><article><h1>+Words</h1><p>+Short.</p><p>+A much longer paragraph that goes on about words and their uses in daily life and in books.</p><aside>-Read our large report about dictionaries in the next issue of the magazine</aside><p>+Last words of the text.</p></article></main></body>",
    "<body><p>-<a>Log in</a></p><h1>+The long way home</h1><p>+He walked for three days through the forest before he saw the lights of the first farm again.</p><p>+Nobody had expected him to come back after so many months without a letter or any other sign.</p><p>-<a>Next</a> <a>Previous</a> <a>Top</a></p></body>",
    "<body><article><h1>+News</h1><p>+One.</p><p>+Two words.</p></article><footer><p>-&middot; example.net &middot; many words in a footer that look much like a text of the article</p></footer></body>",
    "<body><nav><a>-One</a></nav><article><h1>+Cut off</h1><p>+This page was cut off before its end, as pages of a crawl often are.</p><p>+The last",
    "<body><div class=sidebar>-Popular this week: ten books that you should read before the summer is over.</div><article><h1>+The harbour</h1><p>+The harbour was dug by hand in a single winter, and the first ships came in spring.</p><div class=advert>-Sail with us for less, every day of the year and in any weather.</div><p>+It has been dredged every ten years since then.</p></article><a href=x><h3>-Ten lovely places by the sea</h3><p>-From the coast to the hills, our readers name the places that they love the most.</p></a><div class=cookie>-We use cookies to make this site better. By reading on you agree to this.</div></body>",
    "<body><article><h1>+A vote</h1><p>+The vote was close, and it took the whole night to count all of the papers by hand.</p></article><section class=comments><h3>-Comments</h3><div><b>-Anna</b><p>-I was there and it was a very long night for all of us, I can tell you.</p></div><div><b>-Ben</b><p>-Well done.</p></div></section></body>",
    "<body><main><h1>+Rain</h1><p>+It rained for a week, and the river rose by a metre every day until it stood in the streets.</p><p>+Then it stopped.</p><h3>-3 comments</h3><p>-Carla says</p><p>-This is what they told us would never happen again after the last time.</p></main></body>",
    "<body><nav><a>-One</a></nav><article><p>+Only a paragraph that is cut off in the middle of its very long last",
]

_BLOCK = StructType([StructField("text", StringType()), StructField("f", ArrayType(DoubleType()))])


def drawn(pages: int, seed: int) -> list[str]:
    """Pages as those of LABELLED, from parts of pages that follow each other as they mostly do."""
    rng = random.Random(seed)

    def words(least: int, most: int) -> str:
        return " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(least, most)))

    def links(least: int, most: int, size: int, around: str) -> str:
        return "".join(f"<{around}><a>-{words(1, size)}</a></{around}>" for _ in range(rng.randint(least, most)))

    def block(mark: str, least: int, most: int, tag: str = "p") -> str:
        return f"<{tag}>{mark}{words(least, most)}</{tag}>"

    def part(content: str) -> str:
        """Content in an element whose class or id names it as furniture."""
        name = rng.choice(sorted(NAMES) + list(BEGINNINGS)) + rng.choice(["", "", "s", "-box", "_1"] if rng.random() < 0.5 else [""])
        name = name if _furniture(f'class="{name}"') else "advert"
        return f'<div {rng.choice(["class", "id"])}="{rng.choice(["", "x ", "col-2 "])}{name}">{content}</div>'

    def plain(content: str) -> str:
        return f'<div class="{rng.choice(["content", "text", "story", "body", "entry", "post"])}">{content}</div>'

    def paragraphs() -> str:
        out = []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
            kind = rng.random()
            if kind < 0.7:
                inner = "".join(f" <a>{words(1, 4)}</a> {words(2, 20)}" for _ in range(rng.choice([0, 0, 0, 1, 1, 2])))
                out.append(f"<p>+{words(4, 60 if inner else 90)}{inner}</p>")
            elif kind < 0.85:
                out.append(block("+", 1, 8))
            elif kind < 0.9:
                out.append(block("+", 2, 9, "h2") + block("+", 10, 80))
            elif kind < 0.92:
                inner = rng.choice([block("-", 1, 40, rng.choice(["p", "div"])), f"<p>-{words(1, 9)} <a>{words(1, 4)}</a> {words(1, 20)}</p>", f"<a>-{words(1, 3)}</a> {words(2, 12)}"])
                out.append(part(inner) + block("+", 10, 80))
            elif kind < 0.97:
                out.append("<ul>" + "".join(block("+", 1, 15, "li") for _ in range(rng.randint(2, 5))) + "</ul>" + block("+", 10, 80))
            else:
                out.append(f"<aside>-{words(1, 30)}</aside>" + block("+", 10, 80))
        return "".join(out)

    def page() -> str:
        top = rng.choice(
            [
                lambda: f"<nav><ul>{links(3, 12, 3, 'li')}</ul></nav>",
                lambda: f"<div>{links(3, 12, 3, 'span')}</div>",
                lambda: f"<header><p>-{words(1, 8)}</p></header><nav>{links(2, 9, 3, 'li')}</nav>",
                lambda: "",
            ]
        )()
        if "<span>" in top:  # one flat block
            top = "<div>-" + top[5:].replace("-", "")
        notice = rng.choice([lambda: "", lambda: f"<div>-{words(2, 25)}</div>", lambda: f"<div>-{words(6, 25)} <a>{words(1, 2)}</a></div>"])() if top else ""
        title = block("+", 2, 18, "h1") if rng.random() < 0.9 or notice else ""
        body = ("" if rng.random() < 0.7 else f"<p>-<a>{words(1, 3)}</a></p>" if not title else "") + title + paragraphs()
        body = rng.choice([f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>", plain(body)])
        side = rng.choice(["", "", part(block("-", 2, 6, "h3") + block("-", 8, 60)), part(links(3, 8, 6, "li"))])
        teasers = "".join(f"<a href=x><h3>-{words(2, 9)}</h3><p>-{words(6, 40)}</p></a>" for _ in range(rng.choice([0, 0, 1, 3])))
        cookie = rng.choice(["", "", part(block("-", 6, 40) + rng.choice(["", "<p>-<a>ok</a></p>"]))])
        share = rng.choice(["", "", f"<div>{links(2, 5, 2, 'p')}</div>"])
        related = rng.choice(["", "", f"<h3>-{words(1, 3)}</h3>{links(3, 8, 12, 'li')}"])
        comments = "".join(f"<div><p>-<a>{words(1, 2)}</a></p><p>-{words(3, 60)}</p><p>-<a>{words(1, 2)}</a></p></div>" for _ in range(rng.choice([0, 0, 0, 1, 3, 6])))
        if rng.random() < 0.3:
            each = lambda: f"<div><b>-{words(1, 2)}</b><p>-{words(2, 70)}</p></div>"
            said = "".join(each() for _ in range(rng.randint(1, 6)))
            comments = rng.choice([f'<section class="comments"><h3>-Comments</h3>{said}</section>', f"<section><h3>-{rng.randint(1, 9)} comments</h3>{said}</section>", part(said)])
        foot = rng.choice([f"<footer>-{words(1, 30)}</footer>", f"<footer><p>-{words(1, 30)} <a>{words(1, 4)}</a></p></footer>", f"<div>{links(2, 6, 2, 'p')}</div>", ""])
        before, after = (side, "") if rng.random() < 0.5 else ("", side)
        return "<body>" + top + notice + before + body + after + teasers + share + related + comments + cookie + foot + "</body>"

    return [page() for _ in range(pages)]


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose attributes begin here is over.

    A quote without an end goes for nothing. Such a quote is the last of its kind on the page, and
    all else that is looked at is left behind, so that a page takes linear time.
    """
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return len(page)
        if m[0] == ">":
            return m.end()
        close = page.find(m[0], m.end())
        if close < 0:
            end = page.find(">", m.end())
            return end + 1 if end >= 0 else len(page)
        at = close + 1


def blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """(text, FEATURES) of each block of a page, in page order; null or empty: none."""
    page = page or ""
    found: list[tuple[str, int, int, bool, bool, bool]] = []  # text, words, linked words, heading, aside, named
    text: list[str] = []
    words = link_words = asides = named = mains = 0
    heading = False
    linked = -1  # how many elements are open around the link
    stack: list[list] = []  # tag, whether it is an aside, whether it is named
    opened: dict[str, int] = {}

    def add(raw: str) -> None:
        nonlocal words, link_words
        raw = html_lib.unescape(raw) if "&" in raw else raw
        n = len(raw.split())
        words += n
        link_words += n if linked >= 0 else 0
        text.append(raw)

    def end() -> None:
        nonlocal words, link_words, named
        if words:
            whole = " ".join("".join(text).split())
            if heading and words <= SHORT and any(w in whole.lower() for w in COMMENTS):
                # From here on, what the heading stands in is named.
                home = next((e for e in reversed(stack) if e[0] not in HEADINGS), None)
                if home is not None and not home[2]:
                    home[2] = True
                    named += 1
            found.append((whole, words, link_words, heading, asides > 0, named > 0))
        text.clear()
        words = link_words = 0

    def push(tag: str, attributes: str) -> None:
        nonlocal asides, named, mains
        aside = tag in ASIDE and not (tag == "header" and mains)
        name = tag not in ("body", "html") and tag not in MAIN and _furniture(attributes, bool(mains))
        stack.append([tag, aside, name])
        opened[tag] = opened.get(tag, 0) + 1
        asides, named, mains = asides + aside, named + name, mains + (tag in MAIN)

    def pop(tag: str) -> None:
        """Close the innermost element of that tag and all inside it; without one, nothing."""
        nonlocal asides, named, mains, linked
        if not opened.get(tag):
            return
        while True:
            t, aside, name = stack.pop()
            opened[t] -= 1
            asides, named, mains = asides - aside, named - name, mains - (t in MAIN)
            if t == tag:
                break
        if linked > len(stack):
            linked = -1

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        m = _OPEN.match(page, begin) if begin >= 0 else None
        if begin < 0:
            add(page[at:])
            break
        if m is None:  # a sign of the text, if it isn't what is left of a tag
            if begin + 1 < n:
                add(page[at : begin + 1])
            elif begin > at:
                add(page[at:begin])
            at = begin + 1
            continue
        if begin > at:
            add(page[at:begin])
        tag, closing = (m[2] or "").lower(), bool(m[1])
        if not tag:
            stop = "-->" if m[0] == "<!--" else ">"
            close = page.find(stop, m.end())
            at = close + len(stop) if close >= 0 else n
            continue
        at = _tag_end(page, m.end())
        attributes = page[m.end() : at]
        if tag in SKIPPED:
            if not closing and page[at - 2 : at] != "/>":
                end()
                # Without its end tag, a script or style runs to the end; a head ends at the body.
                stop = _SKIP_END[tag].search(page, at)
                at = stop.end() if stop else n
        elif tag == "a":
            linked = -1 if closing else len(stack)
        elif tag == "br":
            add("\n")
        elif tag not in INLINE:
            end()
            heading = not closing if tag in HEADINGS else heading and closing
            if closing:
                pop(tag)
            elif tag not in VOID:
                if stack and (stack[-1][0] == tag and tag in ALONE or stack[-1][0] == "p"):
                    pop(stack[-1][0])
                push(tag, attributes)
    end()
    return [(b[0], _features(found, i)) for i, b in enumerate(found)]


def _features(found: list, i: int) -> list[float]:
    out = []
    for k in NEIGHBOURS:
        b = found[i + k] if 0 <= i + k < len(found) else None
        out += [float(b[1]), b[2] / b[1]] if b else [0.0, 0.0]
    near = [found[i + k][3] if 0 <= i + k < len(found) else False for k in (0, -1, 1)]
    return [*out, *map(float, near), float(found[i][4]), float(found[i][5])]


def _furniture(attributes: str, in_main: bool = False) -> bool:
    """Whether a tag's class, id or role names furniture; a header inside the main text is none."""
    if "=" not in attributes:
        return False
    for m in _NAMED.finditer(attributes):
        for name in m[1].strip("\"'").split():
            parts = [w.lower() for w in _WORD.findall(name)]
            if WHOLE.isdisjoint(parts) and any(w in NAMES and not (in_main and w == "header") or w.startswith(BEGINNINGS) for w in parts):
                return True
    return False


def labelled(pages: list[str]) -> list[tuple[float, list[float]]]:
    """(label, FEATURES) of the blocks of marked pages."""
    return [(float(text[0] == "+"), f) for page in pages for text, f in blocks(page)]


def train(spark: SparkSession, pages: list[str] | None = None, depth: int = DEPTH):
    """A decision tree over the labelled table: the given pages, or LABELLED and drawn ones."""
    rows = [(label, Vectors.dense(f)) for label, f in labelled(pages or LABELLED * 5 + drawn(DRAWN, 1))]
    data = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=3, maxBins=128, seed=1).fit(data)


def accuracy(model, pages: list[str]) -> float:
    """Share of the blocks of marked pages that the tree tells right."""
    rows = labelled(pages)
    return sum(model.predict(Vectors.dense(f)) == label for label, f in rows) / max(1, len(rows))


def tree_column(model, f: Column) -> Column:
    """Whether the tree's class is 1, as nested conditions on an array of features."""

    def walk(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(node.prediction() == 1.0)
        split = node.split()
        return F.when(f[split.featureIndex()] <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(model._call_java("rootNode"))


def with_blocks(pages: DataFrame, html: str = "html", out: str = "blocks") -> DataFrame:
    """pages with their text blocks instead of the html; a column named `out` is replaced.

    Null and empty pages have no blocks. Every row stays, also of equal ones; an empty table gives
    no rows.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html, out)]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                made = [[{"text": t, "f": f} for t, f in blocks(x)] for x in part.column(part.schema.get_field_index(html)).to_pylist()]
                array = pa.array(made, pa.list_(pa.struct([("text", pa.string()), ("f", pa.list_(pa.float64()))])))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), array], [*(f.name for f in kept), out])

    return pages.mapInArrow(run, StructType([*kept, StructField(out, ArrayType(_BLOCK))]))


def extract(pages: DataFrame, model=None, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text, its blocks joined by one space, instead of the html.

    A null or empty page, and a page without main blocks, has an empty text. Every row stays, also
    of null or repeated id; a column named `text` is replaced. An empty table gives no rows.
    """
    model = model or train(pages.sparkSession)
    split = with_blocks(pages, html, "__blocks")
    main = F.filter("__blocks", lambda b: tree_column(model, b["f"]))
    return split.withColumn(text, F.array_join(F.transform(main, lambda b: b["text"]), " ")).drop("__blocks")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
