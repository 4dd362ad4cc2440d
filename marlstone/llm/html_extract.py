"""Main text of web pages from flat text blocks.

A page is cut into flat blocks of text at block-level tags. A block's features are its word count and link density, those
of the blocks before and after it, and which kind of container it is in. A decision tree, trained on the small labelled
table PATTERNS below, says which blocks are main text; these are joined in page order by one space.

Within an article or main element, links in sentences and lists of links are text unless a nav element or a name tells a menu; a label or button between
words of a sentence is part of it.

Cutting is a small function on each page; features of neighbours, the tree and the joining are column expressions.

Edge cases: a null or empty page gives an empty text; an unclosed tag, comment, script or style ends with the page, as in browsers, and other
elements with the one around them; a head ends where the body's text begins. Pages of any length are read whole; repeated and equal pages
are extracted each. Other columns are kept whatever their names; a column ``main_text`` of the caller's is replaced.
"""

from __future__ import annotations

import html
import random
import re

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.text import let, unused

#: Elements that hold plain characters up to their end tag, none of them text of the page.
RAW = "script style title textarea iframe xmp noembed noframes".split()
#: Elements whose content isn't shown, elements that end a block, and containers.
HIDDEN = "svg math object canvas template noscript datalist audio video".split()
BLOCK = "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
CONTAINER = "article aside blockquote body button dd details dialog div dl dt fieldset figure footer form header label li main menu nav ol p section select span table td th tr ul".split()
OUTSIDE = "aside button dialog footer form header label menu nav select".split()
MAIN = "article main".split()
SENTENCE = "p li td dd".split()
#: Elements that end an open one of their kind, up to the list or table around it.
IMPLIED = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",)}
#: Words in class, id or role that tell a container which isn't main text, and those that an article or main element within it
#: overrides if they are only part of a name (a layout that is called after its sidebar).
HINTS = "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer form gdpr header login menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe toc toolbar widget".split()
LAYOUT = "banner breadcrumb breadcrumbs contentinfo footer header menu nav navbar navigation sidebar toc toolbar".split()
#: Within an article or main element a name tells only if each of its parts is a hint or one of these, or if its last part is one of NOTICES:
#: a section about a social impact, related work or share prices is text.
NEUTRAL = "area articles bar block box btn button buttons container content group icon icons inner item items link links list media module outer panel post posts section slot stories unit wrap wrapper".split()
NOTICES = "ad ads advert advertisement adverts breadcrumb breadcrumbs comment comments cookie cookies disqus nav navbar newsletter popup promo sidebar signup sponsored subscribe toolbar".split()
#: Parts of a name after which a hint says what else the page has.
LACKS = "has with no without hide show when".split()

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[!?/a-z][^>]*+(?:>|\Z)|<\Z",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HREF = re.compile(r"(?<![\w-])href\s*=", re.IGNORECASE)
_WORD = re.compile(r"\w")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_BLOCK, _CONTAINER, _OUTSIDE, _MAIN, _HINTS, _HIDDEN, _LAYOUT, _LACKS, _NEUTRAL, _NOTICES = map(frozenset, (BLOCK, CONTAINER, OUTSIDE, MAIN, HINTS, HIDDEN, LAYOUT, LACKS, NEUTRAL, NOTICES))
BLOCKS = "array<struct<text:string,words:int,links:int,main:int,outside:int,hint:int,heading:int>>"
FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "main", "outside", "hint", "heading", "page_main"]


def _hint(attrs: str, main: int) -> int:
    """0 if no name in class, id or role is a hint, 1 if only layouts are named after one, 2 otherwise."""
    level = 0
    for m in _NAMED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _PART.findall(name)]
            if main and parts and not (parts[-1] in _NOTICES or all(p in _HINTS or p in _NEUTRAL for p in parts)):
                continue
            for k, part in enumerate(parts):
                if part in _HINTS and not (main and part == "header") and not _LACKS.intersection(parts[:k]):
                    level = max(level, 1 if part in _LAYOUT and len(parts) > 1 else 2)
    return level


def blocks(page: str | None) -> list[dict]:
    """The flat text blocks of a page."""
    found: list[dict] = []
    texts: list[tuple[str, bool, bool]] = []  # text; within a link, within a label or button of a sentence
    open_: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag; inside main, an outside container, a hinted one
    hidden: list[str] = []  # open elements that aren't shown
    linked = 0  # how many containers were open where the link began, or 0
    heading = False
    inline: list[str] = []  # open labels and buttons that began within a sentence

    def close() -> None:
        inline.clear()
        for end in (-1, 0):  # one that doesn't stand between words isn't of the sentence
            while texts and any(ui for _, _, ui in texts) and (texts[end][2] or not texts[end][0].strip()):
                texts.pop(end)
        if texts:
            parts = [(html.unescape(t), a) for t, a, _ in texts]
            words = "".join(t for t, _ in parts).split()
            if words:
                counted = sum(1 for w in words if _WORD.search(w))  # separators aren't words
                links = sum(1 for t, a in parts if a for w in t.split() if _WORD.search(w))
                _, main, outside, hint = open_[-1]
                found.append({"text": " ".join(words), "words": counted, "links": min(links, counted), "main": main, "outside": outside, "hint": int(hint > 0), "heading": int(heading)})
            texts.clear()

    def shut(k: int) -> None:
        nonlocal linked
        del open_[k:]
        if linked > k:
            linked = 0

    at = 0
    for m in _TOKEN.finditer(page or ""):
        if m.start() > at and not hidden:
            texts.append((page[at : m.start()], linked > 0, bool(inline)))
        at = m.end()
        if m["raw"] and m["raw"].lower() in ("title", "textarea", "iframe"):
            close()
        if not m["tag"]:
            continue
        tag, ends = m["tag"].lower(), bool(m["end"])
        if hidden:
            if tag in _HIDDEN:
                if ends:
                    k = next((i for i in range(len(hidden) - 1, -1, -1) if hidden[i] == tag), -1)
                    hidden = hidden[:k] if k >= 0 else hidden
                elif not m["attrs"].endswith("/"):
                    hidden.append(tag)
                continue
            opens = hidden[0] in ("svg", "math") and not ends and tag in _BLOCK
            around = ends and tag in _CONTAINER and any(o[0] == tag for o in open_) and hidden[0] != "template"
            if not (opens or around):
                continue
            hidden = []  # what was left open ends with what is around it, a drawing at the next block
        if tag in _HIDDEN:
            if not ends and not m["attrs"].endswith("/"):
                hidden = [tag]
            continue
        if tag in ("label", "button"):
            if ends and tag in inline:
                inline.remove(tag)
                continue
            if not ends and open_[-1][0] in SENTENCE and open_[-1][1] and not open_[-1][2] and any(t.strip() for t, _, _ in texts):
                inline.append(tag)
                continue
        if tag in _BLOCK:
            close()
        if tag == "a":
            linked = len(open_) if not ends and _HREF.search(m["attrs"]) else 0
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            heading = not ends
        if tag in _CONTAINER:
            if tag == "p" or (not ends and open_[-1][0] == "p" and tag in _BLOCK):  # a paragraph ends at the next block
                while open_[-1][0] == "p":
                    shut(len(open_) - 1)
            if ends:
                k = next((i for i in range(len(open_) - 1, 0, -1) if open_[i][0] == tag), 0)
                if k:
                    if tag in ("span", "label", "button"):
                        close()
                    shut(k)
            elif not m["attrs"].endswith("/"):
                if tag in IMPLIED:
                    for i in range(len(open_) - 1, 0, -1):
                        if open_[i][0] == tag or (tag in ("dd", "dt") and open_[i][0] in ("dd", "dt")) or (tag in ("td", "th") and open_[i][0] in ("td", "th")):
                            shut(i)
                            break
                        if open_[i][0] in IMPLIED[tag]:
                            break
                _, main, outside, hint = open_[-1]
                outside = int(outside or (tag in _OUTSIDE and not (tag == "header" and main)))
                mine = _hint(m["attrs"], main) if m["attrs"] and tag not in ("body", "html") else 0
                if tag in _MAIN:
                    hint, mine = (0 if hint == 1 else hint), (mine if mine == 2 else 0)
                if mine and tag == "span":
                    close()
                open_.append((tag, int(main or tag in _MAIN), outside, max(hint, mine)))
    if page and at < len(page) and not hidden:
        texts.append((page[at:], linked > 0, bool(inline)))
    close()
    return found


def _density(b: Column) -> Column:
    return F.try_divide(b["links"], b["words"])


def _features(all_: Column, b: Column, i: Column, page_main: Column) -> dict[str, Column]:
    before, after = F.get(all_, i - 1), F.get(all_, i + 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    values = [b["words"], _density(b), before["words"], _density(before), after["words"], _density(after), b["main"], b["outside"], b["hint"], b["heading"], page_main]
    return {name: zero(v) for name, v in zip(FEATURES, values, strict=True)}


#: The labelled table, page patterns with their main blocks marked by data-main. L stands for 10 to 80 words, A for 1
#: to 60, S for 1 to 4, K for a link of 1 to 6 words and N for a menu of 3 to 7 links; ``labelled_pages`` fills each in several ways.
PATTERNS = [
    # Pages whose tags and names tell.
    '<nav>{N}</nav><div class="ad">{A}</div><article><h1 data-main>{A}</h1><p data-main>{A}</p><p data-main>{A}</p><p data-main>{L} {K}</p></article><footer>{A}</footer>',
    '<header>{K}<p>{A}</p></header><main><h2 data-main>{A}</h2><p data-main>{A}</p><p data-main>{A}</p><aside><p>{A}</p></aside><div class="comments"><p>{A}</p><p>{A}</p></div></main><form><p>{A}</p><label>{S}</label></form>',
    '<div id="menu"><p>{S}</p><p>{A}</p></div><article><p data-main>{A}</p><p data-main>{A}</p><div class="share"><p>{A}</p></div><section id="reader-comments"><p>{A}</p></section></article><div class="sidebar"><p>{A}</p></div><div class="cookie-notice"><p>{A}</p></div>',
    "<main><p data-main>{A}</p><ul><li data-main>{A}</li><li data-main>{L} {K}.</li></ul><nav>{K} {K}</nav><p data-main>{A}</p></main><aside>{A}</aside>",
    '<div class="banner"><p>{A}</p></div><article><table><tr><td data-main>{S}</td><td data-main>{S}</td></tr></table><form><p>{A}</p></form><p data-main>{A}</p></article><div role="contentinfo"><p>{A}</p></div>',
    "<p>{A}</p><p>{A}</p><article><p data-main>{A}</p></article><p>{A}</p><div>{A}</div>",
    "<article><h1 data-main>{K}</h1><p data-main>{A}</p><nav>{N}</nav></article><div>{A}</div>",
    "<nav>{K}</nav><article><h2 data-main>{K}</h2><p data-main>{A}</p><h2 data-main>{A}</h2><p data-main>{A}</p></article>",
    "<main><p data-main>{A}</p><p data-main>{L} {K}</p><nav>{N}</nav><p data-main>{A}</p></main><p>{A}</p>",
    "{N}<article><p data-main>{A}</p><p data-main>{A}</p></article>",
    "{N}<p>{A}</p><main><p data-main>{A}</p><h2 data-main>{S}</h2><p data-main>{A}</p></main>{N}",
    # Pages of plain divisions: length, links and neighbours tell.
    "{N}<div><p data-main>{L}</p><p data-main>{A}</p><p data-main>{L}</p><p data-main>{A}</p></div>{N}<div><p>{S}</p></div>{N}",
    "{N}<h2 data-main>{A}</h2><p data-main>{L}</p><p data-main>{A}</p><p data-main>{L} {K}</p>{N}<div>{S}</div>{N}",
    "{N}<div>{S}</div>{N}<div><p data-main>{L}</p><p data-main>{A}</p><p data-main>{L}</p><p data-main>{A}</p></div>{N}",
    "<div><p data-main>{L}</p><p data-main>{A}</p><p data-main>{L}</p></div>{N}<div>{S}</div>{N}",
    "{N}<div>{S}</div>{N}<h1 data-main>{A}</h1><div data-main>{L}</div><div data-main>{L} {K}</div><div data-main>{L}</div><footer><p>{A}</p></footer>",
    '<div class="top-nav">{N}<p>{A}</p></div><p data-main>{L}</p><p data-main>{A}</p><p data-main>{L}</p><aside><p>{A}</p><p>{S}</p></aside>',
    "{N}<div data-main>{A}</div><div data-main>{L}</div><div data-main>{A}</div>",
    "<p data-main>{L}</p><p data-main>{A}</p><p data-main>{L}</p>",
    "<div data-main>{A}</div>",
    "{N}<p data-main>{L}</p>{N}",
    # Links that an article has as text.
    "{N}<article><p data-main>{S} {K} {S} {K}.</p><ul><li data-main>{K}</li><li data-main>{K}</li><li data-main>{K}</li></ul><p data-main>{A}</p></article>{N}",
    "<nav>{N}</nav><main><p data-main>{K}</p><ul><li data-main>{K}, {S}</li><li data-main>{K}</li></ul></main><footer>{A}</footer>",
]
FILLINGS = 12


def labelled_pages() -> list[str]:
    """The patterns, each filled ``FILLINGS`` times with numbered words of random lengths, from a fixed seed."""
    rng = random.Random(6)
    text = lambda low, high: " ".join(f"word{k}" for k in range(rng.randint(low, high)))
    link = lambda: f'<a href="/x">{text(1, 6)}</a>'

    def menu() -> str:
        links, shape = [link() for _ in range(rng.randint(3, 7))], rng.randrange(3)
        return "<div>" + rng.choice([" ", " | "]).join(links) + "</div>" if shape == 0 else "".join(f"<div>{x}</div>" for x in links) if shape == 1 else "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"

    fill = {"L": lambda: text(10, 80), "A": lambda: text(1, rng.choice([4, 60])), "S": lambda: text(1, 4), "K": link, "N": menu}
    return [re.sub(r"\{([LASKN])\}", lambda m: fill[m[1]](), pattern) for pattern in PATTERNS for _ in range(FILLINGS)]


_MARK = re.compile(r"<(h1|h2|p|li|td|div) data-main>")


def labelled_blocks() -> list[tuple[float, list[float]]]:
    """(label, features) of each block of the labelled table."""
    rows = []
    for page in labelled_pages():
        plain = blocks(_MARK.sub(r"<\1>", page))
        marks = [b["text"] for b in blocks(_MARK.sub("<\\1>\x02 ", page))]
        density = [b["links"] / max(1, b["words"]) for b in plain]
        some = max(b["main"] for b in plain)
        for i, b in enumerate(plain):
            near = [(plain[k]["words"], density[k]) if 0 <= k < len(plain) else (0, 0.0) for k in (i - 1, i + 1)]
            values = [b["words"], density[i], near[0][0], near[0][1], near[1][0], near[1][1], b["main"], b["outside"], b["hint"], b["heading"], some]
            rows.append((1.0 if marks[i].startswith("\x02") else 0.0, [float(v) for v in values]))
    return rows


def train(spark: SparkSession, depth: int = 8):
    """The decision tree, as the root of nested tuples (feature, threshold, left, right) with labels as leaves."""
    rows = [(label, *values) for label, values in labelled_blocks()]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ["label", *FEATURES]))
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(table)

    def walk(node):
        if node.numDescendants() == 0:
            return node.prediction()
        split = node.split()
        return FEATURES[split.featureIndex()], split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return walk(model._java_obj.rootNode())


def _decided(tree, features: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree == 1.0)
    name, threshold, left, right = tree
    return F.when(features[name] <= threshold, _decided(left, features)).otherwise(_decided(right, features))


def _cut(page: Column) -> Column:
    @F.pandas_udf(BLOCKS)
    def cut(pages: pd.Series) -> pd.Series:
        return pages.map(blocks)

    return cut(page)


def extracted(pages: DataFrame, tree=None, *, page: str = "html") -> DataFrame:
    """The pages with ``main_text`` added: an empty string where there is none."""
    tree = train(pages.sparkSession) if tree is None else tree
    cut = unused(pages, "blocks")
    df = pages.withColumn(cut, _cut(F.coalesce(F.col(page), F.lit(""))))
    some = F.exists(cut, lambda b: b["main"] == 1).cast("int")
    kept = let(some, lambda page_main: F.filter(cut, lambda b, i: _decided(tree, _features(F.col(cut), b, i, page_main))))
    return df.withColumn("main_text", F.array_join(F.transform(kept, lambda b: b["text"]), " ")).drop(cut)
