"""Main text of web pages by tree scoring.

A page becomes a tree; elements that cannot belong to an article (navigation, page header
and footer, asides, forms, scripts, hidden parts) are left out. Classes and ids that name
sidebars, adverts, notices or reader comments are weighed against what the element holds:
a name that may tell of the layout (``has-sidebar``, ``long-form``) never takes prose out, and
most of a page's text goes only if an article lies outside it. Every paragraph gives points for its length and commas to its ancestors, whole
points to its parent and a falling share to those above; a container's points are
discounted by its link density. An ``article`` element counts all points below it and
``BONUS`` more. The best container is kept whole. From there the way goes up to the root:
at every level, parts beside it with few links are added if the points below them, not
falling, are a fifth of the best container's, if they carry its class (or are a second
article), or if they are prose of their own. Beside the best container, and wherever a
level adds such a part, headings, short paragraphs, lists, bare text and inline elements
that are not mostly links stay as well.

The text of a kept part comes in page order, blocks joined by one space, white space
inside a block as one space, character references decoded; nothing is cut. Pages are
independent: one narrow stage.

Nulls, ties: a null or blank page, or one without text, gives an empty text; equal scores
go to the earlier container. Malformed markup (unclosed or crossed tags, a page cut short)
is read as far as it goes. Null ids, repeated rows and further columns are left as they
are.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by their role, and words in class, id or role
# that mark parts beside the article.
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"})
VOID = frozenset(
    {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
     "track", "wbr"}
)
BESIDE = frozenset(
    {"script", "style", "noscript", "template", "textarea", "title", "head", "nav", "footer", "aside",
     "form", "button", "select", "option", "input", "label", "fieldset", "iframe", "svg", "canvas",
     "object", "embed", "audio", "video", "dialog", "menu", "xmp", "noembed", "noframes", "datalist"}
)
BLOCK = frozenset(
    {"address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd",
     "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
     "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
     "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary",
     "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "img", "iframe"}
)
CLOSES_P = frozenset(
    {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl",
     "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
     "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
)
OWN_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "template", "html", "body"})
PARAGRAPH = frozenset({"p", "pre", "blockquote", "td", "li", "dd"})
PROSE = 80
BONUS = 25.0
HEADING = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
LISTS = frozenset({"ul", "ol", "dl", "table"})
ASIDE_WORDS = re.compile(
    r"(?:^|[_-])(ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|"
    r"nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|side-bar|aside|widget|widgets|footer|masthead|"
    r"cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|paywall|comment|comments|commentlist|respond|disqus|discussion|replies|reader-comments|"
    r"related|recommended|recommendations|share|sharing|social|toolbar|pagination|pager|skip-link|"
    r"site-header|page-header|topbar|search|legal|copyright|outbrain|taboola|complementary|contentinfo|"
    r"form)(?=$|[_-])",
    re.I,
)
COMMENT_WORDS = frozenset({"comment", "comments", "commentlist", "respond", "disqus", "replies", "reader-comments"})
# words that as often name a part of an article or its layout
UNSURE_WORDS = frozenset(
    {"discussion", "search", "form", "legal", "copyright", "nav", "navigation", "menu", "menus", "share",
     "sharing", "social", "toolbar", "alert", "login", "signup", "advertising", "subscription"}
)
BEFORE = frozenset({"has", "no", "non", "not", "with", "without", "long", "short", "full", "hide", "show"})
AFTER = frozenset(
    {"open", "opened", "closed", "enabled", "disabled", "on", "off", "active", "free", "less", "layout", "page",
     "visible", "hidden"}
)
#: How sure the words of class and id are that an element lies beside the article.
UNSURE, SURE, READERS = 1, 2, 3
ASIDE_ROLES = frozenset(
    {"navigation", "banner", "complementary", "contentinfo", "search", "menu", "menubar", "alert", "dialog",
     "form", "alertdialog"}
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')|=)*)(?:>|$)",
    re.S,
)
#: A quote opens a value only behind the equals sign; other values end at white space.
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


class Node:
    """An element: its tag, parent, class and parts (texts and elements) in order.

    ``points`` fall on the way up, ``mass`` does not; ``beside`` is what class and id say.
    """

    __slots__ = ("tag", "parent", "parts", "points", "mass", "mark", "beside")

    def __init__(self, tag: str, parent: Node | None, mark: str = "", beside: int = 0):
        self.tag, self.parent, self.parts, self.points = tag, parent, [], 0.0
        self.mass, self.mark, self.beside = 0.0, mark, beside


def attributes_of(text: str) -> dict[str, str]:
    """Names in small letters and values; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _gone(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether an element cannot belong to an article, whatever it holds."""
    return (
        tag in BESIDE
        or (tag == "header" and not inside_article)
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or attributes.get("role", "").lower() in ASIDE_ROLES
        or bool(HIDDEN.search(attributes.get("style", "")))
    )


HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _beside(names: str) -> int:
    """What the words of classes and ids say.

    The first and the last part of a name tell what the element is. A word between others,
    behind ``BEFORE`` or before ``AFTER``, or of ``UNSURE_WORDS``, may as well tell of the layout.
    """
    found = 0
    for name in names.lower().split():
        for m in ASIDE_WORDS.finditer(name):
            before, after = name[: m.start(1)], name[m.end(1) :]
            sure = (not after and re.split("[_-]", before)[0] not in BEFORE) or (
                not before and re.split("[_-]", after)[-1] not in AFTER
            )
            if not sure or m[1] in UNSURE_WORDS:
                found = max(found, UNSURE)
            else:
                found = max(found, READERS if m[1] in COMMENT_WORDS else SURE)
    return found


def parse(page: str) -> Node:
    """The tree of a page without the parts beside the article."""
    root = node = Node("html", None)
    stack = [root]
    skipped = 0  # depth inside a left-out element; its elements are on the stack too
    depth_of_article = 0
    at, raw = 0, None

    def pop_to(index: int) -> None:
        nonlocal skipped, node, depth_of_article
        while len(stack) > index:
            gone = stack.pop()
            if gone is None:
                skipped -= 1
            elif gone.tag in ("article", "main"):
                depth_of_article -= 1
        if not skipped:
            node = stack[-1]

    tags = ["html"]
    opened: dict[str, int] = {}  # tags on the stack, so that it is searched for open ones only

    def close(wanted, barrier) -> None:
        if not any(opened.get(t) for t in wanted):
            return
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] in wanted:
                for t in tags[k:]:
                    opened[t] -= 1
                del tags[k:]
                pop_to(k)
                return
            if tags[k] in barrier:
                return

    end = len(page)
    while at < end:
        if raw:
            m = re.compile(rf"</{raw}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            stop = m.start() if m else end
            if not skipped and stop > at:
                node.parts.append(entities.unescape(page[at:stop]))
            at = m.end() if m else end
            close({raw}, ())
            raw = None
            continue
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not skipped:
            node.parts.append(entities.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            if not skipped:
                node.parts.append(m[1])
        elif m[2]:
            tag = m[2].lower()
            if opened.get(tag):
                barrier = () if tag in SCOPE or tag in ("article", "main", "div", "section") else SCOPE
                close({tag}, barrier)
        elif m[3]:
            tag, attributes = m[3].lower(), m[4] or ""
            if tag in ("html", "body"):
                continue
            if tag in CLOSES_P:
                close({"p"}, SCOPE)
            if tag in OWN_END:
                wanted, barrier = OWN_END[tag]
                close({tag} if tag == "li" else wanted, barrier)
            if tag in VOID:
                if not skipped and tag in BLOCK:
                    node.parts.append(Node(tag, node))
                continue
            named = attributes_of(attributes) if attributes and not attributes.isspace() else {}
            drop = skipped > 0 or _gone(tag, named, depth_of_article > 0)
            tags.append(tag)
            opened[tag] = opened.get(tag, 0) + 1
            if drop:
                if not skipped:
                    node.parts.append(Node("br", node))  # what is left out still parts its neighbours
                stack.append(None)
                skipped += 1
            else:
                mark = named.get("class", "")
                says = 0 if tag in ("article", "main") else _beside(f"{mark} {named.get('id', '')}")
                child = Node(tag, node, mark, says)
                node.parts.append(child)
                stack.append(child)
                node = child
                if tag in ("article", "main"):
                    depth_of_article += 1
            if tag in RAW:
                raw = tag
            elif attributes.endswith("/") and tag in ("svg", "path"):
                opened[tags.pop()] -= 1
                pop_to(len(tags))
    _leave_out(root)
    return root


def _leave_out(root: Node) -> None:
    """Takes out what class and id put beside the article, unless its content says otherwise.

    An unsure name goes unless the element holds prose. A sure one goes unless the element
    holds over half of the page's text, and prose, while no article with prose lies
    outside. Readers' comments always go.
    """
    if not any(x.beside for x in _walk(root)):
        return
    size, order = _lengths(root), list(_walk(root))
    prose: dict[int, int] = {}
    articles: dict[int, int] = {}
    for x in reversed(order):
        inner = [p for p in x.parts if isinstance(p, Node)]
        text, link = size[id(x)]
        said = sum(prose[id(p)] for p in inner)
        if x.tag in PARAGRAPH and not any(p.tag in PARAGRAPH for p in inner):
            said = max(said, text - link)
        prose[id(x)] = said
        articles[id(x)] = int(x.tag in ("article", "main") and said > PROSE) + sum(articles[id(p)] for p in inner)
    whole, every = size[id(root)][0], articles[id(root)]
    out: set[int] = set()
    for x in order:
        if not x.beside or x.parent is None:
            continue
        text, link = size[id(x)]
        stays = prose[id(x)] > PROSE and link < 0.25 * text
        if x.beside == SURE:
            stays = stays and 2 * text > whole and every == articles[id(x)]
        if x.beside == READERS or not stays:
            out.add(id(x))
    for x in order:
        x.parts = [
            Node("br", x) if isinstance(p, Node) and id(p) in out else p for p in x.parts
        ]


def _walk(node: Node):
    """Elements in page order, without recursion."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(p for p in reversed(x.parts) if isinstance(p, Node))


def blocks(node: Node) -> list[str]:
    """The texts of the blocks of a subtree in page order, white space collapsed."""
    out, now, todo = [], [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            now.append(x)
        elif x is None or x.tag in BLOCK:
            if now and (text := " ".join("".join(now).split())):
                out.append(text)
            now = []
            if x is not None:
                todo.append(None)
                todo.extend(reversed(x.parts))
        else:
            todo.extend(reversed(x.parts))
    if now and (text := " ".join("".join(now).split())):
        out.append(text)
    return out


def _lengths(root: Node) -> dict[int, tuple[int, int]]:
    """For each element the length of its text and of the text in links."""
    order = list(_walk(root))
    size: dict[int, tuple[int, int]] = {}
    for x in reversed(order):
        text = link = 0
        for p in x.parts:
            if isinstance(p, str):
                text += len(p.strip())
            else:
                a, b = size[id(p)]
                text, link = text + a, link + b
        size[id(x)] = (text, text if x.tag == "a" else link)
    return size


def _density(node: Node, size: dict) -> float:
    text, link = size[id(node)]
    return link / text if text else 0.0


def main_text(page: str | None) -> str:
    """The article of a page as one line of text."""
    if not page or page.isspace():
        return ""
    root = parse(page)
    size = _lengths(root)
    scored: list[Node] = []
    for x in _walk(root):
        own = [p for p in x.parts if isinstance(p, str) and not p.isspace()]
        inner = x.tag in PARAGRAPH and not any(
            isinstance(p, Node) and p.tag in PARAGRAPH for p in x.parts
        )
        loose = x.tag not in PARAGRAPH and x.tag in BLOCK and own
        if not (inner or loose):
            continue
        text = " ".join(blocks(x)) if inner else " ".join(own)
        if not text:
            continue
        points = 1 + text.count(",") + min(3.0, len(text) / 100)
        points *= 1 - _density(x, size)
        x.mass += points
        up, k = (x.parent if inner else x), 0
        while up is not None and k < 5:
            if up.points == 0.0:
                scored.append(up)
            up.points += points / (1 if k == 0 else 2 * k)
            up, k = up.parent, k + 1
    if not scored:
        return " ".join(blocks(root))
    order = list(_walk(root))
    for x in reversed(order):
        if x.parent is not None:
            x.parent.mass += x.mass
    place = {id(x): k for k, x in enumerate(order)}
    value = {id(x): x.points * (1 - _density(x, size)) for x in scored}
    articles = [x for x in order if x.tag == "article" and x.mass]
    value |= {id(x): x.mass * (1 - _density(x, size)) + BONUS for x in articles}
    best = max(scored + articles, key=lambda x: (value[id(x)], -place[id(x)]))
    return " ".join(blocks(_with_company(best, size)))


def _with_company(best: Node, size: dict) -> Node:
    """The best container with what belongs to it at the levels above."""
    least = 0.2 * best.mass * (1 - _density(best, size))
    kept, at = best, best
    while at.parent is not None:
        up = at.parent
        strong = {
            id(p) for p in up.parts if isinstance(p, Node) and p is not at and _strong(p, at, best, least, size)
        }
        parts: list[str | Node] = []
        for run in _runs(up.parts):
            if run[0] is at:
                parts.append(kept)
            elif isinstance(run[0], Node) and id(run[0]) in strong:
                parts.append(run[0])
            elif (strong or at is best) and _weak(run, size):
                parts.extend(run)
            elif _is_inline(run[0]) and _weak(run, size) and sum(_sizes(p, size)[0] for p in run) > PROSE:
                parts.extend(run)
            else:
                parts.append(Node("br", None))
        if any(isinstance(p, str) or (p is not kept and p.parts) for p in parts):
            kept = Node(up.tag, None)
            kept.parts = parts
        at = up
    return kept


def _strong(p: Node, at: Node, best: Node, least: float, size: dict) -> bool:
    """Whether an element beside the way from the best container belongs to the article by itself."""
    text, _ = size[id(p)]
    dense = _density(p, size)
    if not text or dense >= 0.25:
        return False
    if p.tag == "article" and p.mark and p.mark != best.mark and _beside(p.mark) >= SURE:
        return False
    if p.tag in PARAGRAPH:
        return text > PROSE
    if any(p.tag == x.tag and p.mark == x.mark and (p.mark or p.tag == "article") for x in (at, best)):
        return True
    prose = any(x.tag in PARAGRAPH for x in _walk(p))
    return p.mass * (1 - dense) >= (least if prose else max(10.0, least))


def _weak(run: list, size: dict) -> bool:
    """Whether a part stays in the company of others: headings, short paragraphs, lists, text."""
    first = run[0]
    if _is_inline(first):
        text, link = (sum(x) for x in zip(*(_sizes(p, size) for p in run), strict=True))
        return text > 0 and link < 0.5 * text
    text, _ = size[id(first)]
    dense = _density(first, size)
    return (
        first.tag in HEADING
        or (first.tag in PARAGRAPH and text > 0 and dense == 0)
        or (first.tag in LISTS and text > 0 and dense < 0.25)
    )


def _is_inline(p: str | Node) -> bool:
    return isinstance(p, str) or (p.tag not in BLOCK and not p.mass)


def _sizes(p: str | Node, size: dict) -> tuple[int, int]:
    return (len(p.strip()), 0) if isinstance(p, str) else size[id(p)]


def _runs(parts: list):
    """Runs of text and inline elements, and every other element by itself."""
    run: list = []
    for p in parts:
        if _is_inline(p):
            run.append(p)
            continue
        if run:
            yield run
            run = []
        yield [p]
    if run:
        yield run


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
