"""Main text of web pages by tree scoring.

Paragraph-like blocks earn points for length and commas. The points go to their ancestors (whole to the parent, half to
the grandparent, a third, and so on), are discounted by the share of text inside links. The article, main or articleBody
element around the best container is kept whole; without one, the container and all of its siblings but lists of links.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from .common import map_texts

#: Elements whose content is never main text.
SKIPPED = frozenset("script style noscript template head title nav header footer aside form button select option textarea input iframe object embed svg canvas dialog menu audio video map math".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Elements that end an open one of the same kind, up to the given containers.
CLOSES = {"li": ("li", ("ul", "ol")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Blocks that earn points, and what each starts with.
SCORED = {"p": 1.0, "pre": 1.0, "td": 1.0, "blockquote": 1.0, "li": 0.5, "dd": 0.5, "h1": 0.5, "h2": 0.5, "h3": 0.5, "h4": 0.2, "h5": 0.2, "h6": 0.2, "figcaption": 0.2, "div": 0.5, "section": 0.5, "article": 0.5, "main": 0.5, "body": 0.5}
#: What class and id say of a container.
JUNK = re.compile(r"(?<![a-z])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|comments?|disqus|replies|respond|side-?bar|widget|menu|nav(?:igation|bar)?|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri(?:be|ption)|signup|login|share|sharing|social|related|recommended|more-stories|pagination|pager|tags?-?(?:list|cloud)?|toolbar|skip-?link|hidden|sr-only|print-only|legal|copyright|disclaimer)(?![a-z])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
LIKELY = re.compile(r"(?<![a-z])(?:article|body|content|entry|main|post|story|text|blog|page)(?![a-z])", re.I)
ROOTS = frozenset(("html", "body", "main", "article"))

#: What page-wide containers say, for single paragraphs, links and spans: fewer words, since those may name a topic.
JUNK_LINE = re.compile(r"(?<![a-z])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?s?|comments?|cookies?|consent|gdpr|notice|alert|newsletter|subscri(?:be|ption)|share|sharing|social|copyright|disclaimer|hidden|sr-only)(?![a-z])", re.I)
HEADER = re.compile(r"(?<![a-z])(?:header|masthead)(?![a-z])", re.I)

OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
COMMENT_END = re.compile(r"--!?>")
PLAIN = re.compile(r"[^>\"']*+")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACES = re.compile(r"\s+")
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "parent", "kids", "junk", "score", "likely", "depth", "article", "header")

    def __init__(self, tag: str, parent: Node | None, junk: bool, likely: bool = False, article: bool = False):
        self.tag, self.parent, self.junk, self.likely = tag, parent, junk, likely
        self.article = article or tag == "article"
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.header = tag == "header"
        self.depth = 0 if parent is None else parent.depth + 1


def is_junk(tag: str, raw: str) -> tuple[bool, bool, bool]:
    """Whether an element is junk, has a likely name, and is marked as an article's body."""
    if tag in SKIPPED:
        return True, False, False
    if not raw or raw.isspace():
        return False, False, False
    a = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(raw)}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return tag not in ROOTS, False, False
    names = names_of(a)
    if tag not in ROOTS and tag not in ("b", "i", "em", "strong", "h1") and (JUNK_LINE if tag in ("p", "a", "span") else JUNK).search(names):
        return True, False, False
    body = "articleBody" in a.get("itemprop", "").split()
    return False, body or bool(LIKELY.search(names)), body


def names_of(a: dict[str, str]) -> str:
    """Class and id, in words set apart by dashes or spaces."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", f"{a.get('class', '')} {a.get('id', '')}").replace("_", "-")


class Tags:
    """Where tags end. Quoted values may hold the closing bracket; a page on which that leads nowhere is read without
    regard to quotes from there on, so that every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quotes, self.missing = page, True, set()

    def end(self, pos: int) -> int:
        """The place of the bracket that closes the tag whose name ends at pos; -1 if there is none."""
        page = self.page
        i = pos
        while self.quotes:
            i = PLAIN.match(page, i).end()
            if i >= len(page):
                self.quotes = False
                break
            c = page[i]
            if c == ">":
                return i
            k = i - 1
            while k >= pos and page[k].isspace():
                k -= 1
            j = page.find(c, i + 1) if k >= pos and page[k] == "=" and c not in self.missing else -1
            if j < 0 and k >= pos and page[k] == "=":
                self.missing.add(c)
            i = max(i, j) + 1
        return page.find(">", pos)


def parse(page: str) -> Node:
    """A tolerant tree: unclosed elements end with their container, stray end tags are ignored."""
    root = at = Node("#root", None, False)
    pos, n, tags, closed = 0, len(page), Tags(page), page.rfind(">")
    stack = {"#root": 1}
    while pos < n:
        m = OPEN.search(page, pos)
        if m is None or m.start() > closed and m[0] != "<!--":  # no tag ends any more
            at.kids.append(page[pos:])
            break
        if m.start() > pos:
            at.kids.append(page[pos : m.start()])
        name = m[2]
        if name is None:
            end = COMMENT_END.search(page, m.end()) if m[0] == "<!--" else None
            pos = end.end() if end else n if m[0] == "<!--" else page.find(">", m.end()) + 1 or n
            continue
        pos = tags.end(m.end())
        raw = page[m.end() : pos]
        pos += 1
        tag = name.lower()
        if m[1]:
            if tag in ("p", "br") and not stack.get(tag):
                at.kids.append(Node(tag, at, False))
            if stack.get(tag) and tag not in VOID:
                while True:
                    stack[at.tag] -= 1
                    done = at.tag == tag
                    at = at.parent
                    if done:
                        break
            continue
        if tag in ENDS_P and stack.get("p"):
            up = at
            while up.tag != "p" and up.tag not in ("td", "th", "button", "object", "table"):
                up = up.parent
            if up.tag == "p":
                while True:
                    stack[at.tag] -= 1
                    done, at = at is up, at.parent
                    if done:
                        break
        if tag in CLOSES and any(stack.get(t) for t in CLOSES[tag][0].split()):
            ends, stops = CLOSES[tag]
            up, last = at, None
            while up.tag != "#root" and up.tag not in stops:
                if up.tag in ends.split():
                    last = up
                up = up.parent
            while last is not None:
                stack[at.tag] -= 1
                done, at = at is last, at.parent
                if done:
                    break
        node = Node(tag, at, *is_junk(tag, raw))
        node.header = node.header or node.junk and bool(HEADER.search(raw))
        at.kids.append(node)
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = ENDS[tag].search(page, pos, closed + 1)
            pos = end.end() if end else n
            continue
        at = node
        stack[tag] = stack.get(tag, 0) + 1
    return root


def own_text(node: Node) -> tuple[str, int]:
    """Text of a block without its inner blocks, and how much of it stands in links."""
    parts: list[str] = []
    linked = 0
    todo: list[tuple[Node | str, bool]] = [(k, False) for k in reversed(node.kids)]
    while todo:
        x, link = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            linked += len(x.strip()) * link
        elif x.tag == "br":
            parts.append(" ")
        elif not x.junk and x.tag not in BLOCKS:
            todo += [(k, link or x.tag == "a") for k in reversed(x.kids)]
    return SPACES.sub(" ", html.unescape("".join(parts))).strip(), linked


def walk(root: Node):
    """Every node that is not inside junk, parents first, in page order."""
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo += [k for k in reversed(x.kids) if not isinstance(k, str) and not k.junk]


def titles(header: Node) -> list[Node]:
    """The h1 elements of a header, outside of other junk."""
    out, todo = [], [header]
    while todo:
        x = todo.pop()
        if x.tag == "h1":
            out.append(x)
        else:
            todo += [k for k in reversed(x.kids) if isinstance(k, Node) and (not k.junk or k.header)]
    return out


def render(node: Node, out: list[str]) -> None:
    """Blocks of text under a node in page order; references are decoded after the markup is gone. Of the headers inside
    an article, the title stays."""
    line: list[str] = []

    def flush() -> None:
        if line and (t := SPACES.sub(" ", html.unescape("".join(line))).strip()):
            out.append(t)
        line.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.junk:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(x.kids)
        elif x.header and node.article:
            todo += reversed(titles(x))
    flush()


def mostly_links(node: Node) -> bool:
    """Whether at least half of the text under a node stands in links."""
    total = linked = 0
    todo: list[tuple[Node | str, bool]] = [(node, False)]
    while todo:
        x, link = todo.pop()
        if isinstance(x, str):
            n = len(SPACES.sub(" ", x).strip())
            total += n
            linked += n * link
        elif not x.junk:
            todo += [(k, link or x.tag == "a") for k in x.kids]
    return total > 0 and 2 * linked >= total


def blocks_of(node: Node) -> list[Node]:
    """The children of a node without junk; text and inline elements between two blocks are one child."""
    out: list[Node] = []
    loose = None
    for k in node.kids:
        if isinstance(k, Node) and k.tag in BLOCKS:
            loose = None
            if not k.junk:
                out.append(k)
        elif isinstance(k, str) or not k.junk:
            if loose is None:
                loose = Node("div", node, False)
                out.append(loose)
            loose.kids.append(k)
    return out


def kept_with(best: Node) -> list[Node]:
    """What is rendered for the best container."""
    up, article, main = best, None, None
    while up is not None:
        article = up if up.article else article
        main = up if up.tag == "main" else main
        up = up.parent
    if article is not None:
        if article.parent is None or article.tag != "article":
            return [article]
        return [k for k in article.parent.kids if k is article or isinstance(k, Node) and k.tag == "article" and not k.junk and not mostly_links(k)]
    if main is not None:
        return [main]
    while best.parent is not None and best.tag not in ("body", "html"):
        kept = [k for k in blocks_of(best.parent) if k is best or best in k.kids or not mostly_links(k)]
        text: list[str] = []
        for k in kept:
            if k is not best and best not in k.kids:
                render(k, text)
        if text or best.parent.tag in ("body", "html", "#root"):
            return kept
        best = best.parent
    return [best]


def main_text(page: str) -> str:
    """The article's text, blocks joined by line feeds; an empty string for an empty page or one without text."""
    if not page:
        return ""
    root = parse(page)
    nodes = list(walk(root))
    text_len: dict[int, int] = {}
    link_len: dict[int, int] = {}
    for x in nodes:
        base = SCORED.get(x.tag)
        if base is None and x is not root:
            continue
        text, linked = own_text(x)
        if not text:
            continue
        text_len[id(x)], link_len[id(x)] = len(text), linked
        points = ((base or 0.5) + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)) * (1 - min(1.0, linked / len(text)))
        holder = x.parent if x.parent is not None and x.tag not in ("div", "section", "article", "main", "body") else x
        share = 1.0
        level = 0
        while holder is not None and level < 6:
            holder.score += points * share
            level += 1
            share = 1.0 / (2.0 if level == 1 else 3.0 * (level - 1))
            holder = holder.parent
    for x in reversed(nodes):  # children come before their parents
        if x.parent is not None:
            text_len[id(x.parent)] = text_len.get(id(x.parent), 0) + text_len.get(id(x), 0)
            link_len[id(x.parent)] = link_len.get(id(x.parent), 0) + link_len.get(id(x), 0)
    best, most = None, 0.0
    density = lambda x: min(1.0, link_len.get(id(x), 0) / max(1, text_len.get(id(x), 0)))
    for x in nodes:
        if x.score > 0 and x.tag not in ("html", "#root", "tr", "tbody"):
            bonus = 1.5 if x.tag in ("article", "main") else 1.25 if x.likely else 1.0
            got = x.score * bonus * (1 - density(x))
            if got > most:
                best, most = x, got
    if best is None:
        best = root
    out: list[str] = []
    for k in kept_with(best):
        render(k, out)
    return "\n".join(out)


def extract(df: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """keys, text and n_chars (code points) of each page.

    A null or empty page gives an empty text; whole pages are read, in time that grows with their length; equal pages give
    equal texts; an empty table gives no rows; columns other than the keys and the page are ignored.
    """

    def work(pages: list[str]) -> list[list]:
        texts = [main_text(p) for p in pages]
        return [texts, [len(t) for t in texts]]

    return map_texts(df, keys, html_col, "text string, n_chars long", work)


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .common import table

    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
