"""A tolerant HTML reader: block elements as a tree, with the text and the statistics of each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.IGNORECASE)
TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements whose text is never read, up to their end tag.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "title", "select", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "head", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "label", "legend", "option",
}
#: What an opening tag ends, if it is open and nothing of the second set is open inside it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset
    children: list[int] = field(default_factory=list)
    own: int = 0  # characters of its own text
    linked: int = 0  # of those, inside links
    words: int = 0
    stops: int = 0  # sentence and clause marks
    before: int = 0  # characters of text before it


def tokens(attributes: str) -> frozenset:
    return frozenset(t.lower() for m in NAMED.finditer(attributes) for t in TOKEN.findall(m[1] or m[2] or m[3] or ""))


def read(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The nodes, and the pieces of text in page order: ``(node, text)``; an empty text ends a block."""
    nodes = [Node("#root", -1, 0, frozenset())]
    stack, pieces, links, seen, at, size = [0], [], 0, 0, 0, len(html)

    def close(to: int) -> None:
        del stack[to:]
        pieces.append((stack[-1], ""))

    def shut(what: set, unless: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in what:
                return close(i)
            if tag in unless:
                return None
        return None

    while at < size:
        lt = html.find("<", at)
        lt = size if lt < 0 else lt
        if lt > at:
            text = unescape(html[at:lt])
            node = nodes[stack[-1]]
            if n := len(text.strip()):
                node.own, node.words, node.stops = node.own + n, node.words + text.count(" ") + 1, node.stops + text.count(".") + text.count(",")
                node.linked += n if links else 0
                seen += n
            pieces.append((stack[-1], text))
        if lt == size:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        m = NAME.match(html, lt)
        if not m:
            end = html.find(">", lt) if html.startswith(("<!", "<?", "</"), lt) else -2
            if end == -2:  # a mark that opens no tag is text
                nodes[stack[-1]].own += 1
                pieces.append((stack[-1], "<"))
            at = lt + 1 if end == -2 else size if end < 0 else end + 1
            continue
        rest = ATTRIBUTES.match(html, m.end())
        end = rest.end() if rest else html.find(">", m.end()) + 1 or size
        tag, closing, attributes, at = m[1].lower(), html[lt + 1] == "/", html[m.end() : end], end
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i]].tag == tag:
                        close(i)
                        break
                links = 0 if tag != "p" else links
            continue
        if tag in RAW:
            if not attributes.endswith("/>"):
                found = re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(html, at)
                at = size if not found else (html.find(">", found.start()) + 1 or size)
            continue
        if tag == "a":
            links = 1
        elif tag == "br":  # no block of its own: white space
            pieces.append((stack[-1], " "))
        elif tag == "hr":
            pieces.append((stack[-1], ""))
        if tag not in BLOCK:
            continue
        if nodes[stack[-1]].tag == "p":
            close(len(stack) - 1)
        if tag in ENDS:
            shut(*ENDS[tag])
        links = 0 if tag not in ("div", "p", "h1", "h2", "h3", "h4", "h5", "h6") else links
        pieces.append((stack[-1], ""))
        parent = stack[-1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, tokens(attributes) if len(attributes) > 6 else frozenset(), before=seen))
        nodes[parent].children.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
    return nodes, pieces
