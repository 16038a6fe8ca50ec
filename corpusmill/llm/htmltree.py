"""A small HTML tree: elements in document order with parents, and their own text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math".split())
#: Of these, what holds text only, to the end of the page if nothing closes it, and what may be self-closed.
PLAIN, FOREIGN = frozenset("script style textarea".split()), frozenset("svg math".split())
#: A slash at the end of an unquoted value is part of the value.
UNQUOTED = re.compile(r"""=\s*[^\s"'=<>`]+/\Z""")
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title head html br".split()
)
#: An opening tag ends these open elements, unless a scope element is between.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl select td th div article section main aside".split())
CLOSES_P = BLOCK - {"br", "html", "head", "body", "title"}
P_SCOPE = frozenset("html body table td th div article section main aside li blockquote".split())


@dataclass
class Tree:
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    #: (element, text) in document order; white space only is left out
    texts: list[tuple[int, str]] = field(default_factory=list)


def self_closed(tag: str, attributes: str) -> bool:
    return tag in FOREIGN and attributes.endswith("/") and not UNQUOTED.search(attributes)


def plain_end(source: str, tag: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
    return end.end() if end else len(source)


def raw_ends(source: str, at: int) -> dict[int, int]:
    """Where the raw elements from ``at`` on end, by the end of their opening tag; unclosed ones are left out."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in RAW - PLAIN}
    last = source.rfind(">") + 1
    while at < last and (m := TOKEN.search(source, at)):
        at = m.end()
        tag = (m.group(2) or "").lower()
        if tag in PLAIN and not m.group(1):
            at = plain_end(source, tag, at)
        elif tag in opened and not m.group(1):
            if not self_closed(tag, m.group(3)):
                opened[tag].append(at)
        elif tag in opened and opened[tag]:
            ends[opened[tag].pop()] = at
    return ends


def parse(source: str) -> Tree:
    """Elements and texts; unclosed and misnested tags are repaired, scripts and comments go.

    Linear in the page, however it is nested: where each tag was last opened is known.
    """
    tree = Tree()
    tags, parents, depths, tokens, texts = tree.tags, tree.parents, tree.depths, tree.tokens, tree.texts
    stack: list[int] = []
    opened: dict[str, list[int]] = {}  # where in the stack each tag stands
    at = 0
    last = source.rfind(">") + 1  # what follows can only be text, or a comment that is not closed
    ends: dict[int, int] | None = None

    def open_(tag: str, attributes: str) -> None:
        found: tuple[str, ...] = ()
        if "=" in attributes:
            found = tuple(t for name, *v in ATTRIBUTE.findall(attributes) if name.lower() != "href" for t in SPLIT.split("".join(v).lower()) if t)
        tags.append(tag)
        parents.append(stack[-1] if stack else -1)
        depths.append(len(stack))
        tokens.append(found)
        opened.setdefault(tag, []).append(len(stack))
        stack.append(len(tags) - 1)

    def cut(to: int) -> None:
        for i in range(len(stack) - 1, to - 1, -1):
            opened[tags[stack[i]]].pop()
        del stack[to:]

    def close_upto(names: tuple[str, ...], scope: frozenset[str]) -> None:
        at = max((opened[t][-1] for t in names if opened.get(t)), default=-1)
        if at >= 0 and not any(opened[t][-1] > at for t in scope if opened.get(t)):
            cut(at)

    def say(piece: str) -> None:
        if piece and not piece.isspace():
            if not stack:
                open_("html", "")
            texts.append((stack[-1], html.unescape(piece) if "&" in piece else piece))

    search = TOKEN.search
    while at < last and (m := search(source, at)):
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            close_upto((tag,), frozenset())
            continue
        if tag in RAW:
            if tag in PLAIN:
                at = plain_end(source, tag, at)
            elif not self_closed(tag, m.group(3)):
                if ends is None:
                    ends = raw_ends(source, m.start())
                at = ends.get(at, at)
            continue
        if tag in CLOSES_P:
            close_upto(("p",), P_SCOPE)
        if tag in ENDS:
            close_upto(ENDS[tag], SCOPE - {tag} - frozenset(ENDS[tag]))
        open_(tag, m.group(3))
        if tag in VOID:
            cut(len(stack) - 1)
    comment = source.find("<!--", at)
    say(source[at:] if comment < 0 else source[at:comment])
    return tree
