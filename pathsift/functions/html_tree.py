"""Tolerant HTML tree building for the node-explosion job (one page per call).

Runs inside ``mapInPandas`` tasks: Spark partitions the pages, this module
turns one page's markup into flat node records.  Parsing follows the classic
libxml2 HTML recovery rules that matter for article pages:

* a ``<p>`` start closes an open ``<p>`` together with inline font-style tags
  still open inside it; block starts (``div``, lists, headings, ...) close an
  open ``<p>``;
* void elements never open a level; ``script``/``style`` content is raw text;
* an end tag with no open element is ignored, and an end tag never closes
  across an element of higher end priority (``</span>`` cannot close a div);
* ``html``/``head``/``body`` are implied when missing.
"""

from __future__ import annotations

from html.parser import HTMLParser

from .constants import EMPTY, SKIP_CHILD_TAGS, STRUCTURAL_TAGS

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr", "keygen", "command", "basefont", "frame", "isindex"}
HEAD_TAGS = {"title", "meta", "link", "style", "script", "base", "noscript"}
FONTSTYLE = {"tt", "i", "b", "u", "s", "strike", "big", "small"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCK_CLOSES_P = {"div", "ul", "ol", "dl", "table", "form", "pre", "blockquote", "address",
                   "center", "menu", "dir", "listing", "xmp", "hr", "fieldset"}
END_PRIORITY = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
                "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}


def _closes(new: str, cur: str) -> bool:
    """Does a start tag ``new`` implicitly close the open element ``cur``?"""
    if new == "p":
        return cur == "p" or cur in HEADINGS or cur in FONTSTYLE
    if new in HEADINGS:
        return cur == "p" or cur in HEADINGS
    if new in _BLOCK_CLOSES_P:
        return cur == "p"
    if new == "li":
        return cur in ("li", "p")
    if new in ("dt", "dd"):
        return cur in ("dt", "dd", "p")
    if new == "option":
        return cur == "option"
    if new == "tr":
        return cur in ("tr", "td", "th")
    if new in ("td", "th"):
        return cur in ("td", "th")
    if new in ("thead", "tbody", "tfoot"):
        return cur in ("thead", "tbody", "tfoot", "tr", "td", "th")
    return False


class Node:
    __slots__ = ("tag", "attrs", "children", "text", "tail", "parent")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag = tag
        self.attrs = attrs or {}
        self.children = []
        self.text = ""
        self.tail = ""
        self.parent = parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.head = None
        self.body = None
        self.stack = [self.root]
        self.doctype = None
        self.failed = False

    # -- structure helpers
    def _cur(self):
        return self.stack[-1]

    def _append(self, node):
        node.parent = self._cur()
        self._cur().children.append(node)

    def _close_head(self):
        while len(self.stack) > 1 and self.head is not None and self.head in self.stack:
            self.stack.pop()

    def _ensure_body(self):
        if self.body is None:
            self._close_head()
            self.stack = [self.root]
            self.body = Node("body")
            self._append(self.body)
            self.stack.append(self.body)

    # -- parser callbacks
    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:      # a marked section of unknown name, as <![foo]>: a comment up to its ">"
            return self.parse_bogus_comment(i)

    def handle_decl(self, decl):
        if self.doctype is None and decl[:7].upper() == "DOCTYPE":
            self.doctype = decl[7:].strip()

    def handle_starttag(self, tag, attrs):
        a = {k: (v if v is not None else "") for k, v in attrs}
        if tag == "html":
            for k, v in a.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = Node("head", a)
                self._append(self.head)
                self.stack.append(self.head)
            return
        if tag == "body":
            if self.body is None:
                self._close_head()
                self.stack = [self.root]
                self.body = Node("body", a)
                self._append(self.body)
                self.stack.append(self.body)
            return
        if self.body is None:
            if tag in HEAD_TAGS:
                if self.head is None:
                    self.head = Node("head")
                    self._append(self.head)
                    self.stack.append(self.head)
            else:
                self._ensure_body()
        while len(self.stack) > 1 and _closes(tag, self._cur().tag):
            self.stack.pop()
        node = Node(tag, a)
        self._append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "head", "body") and self._cur().tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return  # content after </body> still belongs to body
        if tag == "head":
            self._close_head()
            return
        limit = END_PRIORITY.get(tag, 100)
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t == tag:
                del self.stack[i:]
                return
            if END_PRIORITY.get(t, 100) > limit:
                return

    def handle_data(self, data):
        cur = self._cur()
        if cur is self.root or cur is self.head:
            if not data.strip():
                return
            self._ensure_body()
            cur = self._cur()
        if cur.children:
            cur.children[-1].tail += data
        else:
            cur.text += data

    def handle_comment(self, data):
        if self.body is None and self._cur() is self.root:
            return
        c = Node("#comment")
        c.text = data
        self._append(c)


def parse(html: str) -> _Builder:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except (AssertionError, ValueError):  # the parser's own errors: what was built is only a part of the page
        b.failed = True
    return b


def collapse(s: str) -> str:
    return " ".join(s.split())


def _text(n: Node, skip=("script", "style")) -> str:
    """Text of ``n`` and its descendants (not its tail), comments excluded."""
    out, stack = [], [(n, False)]
    while stack:            # an explicit stack: nesting may be thousands deep
        node, is_tail = stack.pop()
        if is_tail:
            out.append(node.tail)
            continue
        if node.tag == "#comment":
            continue
        if node.tag not in skip:
            out.append(node.text)
        elif node is not n:
            continue
        for c in reversed(node.children):
            stack += [(c, True), (c, False)]
    return "".join(out)


def own_text(n: Node) -> str:
    """Serialized non-structural, non-script children with their tails."""
    parts = []
    for c in n.children:
        if c.tag == "#comment":
            parts.append(c.tail)
        elif c.tag in SKIP_CHILD_TAGS or c.tag in STRUCTURAL_TAGS:
            continue
        else:
            parts.append(_text(c) + c.tail)
    return collapse(" ".join(parts))


def direct_text(n: Node) -> str:
    """D5 with the sentinel for a node without text."""
    return own_text(n) or EMPTY


def child_text(n: Node) -> str:
    """Full string value of children that have own leading text, no tails."""
    parts = []
    for c in n.children:
        if c.tag in SKIP_CHILD_TAGS or not c.text:
            continue
        parts.append(c.text if c.tag == "#comment" else _text(c, skip=()))
    return collapse(" ".join(parts)) or EMPTY


_CLEANED = ("script", "style", "embed", "object", "applet", "iframe", "frame", "frameset",
            "meta", "param")


def subtree_text(n: Node) -> str:
    """All text below the node after removing scripts, styles, embeds, frames, meta."""
    return collapse(_text(n, skip=_CLEANED)) or EMPTY


def page_records(html: str):
    """Return (title, doctype, nodes) for one page (see :func:`parsed_page`)."""
    return parsed_page(html)[:3]


def parsed_page(html: str):
    """Return (title, doctype, nodes, failed) for one page.

    ``nodes`` lists every structural element in document order as
    ``(abs_path, tag_path, positions, chain, in_body, node)``: ``abs_path`` is
    the element path with an index only where same-tag siblings exist,
    ``positions`` the 1-based same-tag position at every step, ``chain`` the
    tags strictly between ``body`` and the element.  A page that can't be
    parsed to its end has no nodes.
    """
    b = parse(html)
    if b.failed:
        return None, None, [], True
    title = None
    stack = [(b.root, "/html", "/html", [1], [], False)]
    out = []
    while stack:
        node, apath, tpath, pos, chain, in_body = stack.pop()
        if title is None and node.tag == "title":
            title = node.text
        if node.tag in STRUCTURAL_TAGS:
            out.append((apath, tpath, pos, chain, in_body, node))
        elems = [c for c in node.children if c.tag != "#comment"]
        counts, seen = {}, {}
        for c in elems:
            counts[c.tag] = counts.get(c.tag, 0) + 1
        if node is b.body:
            kid_chain, kid_in = [], True
        elif in_body:
            kid_chain, kid_in = chain + [node.tag], True
        else:
            kid_chain, kid_in = [], False
        kids = []
        for c in elems:
            seen[c.tag] = seen.get(c.tag, 0) + 1
            step = c.tag if counts[c.tag] == 1 else f"{c.tag}[{seen[c.tag]}]"
            kids.append((c, f"{apath}/{step}", f"{tpath}/{c.tag}", pos + [seen[c.tag]],
                         kid_chain, kid_in))
        stack.extend(reversed(kids))
    return title, b.doctype, out, False
