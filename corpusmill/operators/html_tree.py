"""Trees of HTML pages, built by the rules of the public standard: implied elements, insertion modes of tables and selects, active formatting
elements with the adoption agency, foster parenting, and foreign content.

Not taken over: framesets, the modes of templates (their content is a plain subtree), and comments, which are dropped. Every tag costs a bounded number
of steps, but for searches in the stack of open elements, which are skipped where a count says that there is nothing to find.
"""

from __future__ import annotations

import re
from html import escape, unescape


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# The element classes of the standard.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
HEAD = _set("title meta link base style script noscript template")
TABLE = _set("td th tr thead tbody tfoot caption colgroup col")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
ENDS_P = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp")
SPECIAL = ENDS_P | VOID | TABLE | HEADINGS | _set("applet basefont bgsound body button dd dt frame frameset head html iframe keygen li marquee noembed noframes noscript object script select style table template textarea title") - _set("dialog")
CLOSED_IN_SCOPE = _set("address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul")
SCOPE = _set("applet caption html table td th marquee object template")
BUTTON_SCOPE, LIST_SCOPE, TABLE_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}, _set("html table template")
IMPLIED = _set("dd dt li optgroup option p rb rp rt rtc")
FOSTERING = _set("table tbody tfoot thead tr")
BODIES = _set("tbody tfoot thead")
BREAKOUT = _set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var")
INTEGRATION = _set("foreignobject desc title mi mo mn ms mtext annotation-xml")
_SPACE = " \t\n\f\r"

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_ATTR_REF = re.compile(r"&(?:#\w+;?|\w+;|\w+(?![=\w]))")
_CDATA = re.compile(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", re.S)
_LIMITED = re.compile(r"""html\s+public\s+["'](?:-//(?:ietf|w3c)//dtd html (?:2|3|level|strict)|-//w3c//dtd html 4\.0?1? (?:transitional|frameset)//[^"']*["']\s*$)""", re.I)


class Node:
    __slots__ = ("attrs", "children", "count", "foreign", "id", "index", "last", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, foreign: bool = False):
        self.tag, self.attrs, self.parent, self.foreign = tag, attrs, parent, foreign
        self.children: list[Node | str] = []
        self.id = self.last = -1  # place in document order, and that of the last element below
        self.index = self.count = 0  # place among the parent's elements, and how many elements it has

    def elements(self) -> list[Node]:
        return [c for c in self.children if type(c) is not str]

    def walk(self):
        """Descendants in document order."""
        todo = self.elements()[::-1]
        while todo:
            n = todo.pop()
            yield n
            if n.children:
                todo += n.elements()[::-1]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if type(n) is str:
                out.append(n)
            else:
                todo += n.children[::-1]
        return "".join(out)

    def inner_html(self) -> str:
        out: list[str] = []
        todo: list = [(c, self) for c in self.children[::-1]]
        while todo:
            c, owner = todo.pop()
            if owner is None:
                out.append(c)  # an end tag
            elif isinstance(c, str):
                raw = owner.tag in RAW and owner.tag not in ("title", "textarea")
                out.append(c if raw else escape(c, quote=False).replace("\xa0", "&nbsp;"))
            else:
                out.append(c.start_tag())
                if c.tag not in VOID:
                    todo.append((f"</{c.tag}>", None))
                    todo += [(x, c) for x in c.children[::-1]]
        return "".join(out)

    def start_tag(self) -> str:
        return f"<{self.tag}" + "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in self.attrs.items()) + ">"

    def outer_html(self) -> str:
        return self.start_tag() + ("" if self.tag in VOID else f"{self.inner_html()}</{self.tag}>")

    def ancestors(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


def _attrs(text: str) -> dict:
    out: dict = {}
    for name, a, b, c in _ATTR.findall(text):
        v = a or b or c
        name = name.lower()
        if name not in out:
            out[name] = _ATTR_REF.sub(lambda m: unescape(m[0]), v) if "&" in v else v
    return out


class _Builder:
    """Holds the stack of open elements, the list of active formatting elements (None is a marker) and the insertion mode."""

    def __init__(self, fragment: bool):
        self.fragment = fragment
        self.root = Node("div" if fragment else "html", {}, None)
        self.head = self.body = self.root
        if not fragment:
            self.head, self.body = Node("head", {}, self.root), Node("body", {}, self.root)
            self.root.children += [self.head, self.body]
        self.stack: list[Node] = [self.root]
        self.open: dict[str, int] = {self.root.tag: 1}  # open elements by tag
        self.active: list[Node | None] = []
        self.mode = "body" if fragment else "before"
        self.form: Node | None = None
        self.foster = self.skip_feed = False
        self.quirks = not fragment

    # ---- the stack

    def push(self, n: Node) -> None:
        self.stack.append(n)
        self.open[n.tag] = self.open.get(n.tag, 0) + 1

    def pop(self) -> Node:
        n = self.stack.pop()
        self.open[n.tag] -= 1
        return n

    def pop_to(self, tags) -> None:
        while self.pop().tag not in tags:
            pass

    def drop(self, n: Node) -> None:
        """Take an element out of the middle of the stack."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] is n:
                del self.stack[k]
                self.open[n.tag] -= 1
                return

    def in_scope(self, tags: tuple[str, ...], scope=SCOPE) -> bool:
        count = self.open.get
        for t in tags:
            if count(t):
                break
        else:
            return False
        for n in reversed(self.stack):
            tag = n.tag
            if tag in tags:
                if not n.foreign:
                    return True
            elif tag in scope and not n.foreign or n.foreign and tag in INTEGRATION:
                return False
        return False

    def implied(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self.pop()

    def close_p(self) -> None:
        if self.open.get("p") and self.in_scope(("p",), BUTTON_SCOPE):
            self.implied("p")
            self.pop_to(("p",))

    def clear_to(self, tags) -> None:
        while self.stack[-1].tag not in tags and len(self.stack) > 1:
            self.pop()

    # ---- insertion

    def place(self) -> tuple[Node, int]:
        """The parent and the place in its children where a node goes; -1: at the end."""
        n = self.stack[-1]
        if not self.foster or n.tag not in FOSTERING:
            return n, -1
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k]
            if t.tag == "table":
                if t.parent is not None:
                    kids = t.parent.children
                    return t.parent, next(i for i in range(len(kids) - 1, -1, -1) if kids[i] is t)
                return self.stack[k - 1], -1
        return self.stack[0], -1

    def put(self, what: Node | str) -> None:
        parent, at = self.place()
        if at < 0:
            parent.children.append(what)
        else:
            parent.children.insert(at, what)
        if type(what) is not str:
            what.parent = parent

    def insert(self, tag: str, attrs: dict, foreign: bool = False) -> Node:
        stack = self.stack
        top = stack[-1]
        n = Node(tag, attrs, top, foreign)
        if self.foster:
            self.put(n)
        else:
            top.children.append(n)
        stack.append(n)
        self.open[tag] = self.open.get(tag, 0) + 1
        return n

    def leaf(self, tag: str, attrs: dict) -> None:
        self.put(Node(tag, attrs, None))

    # ---- active formatting elements

    def reconstruct(self) -> None:
        active, stack = self.active, self.stack
        k = len(active)
        while k and active[k - 1] is not None and active[k - 1] not in stack:
            k -= 1
        for i in range(k, len(active)):
            active[i] = self.insert(active[i].tag, dict(active[i].attrs))

    def _is_open(self, n: Node) -> bool:
        return bool(self.open.get(n.tag)) and n in self.stack

    def activate(self, n: Node) -> None:
        """At most three equal ones are kept since the last marker."""
        same = []
        for i in range(len(self.active) - 1, -1, -1):
            x = self.active[i]
            if x is None:
                break
            if x.tag == n.tag and x.attrs == n.attrs:
                same.append(i)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(n)

    def deactivate(self, n: Node) -> None:
        self.active = [x for x in self.active if x is not n]

    def to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        """The adoption agency: an end tag of a formatting element that may be closed out of turn."""
        top = self.stack[-1]
        if top.tag == tag:
            if top not in self.active:
                self.pop()
                return
            if self.active[-1] is top:  # closed in turn
                self.pop()
                self.active.pop()
                return
        for _ in range(8):
            made = None
            for x in reversed(self.active):
                if x is None or x.tag == tag:
                    made = x
                    break
            if made is None:
                self.other_end(tag)
                return
            if not self._is_open(made):
                self.deactivate(made)
                return
            if not self.in_scope((tag,)):
                return
            at = next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k] is made)
            block = next((k for k in range(at + 1, len(self.stack)) if self.stack[k].tag in SPECIAL), None)
            if block is None:
                while self.pop() is not made:
                    pass
                self.deactivate(made)
                return
            self._rearrange(made, at, block)

    def _rearrange(self, made: Node, at: int, block: int) -> None:
        furthest, common = self.stack[block], self.stack[at - 1]
        mark = next(i for i, x in enumerate(self.active) if x is made)
        last, steps = furthest, 0
        for k in range(block - 1, at, -1):
            steps += 1
            node = self.stack[k]
            listed = next((i for i, x in enumerate(self.active) if x is node), None)
            if listed is not None and steps > 3:
                del self.active[listed]
                mark -= listed < mark
                listed = None
            if listed is None:
                self.drop(node)
                continue
            fresh = Node(node.tag, dict(node.attrs), common)
            self.active[listed] = self.stack[k] = fresh
            if last is furthest:
                mark = listed + 1
            self._detach(last)
            fresh.children.append(last)
            last.parent, last = fresh, fresh
        self._detach(last)
        if common.tag in FOSTERING:
            before, self.foster = self.foster, True
            self.stack.append(common)  # so that the place is that of common
            parent, where = self.place()
            self.stack.pop()
            self.foster = before
        else:
            parent, where = common, -1
        if where < 0:
            parent.children.append(last)
        else:
            parent.children.insert(where, last)
        last.parent = parent
        fresh = Node(made.tag, dict(made.attrs), furthest)
        fresh.children, furthest.children = furthest.children, [fresh]
        for c in fresh.children:
            if type(c) is not str:
                c.parent = fresh
        gone = next(i for i, x in enumerate(self.active) if x is made)
        self.active.insert(mark, fresh)
        del self.active[gone + (gone >= mark)]
        self.drop(made)
        k = next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k] is furthest)
        self.stack.insert(k + 1, fresh)
        self.open[fresh.tag] = self.open.get(fresh.tag, 0) + 1

    @staticmethod
    def _detach(n: Node) -> None:
        kids = n.parent.children if n.parent is not None else []
        for i in range(len(kids) - 1, -1, -1):
            if kids[i] is n:
                del kids[i]
                return

    # ---- text

    def text(self, t: str) -> None:
        if self.skip_feed:
            self.skip_feed = False
            if t[0] == "\n":
                t = t[1:]
                if not t:
                    return
        mode = self.mode
        if mode == "body" or mode == "cell":
            if self.active and not self.stack[-1].foreign:
                self.reconstruct()
            self.stack[-1].children.append(t)
            return
        if mode in ("before", "head", "after"):
            if self.open.get("template"):
                self.put(t)
                return
            rest = t.lstrip(_SPACE)
            if len(rest) < len(t):
                space = t[: len(t) - len(rest)]
                if mode == "head":
                    self.head.children.append(space)
                elif mode == "after":
                    self.root.children.insert(-1, space)
            if rest:
                self.begin_body()
                self.text(rest)
        elif mode in ("table", "rows", "row") and self.stack[-1].tag in FOSTERING:
            if t.strip(_SPACE):
                self.foster = True
                self.reconstruct()
                self.put(t)
                self.foster = False
            else:
                self.put(t)
        elif mode == "columns":
            rest = t.lstrip(_SPACE)
            if len(rest) < len(t):
                self.put(t[: len(t) - len(rest)])
            if rest:
                self.leave_columns()
                self.text(rest)
        else:
            if mode != "select":
                self.reconstruct()
            self.put(t)

    # ---- modes

    def begin_body(self) -> None:
        self.mode = "body"
        del self.stack[1:]
        self.open = {self.root.tag: 1}
        self.push(self.body)

    def reset(self) -> None:
        for n in reversed(self.stack):
            found = _MODE_OF.get(n.tag) if not n.foreign else None
            if found:
                self.mode = found
                return
        self.mode = "body"

    def leave_columns(self) -> None:
        if self.stack[-1].tag == "colgroup":
            self.pop()
        self.mode = "table"

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        self.skip_feed = False
        top = self.stack[-1]
        if top.foreign and not self._foreign_start(top, tag, attrs, closed):
            return
        mode = self.mode
        if mode == "body":
            self.body_start(tag, attrs, closed)
        else:
            getattr(self, "_start_" + mode)(tag, attrs, closed)

    def end(self, tag: str) -> None:
        self.skip_feed = False
        if self.stack[-1].foreign and self._foreign_end(tag):
            return
        mode = self.mode
        if mode == "body":
            self.body_end(tag)
        else:
            getattr(self, "_end_" + mode)(tag)

    def _foreign_start(self, top: Node, tag: str, attrs: dict, closed: bool) -> bool:
        """Whether the tag is one of HTML, for which foreign elements have been closed, or which stands at an integration point."""
        if top.tag in INTEGRATION and tag not in ("mglyph", "malignmark"):
            return True
        if tag in BREAKOUT or tag == "font" and not attrs.keys().isdisjoint(("color", "face", "size")):
            while self.stack[-1].foreign and self.stack[-1].tag not in INTEGRATION:
                self.pop()
            return True
        n = self.insert(tag, attrs, True)
        if closed:
            self.stack.pop()
            self.open[n.tag] -= 1
        return False

    def _foreign_end(self, tag: str) -> bool:
        if tag in ("br", "p"):
            while self.stack[-1].foreign and self.stack[-1].tag not in INTEGRATION:
                self.pop()
            return False
        for k in range(len(self.stack) - 1, -1, -1):
            n = self.stack[k]
            if not n.foreign:
                return False
            if n.tag == tag:
                while self.pop() is not n:
                    pass
                return True
        return False

    # ---- before the body

    def _start_before(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("html", "head"):
            self._merge(tag, attrs)
            if tag == "head":
                self.mode = "head"
        elif tag in HEAD:
            self.mode = "head"
            self._start_head(tag, attrs, closed)
        else:
            self._start_after(tag, attrs, closed)

    def _start_head(self, tag: str, attrs: dict, closed: bool) -> None:
        if len(self.stack) > 1:  # below an open noscript or template
            self.body_start(tag, attrs, closed)
            return
        if tag in HEAD:
            n = Node(tag, attrs, self.head)
            self.head.children.append(n)
            if tag in ("noscript", "template"):
                self.push(n)
            elif tag not in VOID:
                self.push(n)  # raw text, which the tokens' loop takes off at once
        elif tag in ("html", "head"):
            self._merge(tag, attrs)
        else:
            self._start_after(tag, attrs, closed)

    def _start_after(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in HEAD:
            self._start_head(tag, attrs, closed)
        elif tag == "html":
            self._merge(tag, attrs)
        elif tag != "head":
            self.begin_body()
            if tag == "body":
                self._merge(tag, attrs)
            else:
                self.body_start(tag, attrs, closed)

    def _merge(self, tag: str, attrs: dict) -> None:
        if not self.fragment:
            target = {"html": self.root, "head": self.head, "body": self.body}[tag]
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)

    def _end_before(self, tag: str) -> None:
        if tag in ("body", "html", "br"):
            self.begin_body()
            self.body_end(tag)
        elif tag == "head":
            self.mode = "after"

    def _end_head(self, tag: str) -> None:
        if len(self.stack) > 1 and self.open.get(tag):
            self.pop_to((tag,))
        elif tag == "head":
            del self.stack[1:]
            self.open = {self.root.tag: 1}
            self.mode = "after"
        else:
            self._end_before(tag)

    _end_after = _end_head

    # ---- in the body

    def body_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in FORMATTING:
            if tag == "a":
                old = next((x for x in reversed(self.active) if x is None or x.tag == "a"), None)
                if old is not None:
                    self.adopt("a")
                    self.deactivate(old)
                    self.drop(old)
            if self.active:
                self.reconstruct()
            if tag == "nobr" and self.in_scope(("nobr",)):
                self.adopt("nobr")
                self.reconstruct()
            self.activate(self.insert(tag, attrs))
            return
        if tag in ENDS_P:
            if self.open.get("p") and not (tag == "table" and self.quirks):
                self.close_p()
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.pop()
            elif tag == "form":
                if self.form is not None and not self.open.get("template"):
                    return
                self.form = self.insert(tag, attrs)
                return
            elif tag == "hr":
                self.leaf(tag, attrs)
                return
            elif tag == "xmp" and self.active:
                self.reconstruct()
            self.insert(tag, attrs)
            if tag == "table":
                self.mode = "table"
            self.skip_feed = tag in ("pre", "listing")
            return
        special = _IN_BODY.get(tag)
        if special is not None:
            special(self, tag, attrs, closed)
            return
        if self.active:
            self.reconstruct()
        if tag in VOID:
            self.leaf(tag, attrs)
        else:
            self.insert(tag, attrs)

    def _item(self, tag: str, attrs: dict, closed: bool) -> None:
        own = ("li",) if tag == "li" else ("dd", "dt")
        if self.open.get(own[0]) or self.open.get(own[-1]):
            for n in reversed(self.stack):
                if n.tag in own and not n.foreign:
                    self.implied(n.tag)
                    self.pop_to((n.tag,))
                    break
                if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                    break
        self.close_p()
        self.insert(tag, attrs)

    def _option(self, tag: str, attrs: dict, closed: bool) -> None:
        if self.stack[-1].tag == "option":
            self.pop()
        self.reconstruct()
        self.insert(tag, attrs)

    def _ruby(self, tag: str, attrs: dict, closed: bool) -> None:
        if self.in_scope(("ruby",)):
            self.implied("rtc" if tag in ("rp", "rt") else "")
        self.insert(tag, attrs)

    def _button(self, tag: str, attrs: dict, closed: bool) -> None:
        if self.in_scope(("button",)):
            self.implied()
            self.pop_to(("button",))
        self.reconstruct()
        self.insert(tag, attrs)

    def _marked(self, tag: str, attrs: dict, closed: bool) -> None:
        self.reconstruct()
        self.insert(tag, attrs)
        self.active.append(None)

    def _select(self, tag: str, attrs: dict, closed: bool) -> None:
        self.reconstruct()
        self.insert(tag, attrs)
        self.mode = "select"

    def _foreign(self, tag: str, attrs: dict, closed: bool) -> None:
        self.reconstruct()
        n = self.insert(tag, attrs, True)
        if closed:
            self.stack.pop()
            self.open[n.tag] -= 1

    def _plain(self, tag: str, attrs: dict, closed: bool) -> None:
        """Without formatting around it."""
        if tag in VOID:
            self.leaf(tag, attrs)
        else:
            self.insert(tag, attrs)
            self.skip_feed = tag == "textarea"

    def body_end(self, tag: str) -> None:
        if tag in FORMATTING:
            self.adopt(tag)
        elif self.stack[-1].tag == tag and tag not in _ODD_ENDS:  # closed in turn
            self.pop()
        elif tag == "p":
            if not self.in_scope(("p",), BUTTON_SCOPE):
                self.insert("p", {})
            self.implied("p")
            self.pop_to(("p",))
        elif tag in CLOSED_IN_SCOPE:
            if self.in_scope((tag,)):
                self.implied()
                self.pop_to((tag,))
        elif tag in ("li", "dd", "dt"):
            if self.in_scope((tag,), LIST_SCOPE if tag == "li" else SCOPE):
                self.implied(tag)
                self.pop_to((tag,))
        elif tag in HEADINGS:
            if self.in_scope(tuple(HEADINGS)):
                self.implied()
                self.pop_to(HEADINGS)
        elif tag == "form":
            n, self.form = self.form, None
            if n is not None and self._is_open(n) and self.in_scope(("form",)):
                self.implied()
                self.drop(n)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope((tag,)):
                self.implied()
                self.pop_to((tag,))
                self.to_marker()
        elif tag == "br":
            self.body_start("br", {}, False)
        elif tag not in ("body", "html", "head") and tag not in VOID:
            self.other_end(tag)

    def other_end(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            n = self.stack[k]
            if n.tag == tag:
                self.implied(tag)
                while len(self.stack) > k:
                    self.pop()
                if tag == "template":
                    self.reset()
                return
            if n.tag in SPECIAL:
                return

    # ---- in tables

    def _fostered(self, run, *args) -> None:
        self.foster = True
        run(*args)
        self.foster = False

    def _start_table(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "caption":
            self.clear_to(TABLE_SCOPE)
            self.active.append(None)
            self.insert(tag, attrs)
            self.mode = "caption"
        elif tag in ("colgroup", "col"):
            self.clear_to(TABLE_SCOPE)
            self.insert("colgroup", attrs if tag == "colgroup" else {})
            self.mode = "columns"
            if tag == "col":
                self.leaf(tag, attrs)
        elif tag in BODIES or tag in ("td", "th", "tr"):
            self.clear_to(TABLE_SCOPE)
            self.insert(tag if tag in BODIES else "tbody", attrs if tag in BODIES else {})
            self.mode = "rows"
            if tag not in BODIES:
                self._start_rows(tag, attrs, closed)
        elif tag == "table":
            if self.in_scope(("table",), TABLE_SCOPE):
                self.pop_to(("table",))
                self.reset()
                self.start(tag, attrs, closed)
        elif tag in ("style", "script", "template") or tag == "input" and attrs.get("type", "").lower() == "hidden":
            self._plain(tag, attrs, closed)
        elif tag == "form":
            if self.form is None:
                self.form = self.insert(tag, attrs)
                self.pop()
        else:
            self._fostered(self.body_start, tag, attrs, closed)

    def _end_table(self, tag: str) -> None:
        if tag == "table":
            if self.in_scope(("table",), TABLE_SCOPE):
                self.pop_to(("table",))
                self.reset()
        elif tag not in TABLE and tag not in ("body", "html"):
            self._fostered(self.body_end, tag)

    def _start_caption(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in TABLE:
            if self._leave(("caption",)):
                self.start(tag, attrs, closed)
        else:
            self.body_start(tag, attrs, closed)

    def _end_caption(self, tag: str) -> None:
        if tag in ("caption", "table"):
            if self._leave(("caption",)) and tag == "table":
                self.end(tag)
        elif tag not in TABLE and tag not in ("body", "html"):
            self.body_end(tag)

    def _leave(self, tags: tuple[str, ...]) -> bool:
        """Close a caption or cell."""
        if not self.in_scope(tags, TABLE_SCOPE):
            return False
        self.implied()
        self.pop_to(tags)
        self.to_marker()
        self.mode = "table" if tags == ("caption",) else "row"
        return True

    def _start_columns(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "col":
            self.leaf(tag, attrs)
        elif tag == "template":
            self._plain(tag, attrs, closed)
        else:
            self.leave_columns()
            self.start(tag, attrs, closed)

    def _end_columns(self, tag: str) -> None:
        if tag == "colgroup":
            self.leave_columns()
        elif tag != "col":
            self.leave_columns()
            self.end(tag)

    def _start_rows(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("tr", "td", "th"):
            self.clear_to(BODIES | {"html", "template"})
            self.insert("tr", attrs if tag == "tr" else {})
            self.mode = "row"
            if tag != "tr":
                self._start_row(tag, attrs, closed)
        elif tag in TABLE:
            if self._leave_rows():
                self.start(tag, attrs, closed)
        else:
            self._start_table(tag, attrs, closed)

    def _end_rows(self, tag: str) -> None:
        if tag in BODIES:
            if self.in_scope((tag,), TABLE_SCOPE):
                self._leave_rows()
        elif tag == "table":
            if self._leave_rows():
                self.end(tag)
        else:
            self._end_table(tag)

    def _leave_rows(self) -> bool:
        if not self.in_scope(tuple(BODIES), TABLE_SCOPE):
            return False
        self.clear_to(BODIES | {"html", "template"})
        self.pop()
        self.mode = "table"
        return True

    def _start_row(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("td", "th"):
            self.clear_to(("tr", "html", "template"))
            self.insert(tag, attrs)
            self.mode = "cell"
            self.active.append(None)
        elif tag in TABLE:
            if self._leave_row():
                self.start(tag, attrs, closed)
        else:
            self._start_table(tag, attrs, closed)

    def _end_row(self, tag: str) -> None:
        if tag == "tr":
            self._leave_row()
        elif tag == "table" or tag in BODIES and self.in_scope((tag,), TABLE_SCOPE):
            if self._leave_row():
                self.end(tag)
        else:
            self._end_table(tag)

    def _leave_row(self) -> bool:
        if not self.in_scope(("tr",), TABLE_SCOPE):
            return False
        self.clear_to(("tr", "html", "template"))
        self.pop()
        self.mode = "rows"
        return True

    def _start_cell(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in TABLE:
            if self._leave(("td", "th")):
                self.start(tag, attrs, closed)
        else:
            self.body_start(tag, attrs, closed)

    def _end_cell(self, tag: str) -> None:
        if tag in ("td", "th"):
            if self.in_scope((tag,), TABLE_SCOPE):
                self.implied()
                self.pop_to((tag,))
                self.to_marker()
                self.mode = "row"
        elif tag in FOSTERING:
            if self.in_scope((tag,), TABLE_SCOPE) and self._leave(("td", "th")):
                self.end(tag)
        elif tag not in TABLE and tag not in ("body", "html"):
            self.body_end(tag)

    # ---- in a select

    def _start_select(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("option", "optgroup", "hr"):
            if self.stack[-1].tag == "option":
                self.pop()
            if tag != "option" and self.stack[-1].tag == "optgroup":
                self.pop()
            if tag == "hr":
                self.leaf(tag, attrs)
            else:
                self.insert(tag, attrs)
        elif tag in ("script", "template"):
            self._plain(tag, attrs, closed)
        elif tag in ("select", "input", "keygen", "textarea") or (tag in TABLE or tag == "table") and self.open.get("table"):
            self.pop_to(("select",))
            self.reset()
            if tag != "select":
                self.start(tag, attrs, closed)

    def _end_select(self, tag: str) -> None:
        if tag == "optgroup":
            if self.stack[-1].tag == "option" and self.stack[-2].tag == "optgroup":
                self.pop()
            if self.stack[-1].tag == "optgroup":
                self.pop()
        elif tag == "option":
            if self.stack[-1].tag == "option":
                self.pop()
        elif tag == "template":
            self.other_end(tag)
        elif tag == "select" or (tag in FOSTERING or tag in TABLE) and self.in_scope((tag,), TABLE_SCOPE):
            self.pop_to(("select",))
            self.reset()
            if tag != "select":
                self.end(tag)


_ODD_ENDS = TABLE | _set("applet marquee object form template select body html head table option optgroup")
_MODE_OF = {"td": "cell", "th": "cell", "tr": "row", "tbody": "rows", "thead": "rows", "tfoot": "rows", "caption": "caption", "colgroup": "columns", "table": "table", "select": "select", "body": "body", "template": "body"}
_IN_BODY = dict.fromkeys(("li", "dd", "dt"), _Builder._item) | dict.fromkeys(("option", "optgroup"), _Builder._option) | dict.fromkeys(("rb", "rtc", "rp", "rt"), _Builder._ruby) | dict.fromkeys(("applet", "marquee", "object"), _Builder._marked)
_IN_BODY |= dict.fromkeys(("math", "svg"), _Builder._foreign) | dict.fromkeys(("param", "source", "track", "base", "link", "meta", "script", "style", "template", "title", "noframes", "noembed", "iframe", "textarea"), _Builder._plain)
_IN_BODY |= {"button": _Builder._button, "select": _Builder._select} | dict.fromkeys(("html", "body"), lambda b, tag, attrs, closed: b._merge(tag, attrs)) | dict.fromkeys((*TABLE, "head", "frame", "frameset"), lambda b, tag, attrs, closed: None)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for tag in RAW}


def parse(html: str, fragment: bool = False) -> Node:
    """The html element of a page, with head and body, or a div around a fragment. Input that breaks off is closed."""
    if "\r" in html:
        html = html.replace("\r\n", "\n").replace("\r", "\n")
    b, at, size, search = _Builder(fragment), 0, len(html), _TOKEN.search
    while at < size:
        m = search(html, at)
        begin = m.start() if m else size
        if begin > at:
            t = html[at:begin]
            b.text(unescape(t) if "&" in t else t)
        if not m:
            break
        at = m.end()
        end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if b.stack[-1].foreign and html.startswith("<![CDATA[", begin):
                data = _CDATA.match(html, begin)
                at = data.end()
                if data[1]:
                    b.text(data[1])
            elif html[begin + 2 : begin + 9].lower() == "doctype" and b.mode == "before":
                name = html[begin + 9 : at - 1].strip()
                b.quirks = name[:4].lower() != "html" or bool(_LIMITED.match(name))
            continue
        tag = tag.lower()
        if end:
            b.end(tag)
            continue
        if tag == "image" and not b.stack[-1].foreign:
            tag = "img"
        b.start(tag, _attrs(rest) if rest else {}, rest.endswith("/"))
        if tag in RAW and not (n := b.stack[-1]).foreign and n.tag == tag and not n.children:
            over = _ENDS[tag].search(html, at)
            inner, at = (html[at : over.start()], over.end()) if over else (html[at:], size)
            if tag == "textarea" and inner[:1] == "\n":
                inner = inner[1:]
            if inner:
                n.children.append(unescape(inner) if tag in ("title", "textarea") else inner)
            b.pop()
            b.skip_feed = False
        elif tag == "plaintext" and b.stack[-1].tag == tag:
            if html[at:]:
                b.stack[-1].children.append(html[at:])
            break
    return numbered(b.root)


def parse_fragment(html: str) -> Node:
    """The first element of a fragment; table parts keep their tag; without an element, the div that holds the text."""
    first = re.search(r"<([a-zA-Z][^\s/>]*)", html)
    if first and first[1].lower() in TABLE:
        return next((n for n in parse(f"<table>{html}</table>", fragment=True).walk() if n.tag == first[1].lower()), parse(html, fragment=True))
    root = parse(html, fragment=True)
    return next(root.walk(), root)


def numbered(root: Node) -> Node:
    """Elements numbered in document order and among their siblings; texts that follow one another become one."""
    todo, order = [root], []
    while todo:
        n = todo.pop()
        n.id = n.last = len(order)
        order.append(n)
        kids, texts, k = n.children, 0, 0
        for c in kids:
            if type(c) is str:
                texts += 1
            else:
                c.index = k
                k += 1
        n.count = k
        if texts > 1 and any(type(a) is str and type(b) is str for a, b in zip(kids, kids[1:], strict=False)):
            merged: list = []
            run: list[str] = []
            for c in kids:
                if type(c) is str:
                    run.append(c)
                    continue
                if run:
                    merged.append("".join(run))
                    run = []
                merged.append(c)
            if run:
                merged.append("".join(run))
            n.children = merged
        if k == len(kids):
            todo += kids[::-1]
        elif k:
            todo += [c for c in reversed(kids) if type(c) is not str]
    for n in reversed(order[1:]):
        if n.last > n.parent.last:
            n.parent.last = n.last
    return root
