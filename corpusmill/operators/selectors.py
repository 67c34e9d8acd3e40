"""CSS selectors, many at once in one walk over a tree.

A selector is a sequence of compounds joined by combinators. Every compound of every selector is a bit. Going through the elements in document
order, an element's bits are those compounds that it satisfies and whose left neighbour has been satisfied where the combinator asks: above it, by its
parent, by the sibling before, or by any sibling before. Bits of ancestors and of earlier siblings are kept as unions, so nothing is tried twice, and
the work is in proportion to the elements. Which compounds an element is tested for at all is found by its id, classes and tag.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

from corpusmill.operators.html_tree import Node

_ESCAPE = r"\\(?:[0-9a-fA-F]{1,6}[ \t\n\r\f]?|[^\n\r\f0-9a-fA-F])"
_IDENT = rf"(?:--|-?(?:[a-zA-Z_]|[^\x00-\x7f]|{_ESCAPE}))(?:[\w-]|[^\x00-\x7f]|{_ESCAPE})*"
_SIMPLE = re.compile(rf"""(?P<tag>\*|{_IDENT})|\#(?P<id>{_IDENT})|\.(?P<cls>{_IDENT})|\[\s*(?P<attr>{_IDENT}|[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<v1>(?:\\.|[^"\\])*)"|'(?P<v2>(?:\\.|[^'\\])*)'|(?P<v3>{_IDENT}))\s*(?P<flag>[iIsS])?\s*)?\]|:(?P<pseudo>[a-zA-Z-]+)(?P<open>\()?""", re.S)
_NTH = re.compile(r"\s*(?:([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$")
_PLAIN = {"first-child": (False, False), "last-child": (True, False), "first-of-type": (False, True), "last-of-type": (True, True)}
_COUNTED = {"nth-child": (False, False), "nth-last-child": (True, False), "nth-of-type": (False, True), "nth-last-of-type": (True, True)}


class SelectorError(ValueError):
    pass


def _plain(text: str) -> str:
    def one(m):
        x = m[0][1:].strip()
        return chr(int(x, 16)) if re.fullmatch("[0-9a-fA-F]{1,6}", x) and int(x, 16) <= 0x10FFFF else m[0][1:]

    return re.sub(_ESCAPE, one, text) if "\\" in text else text


def _nth(text: str) -> tuple[int, int]:
    text = text.strip().lower()
    m = _NTH.match({"odd": "2n+1", "even": "2n"}.get(text, text))
    if not m:
        raise SelectorError(text)
    if m[4]:
        return 0, int(m[4])
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    return a, int((m[2] or "+") + (m[3] or "0"))


# A test is a tuple that begins with its kind; a complex selector a tuple of (combinator, tests), the first combinator being "".


def _closing(css: str, at: int) -> int:
    """The place of the bracket that closes the one before at."""
    depth, quote = 1, ""
    while at < len(css):
        c = css[at]
        if c == "\\":
            at += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return at
        at += 1
    raise SelectorError(css)


def _pseudo(name: str, inner: str | None) -> list[tuple]:
    if inner is None:
        if name in _PLAIN:
            return [("nth", 0, 1, *_PLAIN[name])]
        if name in ("only-child", "only-of-type"):
            return [("nth", 0, 1, end, name == "only-of-type") for end in (False, True)]
        if name in ("empty", "root"):
            return [(name,)]
    elif name in _COUNTED:
        return [("nth", *_nth(inner), *_COUNTED[name])]
    elif name in ("is", "where", "matches", "any", "not"):
        return [("not" if name == "not" else "is", parse_list(inner))]
    elif name == "has":
        return [("has", parse_list(inner, relative=True))]
    raise SelectorError(name)


def _compound(css: str, at: int) -> tuple[tuple, int]:
    tests: list[tuple] = []
    while at < len(css):
        m = _SIMPLE.match(css, at)
        if not m:
            break
        if m["tag"] and tests:
            raise SelectorError(css)
        at = m.end()
        if m["tag"]:
            tests.append(("any",) if m["tag"] == "*" else ("tag", _plain(m["tag"]).lower()))
        elif m["id"]:
            tests.append(("id", _plain(m["id"])))
        elif m["cls"]:
            tests.append(("class", _plain(m["cls"])))
        elif m["attr"]:
            v = next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), None)
            tests.append(("attr", _plain(m["attr"]).lower(), m["op"], None if v is None else _plain(v), (m["flag"] or "").lower() == "i"))
        else:
            inner = None
            if m["open"]:
                end = _closing(css, at)
                inner, at = css[at:end], end + 1
            tests += _pseudo(m["pseudo"].lower(), inner)
    if not tests:
        raise SelectorError(css)
    return tuple(tests), at


def parse_list(css: str, relative: bool = False) -> tuple:
    """The complex selectors of a list; SelectorError if css is none. relative: a combinator may come first, and a blank stands for none."""
    out, parts, at, css = [], [], 0, css.strip()
    comb = ""
    if relative:
        m = re.match(r"\s*([>+~])?\s*", css)
        comb, at = m[1] or " ", m.end()
    while True:
        tests, at = _compound(css, at)
        parts.append((comb, tests))
        gap = re.match(r"\s*([>+~,]?)\s*", css[at:])
        between, at = css[at : at + gap.end()], at + gap.end()
        if at >= len(css) and not gap[1]:
            out.append(tuple(parts))
            return tuple(out)
        if not between or at >= len(css):
            raise SelectorError(css)
        if gap[1] == ",":
            out.append(tuple(parts))
            parts, comb = [], ""
            if relative:
                m = re.match(r"([>+~])?\s*", css[at:])
                comb, at = m[1] or " ", at + m.end()
        else:
            comb = gap[1] or " "


def _attr_test(own: str | None, op: str | None, v: str | None, fold: bool) -> bool:
    if own is None:
        return False
    if op is None:
        return True
    if fold:
        own, v = own.lower(), v.lower()
    if op == "=":
        return own == v
    if op == "|=":
        return own == v or own.startswith(v + "-")
    if not v:
        return False
    if op == "~=":
        return v in own.split()
    return own.startswith(v) if op == "^=" else own.endswith(v) if op == "$=" else v in own


def counted(k: int, a: int, b: int) -> bool:
    """Whether k, from 1, is a * n + b for some n from 0."""
    return k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


class Program:
    """Selectors by name as bits. first: compounds that stand first; after: by combinator, those with a compound after them; ends: by
    name, the last compounds."""

    def __init__(self, selectors: dict[str, tuple]):
        self.tests: list[tuple] = []
        self.first = self.general = 0
        self.after = dict.fromkeys(" >+~", 0)
        self.by_id: dict[str, int] = {}
        self.by_class: dict[str, int] = {}
        self.by_tag: dict[str, int] = {}
        self.ends = {name: self._add_list(found) for name, found in selectors.items()}
        self.linked = any(self.after.values())

    def _add_list(self, found: tuple) -> int:
        return sum(self._add(parts) for parts in found)

    def _add(self, parts: tuple) -> int:
        """The bit of the last compound. Lists inside it come before it, so that they are decided when it is tested."""
        ready = [tuple(("bits", t[0] == "is", self._add_list(t[1])) if t[0] in ("is", "not") else t for t in tests) for _, tests in parts]
        for k, ((comb, _), tests) in enumerate(zip(parts, ready, strict=True)):
            bit = 1 << len(self.tests)
            self.tests.append(tests)
            if k == 0:
                self.first |= bit
            else:
                self.after[comb] |= bit >> 1
            key = next(((table, t[1]) for table, kind in ((self.by_id, "id"), (self.by_class, "class"), (self.by_tag, "tag")) for t in tests if t[0] == kind), None)
            if key is None:
                self.general |= bit
            else:
                key[0][key[1]] = key[0].get(key[1], 0) | bit
        return bit


@lru_cache(maxsize=512)
def _program(*css: str) -> Program:
    return Program({c: parse_list(c) for c in css})


class Matcher:
    """Finds selectors' matches in one tree."""

    def __init__(self, root: Node):
        self.root = root
        self.nodes = [root, *root.walk()]
        self.types: dict[int, dict[int, tuple[int, int]]] = {}
        self.having: dict = {}

    def run(self, program: Program, nodes: list[Node] | None = None, scope: Node | None = None, scope_bit: int = 0) -> list[int]:
        """Bits by place in nodes, which are a subtree in document order, all by default. The compound of scope_bit is taken to hold for
        scope, and for no other element."""
        nodes = self.nodes if nodes is None else nodes
        base = nodes[0].id
        own = [0] * len(nodes)
        above, before, any_before = own[:], own[:], own[:]  # of an element and all above it; of its last child so far; of all of them
        down, child, next_, later = (program.after[c] for c in " >+~")
        by_id, by_class, by_tag, general, tests, linked = program.by_id, program.by_class, program.by_tag, program.general, program.tests, program.linked
        for i, n in enumerate(nodes):
            ready, up = program.first, n.parent.id - base if n.parent is not None and i else -1
            ready &= ~scope_bit
            if linked and up >= 0:
                ready |= (above[up] & down | own[up] & child | before[up] & next_ | any_before[up] & later) << 1
            mask = general | by_tag.get(n.tag, 0)
            if n.attrs:
                if by_id and "id" in n.attrs:
                    mask |= by_id.get(n.attrs["id"], 0)
                if by_class and "class" in n.attrs:
                    for c in n.attrs["class"].split():
                        mask |= by_class.get(c, 0)
            open_ = ready & mask
            bits = scope_bit if n is scope else 0
            while open_:
                low = open_ & -open_
                open_ ^= low
                if self.holds(n, tests[low.bit_length() - 1], bits):
                    bits |= low
            own[i] = bits
            if linked:
                above[i] = bits
                if up >= 0:
                    above[i] |= above[up]
                    before[up] = bits
                    any_before[up] |= bits
        return own

    def holds(self, n: Node, tests: tuple, bits: int) -> bool:
        for t in tests:
            kind = t[0]
            if kind == "tag":
                ok = n.tag == t[1]
            elif kind == "class":
                ok = t[1] in n.attrs.get("class", "").split()
            elif kind == "id":
                ok = n.attrs.get("id") == t[1]
            elif kind == "attr":
                ok = _attr_test(n.attrs.get(t[1]), *t[2:])
            elif kind == "nth":
                k, of = (n.index, n.parent.count if n.parent is not None else 1) if not t[4] else self.of_type(n)
                ok = counted(of - k if t[3] else k + 1, t[1], t[2])
            elif kind == "bits":
                ok = bool(bits & t[2]) == t[1]
            elif kind == "has":
                ok = any(self.has(n, parts) for parts in t[1])
            elif kind == "empty":
                ok = not n.children
            elif kind == "root":
                ok = n.parent is None
            else:
                ok = True
            if not ok:
                return False
        return True

    def of_type(self, n: Node) -> tuple[int, int]:
        """Place among the siblings of its tag, and their number; worked out once for all children of a parent."""
        p = n.parent
        if p is None:
            return 0, 1
        got = self.types.get(p.id)
        if got is None:
            totals: dict[str, int] = {}
            places = []
            for c in p.elements():
                places.append((c.id, c.tag, totals.get(c.tag, 0)))
                totals[c.tag] = totals.get(c.tag, 0) + 1
            got = self.types[p.id] = {i: (k, totals[tag]) for i, tag, k in places}
        return got[n.id]

    def has(self, n: Node, parts: tuple) -> bool:
        """Whether something stands to n as the relative selector says. One compound is looked up among the matches in the whole tree; longer ones are
        run below n, or below its parent if siblings are meant."""
        comb = parts[0][0]
        if len(parts) == 1:
            got = self.having.get(parts)
            if got is None:
                program = Program({"": ((("", parts[0][1]),),)})
                found = [m for m, bits in zip(self.nodes, self.run(program), strict=True) if bits & program.ends[""]]
                ids = [m.id for m in found]
                got = self.having[parts] = (ids, {m.parent.id for m in found if m.parent is not None}, {(m.parent.id, m.index) for m in found if m.parent is not None}, {})
                for m in found:
                    if m.parent is not None:
                        got[3][m.parent.id] = m.index
            ids, parents, places, last = got
            if comb == " ":
                at = bisect_right(ids, n.id)
                return at < len(ids) and ids[at] <= n.last
            if comb == ">":
                return n.id in parents
            if n.parent is None:
                return False
            return (n.parent.id, n.index + 1) in places if comb == "+" else last.get(n.parent.id, -1) > n.index
        program = self.having.get(parts)
        if program is None:
            program = self.having[parts] = Program({"": ((("", (("any",),)), *parts),)})
        top = n if comb in " >" or n.parent is None else n.parent
        end = program.ends[""]
        return any(bits & end for bits in self.run(program, self.nodes[top.id : top.last + 1], n, end >> len(parts)))

    def select(self, css: Iterable[str], below: Node | None = None) -> list[list[Node]]:
        """For each selector the elements below a node, the root by default, that match, in document order; none for an invalid one."""
        wanted = list(css)
        sound = [c for c in dict.fromkeys(wanted) if valid(c)]
        top = below or self.root
        out: dict[str, list[Node]] = {c: [] for c in wanted}
        if sound:
            program = _program(*sound)
            rows = [(out[c], program.ends[c]) for c in sound]
            every = 0
            for _, end in rows:
                every |= end
            for n, bits in zip(self.nodes, self.run(program), strict=True):
                if bits & every and top.id < n.id <= top.last:
                    for found, end in rows:
                        if bits & end:
                            found.append(n)
        return [out[c] for c in wanted]


@lru_cache(maxsize=2048)
def valid(css: str) -> bool:
    try:
        parse_list(css)
    except (SelectorError, RecursionError):
        return False
    return True


def _top(n: Node) -> Node:
    while n.parent is not None:
        n = n.parent
    return n


def select(n: Node, css: str) -> list[Node]:
    """Descendants that match, in document order; none for an invalid selector."""
    return Matcher(_top(n)).select([css], n)[0]


def matches(n: Node, css: str) -> bool:
    if not valid(css):
        return False
    m, program = Matcher(_top(n)), _program(css)
    return bool(m.run(program)[n.id] & program.ends[css])
