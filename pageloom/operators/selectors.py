"""CSS and XPath selectors as step lists, and their Column form on the ``nodes`` array.

Parsing turns a selector into plain data: chains of steps, each a link to the step before and a list of tests.
The Column form makes each test a predicate on one node and each link a lookup through the node's own ``anc``,
``parent_id`` and ``prev_id``; nothing is joined. ``programs`` interprets the same steps where specs are rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

Predicate = Callable[[Column], Column]
#: A test: a name and its arguments, lists and texts only.
Test = tuple


class SelectorError(ValueError):
    """The selector uses something outside the supported subset."""


@dataclass(frozen=True)
class Step:
    link: str                  # how this step hangs on the one before: ' ', '>', '+', '~', '//', '/'
    tests: tuple[Test, ...]    # all must hold

    @property
    def test(self) -> Predicate:
        return _both([_predicate(t) for t in self.tests])


@dataclass(frozen=True)
class Selector:
    """Alternatives of step lists, and what is read from the matched node."""

    chains: tuple[tuple[Step, ...], ...]
    scope: str           # 'self': container or below; 'below': strictly below; 'page': anywhere
    reads: str | None = None   # None: the node; 'text()': its own text; '@name': an attribute


# ---------------------------------------------------------- tests as predicates
def _attr(x: Column, name: str) -> Column:
    return F.try_element_at(x["attrs"], F.lit(name))


def _attr_test(name: str, op: str | None, value: str | None) -> Predicate:
    def test(x: Column) -> Column:
        a = _attr(x, name)
        if op is None:
            return a.isNotNull()
        v = F.lit(value)
        if op == "=":
            return F.coalesce(a == v, F.lit(False))
        if op == "!=":
            return F.coalesce(a != v, F.lit(False))
        if value == "":
            return F.lit(False)
        if op == "~=":
            found = F.array_contains(F.split(a, r"(?U)\s+"), v)
        elif op == "|=":
            found = (a == v) | F.startswith(a, F.lit(value + "-"))
        else:
            found = {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op](a, v)
        return F.coalesce(found, F.lit(False))

    return test


_POSITION: dict[str, Predicate] = {
    "sib": lambda x: x["sib_pos"],
    "last": lambda x: x["n_sib"] - x["sib_pos"] + 1,
    "type": lambda x: x["tag_pos"],
    "last_type": lambda x: x["n_tag"] - x["tag_pos"] + 1,
}


def _nth(pos: Predicate, a: int, b: int) -> Predicate:
    def test(x: Column) -> Column:
        if a == 0:
            return pos(x) == b
        return (F.pmod(pos(x) - b, F.lit(abs(a))) == 0) & ((pos(x) - b) * (1 if a > 0 else -1) >= 0)

    return test


def _both(tests: list[Predicate]) -> Predicate:
    def test(x: Column) -> Column:
        out = F.lit(True)
        for i, t in enumerate(tests):
            out = t(x) if i == 0 else out & t(x)
        return out

    return test


def _either(groups: tuple[tuple[Test, ...], ...]) -> Predicate:
    built = [_both([_predicate(t) for t in group]) for group in groups]

    def test(x: Column) -> Column:
        out = built[0](x)
        for other in built[1:]:
            out = out | other(x)
        return out

    return test


def _predicate(test: Test) -> Predicate:
    kind, *args = test
    if kind == "any":
        return lambda x: F.lit(True)
    if kind == "tag":
        return lambda x: x["tag"] == args[0]
    if kind == "class":
        return lambda x: F.array_contains(x["classes"], F.lit(args[0]))
    if kind == "attr":
        return _attr_test(*args)
    if kind == "nth":
        return _nth(_POSITION[args[0]], args[1], args[2])
    if kind == "child":
        return lambda x: x["parent_id"] >= 0
    if kind == "root":
        return lambda x: x["parent_id"] < 0
    if kind == "empty":
        return lambda x: (x["end_id"] == x["node_id"]) & (x["t0"] == x["t1"])
    if kind == "is":
        return _either(args[0])
    if kind == "not":
        found = _either(args[0])
        return lambda x: ~found(x)
    raise SelectorError(f"{kind!r} tests need the text of the element; use a stored spec")


# ----------------------------------------------------------------------- css
_IDENT = r"-?(?:[A-Za-z_\u0080-￿]|\\.)(?:[\w\-\u0080-￿]|\\.)*"
_CSS_TOKEN = re.compile(
    rf"""(?P<ws>\s*(?P<comb>[>+~,])\s*|\s+)
       |::(?P<read>text|attr\(\s*(?P<read_attr>[\w\-:]+)\s*\))\s*\Z
       |(?P<star>\*)|(?P<tag>{_IDENT})|\.(?P<cls>{_IDENT})|\#(?P<id>(?:[\w\-\u0080-￿]|\\.)+)
       |\[\s*(?P<attr>[\w\-:]+)\s*(?:(?P<op>[~|^$*]?=)\s*
            (?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
       |:(?P<list>not|is|where)\(\s*(?P<inner>(?:\[[^\]]*\]|[^()\[\]]|\([^()]*\))+)\)
       |:(?P<pseudo>(?:first|last|only)-(?:child|of-type)|root|empty|nth-(?:last-)?(?:child|of-type))(?:\(\s*(?P<arg>[^)]*?)\s*\))?""",
    re.X,
)


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _nth_args(text: str | None, selector: str) -> tuple[int, int]:
    arg = re.sub(r"\s+", "", (text or "").lower())
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", arg)
    if m:
        step = {"": 1, "+": 1, "-": -1}.get(m[1])
        return (int(m[1]) if step is None else step), int(m[2] or 0)
    if re.fullmatch(r"[+-]?\d+", arg):
        return 0, int(arg)
    raise SelectorError(f"unsupported :nth-child argument in {selector!r}")


def _pseudo(name: str, arg: str | None, selector: str) -> list[Test]:
    if name.startswith("nth-"):
        kind = ("last_type" if name.endswith("type") else "last") if name.startswith("nth-last") else "type" if name.endswith("type") else "sib"
        return [("nth", kind, *_nth_args(arg, selector))]
    if arg is not None:
        raise SelectorError(f"unexpected argument in {selector!r}")
    if name in ("root", "empty"):
        return [(name,)]
    first, last = ("type", "last_type") if name.endswith("type") else ("sib", "last")
    wanted = {"first": [first], "last": [last], "only": [first, last]}[name.split("-")[0]]
    return [*(("nth", kind, 0, 1) for kind in wanted), ("child",)]


def parse_css(selector: str, simple_only: bool = False) -> Selector:
    chains: list[tuple[Step, ...]] = []
    steps: list[Step] = []
    tests: list[Test] = []
    reads: str | None = None
    link, text, at = " ", selector.strip(), 0
    if not text:
        raise SelectorError("empty selector")

    def close_step() -> None:
        nonlocal tests
        if not tests:
            raise SelectorError(f"dangling combinator in {selector!r}")
        steps.append(Step(link, tuple(tests)))
        tests = []

    while at < len(text):
        m = _CSS_TOKEN.match(text, at)
        if m is None:
            raise SelectorError(f"unsupported css at {text[at:]!r} in {selector!r}")
        at = m.end()
        if m["ws"] is not None:
            close_step()
            comb = m["comb"] or " "
            if simple_only and comb != ",":
                raise SelectorError(f":not() and :is() take simple selectors, got {selector!r}")
            if comb == ",":
                chains.append(tuple(steps))
                steps, link = [], " "
            else:
                link = comb
        elif m["read"]:
            if simple_only or chains:
                raise SelectorError(f"unsupported css at {m[0]!r} in {selector!r}")
            reads = "@" + m["read_attr"].lower() if m["read_attr"] else "text()"
            tests = tests or [("any",)]
        elif m["star"]:
            tests.append(("any",))
        elif m["tag"]:
            tests.append(("tag", _plain(m["tag"]).lower()))
        elif m["cls"]:
            tests.append(("class", _plain(m["cls"])))
        elif m["id"]:
            tests.append(("attr", "id", "=", _plain(m["id"])))
        elif m["attr"]:
            value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)
            tests.append(("attr", m["attr"].lower(), m["op"], value))
        elif m["list"]:
            inner = parse_css(m["inner"], simple_only=True).chains
            tests.append(("not" if m["list"] == "not" else "is", tuple(chain[0].tests for chain in inner)))
        else:
            tests += _pseudo(m["pseudo"], m["arg"], selector)
    close_step()
    chains.append(tuple(steps))
    return Selector(tuple(chains), "self", reads)


# --------------------------------------------------------------------- xpath
_QUOTED = r"""(?:"[^"]*"|'[^']*')"""
_XP_STEP = re.compile(rf"(?P<axis>//|/)?(?P<test>\*|@[\w\-:]+|text\(\)|[A-Za-z][\w\-]*)(?P<preds>(?:\[(?:{_QUOTED}|[^\]\"'])*\])*)")
_XP_VALUE = r"(?:@(?P<{0}a>[\w\-:]+)|(?P<{0}dot>\.|text\(\)))"
_XP_TEST = re.compile(
    rf"""(?P<n>\d+)|position\(\)\s*=\s*(?P<p>\d+)|(?P<last>last\(\))|
        contains\(\s*{_XP_VALUE.format("c")}\s*,\s*(?P<cv>{_QUOTED})\s*\)|
        starts-with\(\s*{_XP_VALUE.format("s")}\s*,\s*(?P<sv>{_QUOTED})\s*\)|
        normalize-space\(\s*(?:{_XP_VALUE.format("z")})?\s*\)\s*=\s*(?P<zv>{_QUOTED})|
        (?P<dot>\.|text\(\))\s*=\s*(?P<dv>{_QUOTED})|
        @(?P<a>[\w\-:]+)\s*(?:(?P<ne>!?=)\s*(?P<v>{_QUOTED}))?""",
    re.X,
)
_XP_WORD = re.compile(rf"{_QUOTED}|\bnot\s*\(|[()]|\s+(?:and|or)\s+|[^\"'()\s]+|\s+")


def _split_words(text: str, word: str) -> list[str]:
    """``text`` cut at `` and `` or `` or `` outside of quotes and parentheses."""
    parts, depth, at = [""], 0, 0
    while at < len(text):
        m = _XP_WORD.match(text, at)
        if m is None:
            return [text]
        piece, at = m[0], m.end()
        depth += piece.count("(") - piece.count(")") if piece[0] not in "\"'" else 0
        if depth == 0 and piece.strip() == word and piece != piece.strip():
            parts.append("")
        else:
            parts[-1] += piece
    return parts


def _xp_condition(text: str, by_tag: bool, selector: str) -> list[Test]:
    """Tests of the inside of a predicate."""
    text = text.strip()
    if len(parts := _split_words(text, "or")) > 1:
        return [("is", tuple(tuple(_xp_condition(p, by_tag, selector)) for p in parts))]
    if len(parts := _split_words(text, "and")) > 1:
        return [t for p in parts for t in _xp_condition(p, by_tag, selector)]
    if (m := re.fullmatch(r"not\s*\((.*)\)", text, re.S)) is not None:
        return [("not", (tuple(_xp_condition(m[1], by_tag, selector)),))]
    m = _XP_TEST.fullmatch(text)
    if m is None:
        raise SelectorError(f"unsupported xpath predicate {text!r} in {selector!r}")
    if m["n"] or m["p"]:
        return [("nth", "type" if by_tag else "sib", 0, int(m["n"] or m["p"]))]
    if m["last"]:
        return [("nth", "last_type" if by_tag else "last", 0, 1)]
    for kind, value, attr, dot in (("*=", "cv", "ca", "cdot"), ("^=", "sv", "sa", "sdot")):
        if m[value]:
            v = m[value][1:-1]
            return [("attr", m[attr].lower(), kind, v)] if m[attr] else [("text", "all" if m[dot] == "." else "own", kind, v)]
    if m["zv"]:
        return [("space", m["za"].lower() if m["za"] else None, "own" if m["zdot"] == "text()" else "all", m["zv"][1:-1])]
    if m["dv"]:
        return [("text", "all" if m["dot"] == "." else "own", "=", m["dv"][1:-1])]
    return [("attr", m["a"].lower(), m["ne"], m["v"][1:-1] if m["v"] else None)]


def parse_xpath(selector: str) -> Selector:
    parts = [p.strip() for p in re.split(rf"\|(?=(?:[^\"']|{_QUOTED})*\Z)", selector)]
    found = [_parse_path(p, selector) for p in parts]
    if len({(f.scope, f.reads) for f in found}) > 1:
        raise SelectorError(f"the parts of {selector!r} start or end in different ways")
    return Selector(tuple(c for f in found for c in f.chains), found[0].scope, found[0].reads)


def _parse_path(text: str, selector: str) -> Selector:
    relative = text.startswith(".")
    body = text[1:] if relative else text
    if text == ".":
        return Selector(((Step("self", (("any",),)),),), "self")
    if not body or (relative and not body.startswith("/")):
        raise SelectorError(f"unsupported xpath {selector!r}")
    scope = "below" if relative or not body.startswith("/") else "page"
    steps: list[Step] = []
    reads, at = None, 0
    while at < len(body):
        m = _XP_STEP.match(body, at)
        if m is None or reads is not None or (at > 0 and not m["axis"]):
            raise SelectorError(f"unsupported xpath at {body[at:]!r} in {selector!r}")
        at = m.end()
        axis, test = m["axis"] or "/", m["test"]
        if test == "text()" or test.startswith("@"):
            if axis == "//" or m["preds"] or not (steps or relative):
                raise SelectorError(f"unsupported xpath tail in {selector!r}")
            reads = test
            continue
        tests: list[Test] = [("any",) if test == "*" else ("tag", test.lower())]
        for pred in re.findall(rf"\[((?:{_QUOTED}|[^\]\"'])*)\]", m["preds"]):
            tests += _xp_condition(pred, test != "*", selector)
        steps.append(Step(axis, tuple(tests)))
    if not steps:
        steps.append(Step("self", (("any",),)))
    return Selector((tuple(steps),), scope, reads)


def parse_selector(selector: str, selector_type: str) -> Selector:
    if selector_type == "css":
        return parse_css(selector)
    if selector_type == "xpath":
        return parse_xpath(selector)
    raise SelectorError(f"{selector_type!r} is not a tree selector")


# ------------------------------------------------------------------ matching
def _chain_matches(steps: tuple[Step, ...], x: Column, nodes: Column, scope: str, root: Column) -> Column:
    """Does node ``x`` end a match of ``steps`` inside the subtree of node ``root``?"""
    last, before = steps[-1], steps[:-1]
    here = last.test(x)
    if last.link == "self":
        return x["node_id"] == root
    if not before:
        if scope == "self":
            return here
        if scope == "page":
            return here & (x["parent_id"] < 0) if last.link == "/" else here
        return here & (x["parent_id"] == root if last.link == "/" else x["node_id"] > root)
    lowest = F.lit(0) if scope == "page" else root
    if last.link in (">", "/"):
        parent = F.get(nodes, x["parent_id"])
        return here & (x["parent_id"] >= lowest) & _chain_matches(before, parent, nodes, scope, root)
    if last.link in (" ", "//"):
        return here & F.exists(
            x["anc"],
            lambda p: (p >= lowest) & _chain_matches(before, F.get(nodes, p), nodes, scope, root),
        )
    if last.link == "+":
        prev = F.get(nodes, x["prev_id"])
        return here & (x["prev_id"] >= 0) & _chain_matches(before, prev, nodes, scope, root)
    # '~': an earlier sibling, looked for between the parent and x.
    span = F.slice(nodes, x["parent_id"] + 2, x["node_id"] - x["parent_id"] - 1)
    return here & (x["parent_id"] >= 0) & F.exists(
        span,
        lambda y: (y["parent_id"] == x["parent_id"]) & _chain_matches(before, y, nodes, scope, root),
    )


def matches(sel: Selector, x: Column, nodes: Column, root: Column) -> Column:
    out = None
    for chain in sel.chains:
        hit = _chain_matches(chain, x, nodes, sel.scope, root)
        out = hit if out is None else out | hit
    return out


def select_nodes(sel: Selector, nodes: Column) -> Column:
    """All matching nodes of a page, in document order."""
    return F.filter(nodes, lambda x: matches(sel, x, nodes, F.lit(0)))


def subtree(nodes: Column, root: Column) -> Column:
    """The nodes of an element's subtree, itself first (pre-order numbers are contiguous)."""
    return F.slice(nodes, root["node_id"] + 1, root["end_id"] - root["node_id"] + 1)


def first_match(sel: Selector, nodes: Column, root: Column) -> Column:
    """First match in document order, relative to the element ``root``; NULL if none.

    A selector that reads text or an attribute matches only where there is some.
    """
    within = nodes if sel.scope == "page" else subtree(nodes, root)
    found = F.filter(within, lambda x: matches(sel, x, nodes, root["node_id"]))
    if sel.reads == "text()":
        found = F.filter(found, lambda x: x["first_text"].isNotNull())
    elif sel.reads:
        found = F.filter(found, lambda x: _attr(x, sel.reads[1:].lower()).isNotNull())
    return F.get(found, F.lit(0))


def text_slice(source: Column, start: Column, end: Column) -> Column:
    """Characters of a UTF-8 byte span."""
    return F.substr(source, start + 1, end - start).cast("string")
