"""Shred HTML text into a page row holding its element tree.

This is the one place where Python runs on the data path. It turns each page into
plain facts about its elements (position in the tree, attributes, where their text
and source lie); everything computed from those facts is a Column expression.
"""

from __future__ import annotations

import gc
import html as htmllib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

# The parser travels to the executors inside the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element classes of HTML that decide how tags nest.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEAD_ONLY = frozenset("base link meta script style title".split())
INLINE = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# start tag -> (open elements it closes, elements the search stops at)
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
# Elements a page summary ignores, and those that never count as visible text.
NOISE = frozenset("iframe noscript script style svg template".split())
UNRENDERED = frozenset("noscript script style svg template".split())

_TOKEN = re.compile(
    rb"<!--.*?(?:-->|\Z)"
    rb"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    rb"|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    rb"|<[!?/][^>]*+(?:>|\Z)"
    rb"|<[A-Za-z][^>]*+\Z",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)

# name -> (Spark type, Arrow type); positions are 0-based, offsets count UTF-8 bytes.
_NODE = {
    "node_id": (T.IntegerType(), pa.int32()),      # pre-order number, 0 = html
    "end_id": (T.IntegerType(), pa.int32()),       # last pre-order number of the subtree
    "parent_id": (T.IntegerType(), pa.int32()),
    "prev_id": (T.IntegerType(), pa.int32()),      # previous element sibling, -1 = none
    "depth": (T.IntegerType(), pa.int32()),
    "sib_pos": (T.IntegerType(), pa.int32()),      # 1-based among element siblings
    "n_sib": (T.IntegerType(), pa.int32()),
    "tag_pos": (T.IntegerType(), pa.int32()),      # 1-based among siblings of the same tag
    "n_tag": (T.IntegerType(), pa.int32()),
    "anc": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),  # ancestors, root first
    "tag": (T.StringType(), pa.string()),
    "classes": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "attrs": (T.MapType(T.StringType(), T.StringType()), pa.map_(pa.string(), pa.string())),
    "own_text": (T.StringType(), pa.string()),     # text directly inside the element
    "first_text": (T.StringType(), pa.string()),   # its first piece, NULL without any
    "noise": (T.BooleanType(), pa.bool_()),        # inside script, style, svg, ...
    "t0": (T.IntegerType(), pa.int32()),           # text span in `text`
    "t1": (T.IntegerType(), pa.int32()),
    "v0": (T.IntegerType(), pa.int32()),           # text span in `visible`
    "v1": (T.IntegerType(), pa.int32()),
    "h0": (T.IntegerType(), pa.int32()),           # source span in the html
    "h1": (T.IntegerType(), pa.int32()),
}
NODE_TYPE = T.StructType([T.StructField(n, t[0]) for n, t in _NODE.items()])
_PAGE = {
    "text": (T.BinaryType(), pa.binary()),         # all text, scripts included
    "visible": (T.BinaryType(), pa.binary()),      # text outside noise elements
    "body_text": (T.StringType(), pa.string()),    # rendered text pieces joined by a space
}

#: What selectors and field rules look at.
EXTRACT_FIELDS = (
    "node_id", "end_id", "parent_id", "prev_id", "sib_pos", "n_sib", "tag_pos", "n_tag", "anc",
    "tag", "classes", "attrs", "t0", "t1", "h0", "h1",
)

def _unescape(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    return htmllib.unescape(text) if "&" in text else text


#: Elements that a start tag may close, and the flags of an element that is neither noise nor hidden.
_CLOSED = frozenset({"p"}.union(*[closes for closes, _ in IMPLIED_END.values()]))
_LOUD = (False, False)
# What the parser has to see to when it meets a tag.
_FRAME, _RAW, _VOID, _ENDS_P, _ENDS_LIKE, _COUNTED = 1, 2, 4, 8, 16, 32


def _flags(tag: str) -> int:
    return (
        (_FRAME if tag in ("html", "head", "body") else 0) | (_RAW if tag in RAW_TEXT else 0) | (_VOID if tag in VOID else 0)
        | (_ENDS_P if tag in CLOSES_P else 0) | (_ENDS_LIKE if tag in IMPLIED_END else 0) | (_COUNTED if tag in _CLOSED else 0)
    )


class _Tree:
    """Element tree of one page, grown tag by tag.

    Kept per element is what only the parser can tell; text positions are numbers of text pieces. Everything else follows from
    that and is made when it is first asked for.
    """

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.parent_id: list[int] = []
        self.items: list[list[tuple[str, str]]] = []
        self.words: list[list[str]] = []
        self.end_id: list[int] = []
        self.p0: list[int] = []
        self.p1: list[int] = []
        self.h0: list[int] = []
        self.h1: list[int] = []
        # Pieces of text and the elements they lie in; those from `n_before` on came after the body's start.
        self.text_parts: list[bytes] = []
        self.owners: list[int] = []
        self.n_before = 0
        self.stack: list[int] = []
        self.html_attrs: dict[str, str] = {}
        self.head = self.body = -1
        self.n_open = dict.fromkeys(_CLOSED, 0)

    def __getattr__(self, name: str) -> list | dict:
        make = _DERIVED.get(name)
        if make is None:
            raise AttributeError(name)
        make(self)
        return self.__dict__[name]

    def open(self, tag: str, attrs: dict[str, str], pos: int) -> None:
        self.put(tag, list(attrs.items()), attrs["class"].split() if attrs.get("class") else [], pos)

    def put(self, tag: str, items: list[tuple[str, str]], classes: list[str], pos: int) -> None:
        me, stack, at = len(self.tags), self.stack, len(self.text_parts)
        self.tags.append(tag)
        self.parent_id.append(stack[-1] if stack else -1)
        self.items.append(items)
        self.words.append(classes)
        self.end_id.append(me)
        self.p0.append(at)
        self.p1.append(at)
        self.h0.append(pos)
        self.h1.append(pos)
        if tag in _CLOSED:
            self.n_open[tag] += 1
        stack.append(me)

    def close_top(self, pos: int) -> None:
        me = self.stack.pop()
        if self.tags[me] in _CLOSED:
            self.n_open[self.tags[me]] -= 1
        self.end_id[me] = len(self.tags) - 1
        self.p1[me], self.h1[me] = len(self.text_parts), pos

    def _families(self) -> None:
        self.prev_id, self.sib_pos, self.tag_pos = prev_id, sib_pos, tag_pos = [], [], []
        # Of elements with child elements: their number, the last one, their number by tag.
        self.kids = kids = {-1: [0, -1, {}]}
        for me, (parent, tag) in enumerate(zip(self.parent_id, self.tags)):
            family = kids.get(parent)
            if family is None:
                kids[parent] = [1, me, {tag: 1}]
                prev_id.append(-1), sib_pos.append(1), tag_pos.append(1)
                continue
            family[0] = n = family[0] + 1
            prev_id.append(family[1])
            family[1] = me
            counts = family[2]
            counts[tag] = t = counts.get(tag, 0) + 1
            sib_pos.append(n), tag_pos.append(t)

    def _depths(self) -> None:
        self.depth = depth = []
        for parent in self.parent_id:
            depth.append(depth[parent] + 1 if parent >= 0 else 0)

    def _hushes(self) -> None:
        self.hushed = hushed = []  # noise, not rendered
        for parent, tag in zip(self.parent_id, self.tags):
            state = hushed[parent] if parent >= 0 else _LOUD
            hushed.append((True, state[1] or tag in UNRENDERED) if tag in NOISE else state)
        self.noise = [h[0] for h in hushed]

    def _offsets(self) -> None:
        ends = [0]
        size = 0
        for piece in self.text_parts:
            size += len(piece)
            ends.append(size)
        self.t0, self.t1 = [ends[k] for k in self.p0], [ends[k] for k in self.p1]

    def _visibles(self) -> None:
        self.visible_parts = parts = []
        ends, size, noise = [0], 0, self.noise
        for piece, owner in zip(self.text_parts, self.owners):
            if not noise[owner]:
                parts.append(piece)
                size += len(piece)
            ends.append(size)
        self.v0, self.v1 = [ends[k] for k in self.p0], [ends[k] for k in self.p1]

    def _texts(self) -> None:
        self.own = own = {}
        for piece, owner in zip(self.text_parts, self.owners):
            own.setdefault(owner, []).append(piece.decode("utf-8", "replace"))

    def _shown(self) -> None:
        at, hushed = self.n_before, self.hushed
        self.rendered = [p.decode("utf-8", "replace") for p, o in zip(self.text_parts[at:], self.owners[at:]) if not hushed[o][1]]

    def _attributes(self) -> None:
        self.attrs, self.classes = self.items, self.words
        if self.html_attrs:
            self.attrs = [list(self.html_attrs.items()), *self.items[1:]]
            self.classes = [self.html_attrs.get("class", "").split(), *self.words[1:]]

    @property
    def opened(self) -> list[tuple[int, int]]:
        """Elements and their parents."""
        return list(enumerate(self.parent_id))

    def columns(self, names: tuple[str, ...]) -> list[list]:
        """Node columns by name, one value per element."""
        return [self._column(name) for name in names]

    def _column(self, name: str) -> list:
        n = len(self.tags)
        if name == "node_id":
            return list(range(n))
        if name == "tag":
            return self.tags
        if name == "n_sib":
            return [self.kids[p][0] if p >= 0 else 1 for p in self.parent_id]
        if name == "n_tag":
            return [self.kids[p][2][t] if p >= 0 else 1 for p, t in zip(self.parent_id, self.tags)]
        if name == "first_text":
            return [self.own[i][0] if i in self.own else None for i in range(n)]
        if name == "own_text":
            return ["".join(self.own.get(i, ())) for i in range(n)]
        if name == "anc":
            anc: list[list[int]] = []
            for p in self.parent_id:
                anc.append([*anc[p], p] if p >= 0 else [])
            return anc
        return getattr(self, name)

    def tag_of(self, depth: int) -> str:
        return self.tags[self.stack[depth]]

    def close_to(self, depth: int, pos: int, end: int) -> None:
        """Close everything above ``depth`` at ``pos`` and that element itself at ``end``."""
        while len(self.stack) - 1 > depth:
            self.close_top(pos)
        self.close_top(end)

    def close_implied(self, closes: set, stops: set, pos: int) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag_of(depth)
            if tag in stops:
                return
            if tag in closes:
                self.close_to(depth, pos, pos)
                return self.close_implied(closes, stops, pos)

    def enter_body(self, pos: int, attrs: dict[str, str] | None = None) -> None:
        while len(self.stack) > 1:
            self.close_top(pos)
        self.body, self.n_before = len(self.tags), len(self.text_parts)
        self.open("body", attrs or {}, pos)

    def start(self, tag: str, attrs: dict[str, str], items: list[tuple[str, str]], classes: list[str], pos: int, end: int) -> None:
        if tag == "html":
            self.html_attrs = {**attrs, **self.html_attrs}
            return
        if tag in ("head", "body"):
            if tag == "body" and self.body < 0:
                self.enter_body(pos, attrs)
            elif tag == "head" and self.head < 0 and self.body < 0:
                self.head = len(self.tags)
                self.open("head", attrs, pos)
            return
        if self.body < 0:
            if tag not in HEAD_ONLY and not (tag in ("noscript", "template") and self.head >= 0):
                self.enter_body(pos)
            elif self.head < 0:
                self.head = len(self.tags)
                self.open("head", {}, pos)
            elif len(self.stack) == 1:
                self.stack.append(self.head)
        # The open elements are searched only if one that would be closed is among them.
        n_open = self.n_open
        if tag in CLOSES_P and n_open.get("p", 0):
            self.close_implied({"p"}, {"td", "th", "table", "button", "body"}, pos)
        if tag in IMPLIED_END and any([n_open.get(t, 0) for t in IMPLIED_END[tag][0]]):
            self.close_implied(*IMPLIED_END[tag], pos)
        self.put(tag, items, classes, pos)
        if tag in VOID:
            self.close_top(end)

    def finish(self, tag: str, pos: int, end: int) -> None:
        if tag in ("html", "body"):
            return
        if len(self.stack) > 1 and self.tags[self.stack[-1]] == tag:
            return self.close_top(end)
        for depth in range(len(self.stack) - 1, 0, -1):
            open_tag = self.tag_of(depth)
            if open_tag == tag:
                return self.close_to(depth, pos, end)
            if open_tag == "body" or (tag in INLINE and open_tag not in INLINE):
                return

    def text(self, raw: bytes, unescape: bool, pos: int) -> None:
        if not raw:
            return
        plain = raw.isascii() and not (unescape and b"&" in raw)
        if plain:
            value = raw.decode("ascii")
        else:
            value = _unescape(raw) if unescape else raw.decode("utf-8", "replace")
        if self.body < 0 and (len(self.stack) == 1 or self.stack[-1] == self.head):
            if not value.strip():
                return
            self.enter_body(pos)
        self.text_parts.append(raw if plain else value.encode("utf-8", "replace"))
        self.owners.append(self.stack[-1])

    def done(self, pos: int) -> None:
        if self.body < 0:
            self.enter_body(pos)
        while self.stack:
            self.close_top(pos)


#: How what is not kept of a tree is made from what is.
_DERIVED = {
    **dict.fromkeys(("prev_id", "sib_pos", "tag_pos", "kids"), _Tree._families), "depth": _Tree._depths,
    **dict.fromkeys(("hushed", "noise"), _Tree._hushes), **dict.fromkeys(("t0", "t1"), _Tree._offsets),
    **dict.fromkeys(("visible_parts", "v0", "v1"), _Tree._visibles), "own": _Tree._texts, "rendered": _Tree._shown,
    **dict.fromkeys(("attrs", "classes"), _Tree._attributes),
}
#: Tags read before, by their source bytes without brackets, and the forms of tags (all but the quoted values); at most ``_MEMO`` of them each.
_READ_TAGS: dict[bytes, tuple] = {}
_FORMS: dict[tuple[bytes, ...], tuple[bytes, str, list[str], int] | None] = {}
_MEMO = 20_000
_FORM = re.compile(rb"([A-Za-z][A-Za-z0-9]*)[ \t\r\n]+(.*)", re.S)
_NAME = re.compile(rb"[ \t\r\n]*([A-Za-z][A-Za-z0-9_-]*)=")


def _form(outside: tuple[bytes, ...]) -> tuple[bytes, str, list[str], int] | None:
    """Name, tag, attribute names and flags of a start tag whose attributes all have plain names and double quotes, by what is outside the quotes."""
    first = _FORM.fullmatch(outside[0])
    if first is None or outside[-1].strip(b" \t\r\n") not in (b"", b"/"):
        return None
    found = [_NAME.fullmatch(x) for x in (first[2], *outside[1:-1])]
    if not all(found) or any(x[:1] not in (b" ", b"\t", b"\r", b"\n") for x in outside[1:-1]):
        return None
    names = [m[1].decode().lower() for m in found]
    tag = first[1].decode().lower()
    return (first[1], tag, names, _flags(tag)) if len(set(names)) == len(names) else None


def _read_form(token: bytes) -> tuple | None:
    """What ``_read_tag`` makes of a tag, read by its form; None if it takes a closer look."""
    parts = token.split(b'"')
    if len(parts) < 3 or not len(parts) % 2:
        return None
    outside = tuple(parts[::2])
    if outside not in _FORMS:
        if len(_FORMS) >= _MEMO:
            _FORMS.clear()
        _FORMS[outside] = _form(outside)
    form = _FORMS[outside]
    if form is None:
        return None
    name, tag, names, flags = form
    values = [_unescape(v) for v in parts[1::2]]
    attrs = dict(zip(names, values))
    made = False, name, tag, attrs, list(zip(names, values)), attrs["class"].split() if "class" in attrs else [], flags
    if len(token) <= 200:
        _remember(token, made)
    return made


def _remember(token: bytes, made: tuple) -> None:
    if len(_READ_TAGS) >= _MEMO:
        _READ_TAGS.clear()
    _READ_TAGS[token] = made


def _read_tag(m: re.Match) -> tuple[bool, bytes, str, dict[str, str], list[tuple[str, str]], list[str], int]:
    """Closing or not, name as written, tag, attributes (also as pairs), classes and flags of a tag token."""
    name = m["tag"] or m["tag2"]
    tag = name.decode("utf-8", "replace").lower()
    attrs: dict[str, str] = {}
    closing = bool(m["close"] or m["close2"])
    raw_attrs = b"" if closing else m["attrs"] if m["tag"] else m["attrs2"]
    for a in _ATTR.finditer(raw_attrs.decode("utf-8", "replace")) if raw_attrs else ():
        value = next((g for g in a.groups()[1:] if g is not None), "")
        attrs.setdefault(a[1].lower(), htmllib.unescape(value) if "&" in value else value)
    made = closing, name, tag, attrs, list(attrs.items()), attrs.get("class", "").split(), _flags(tag)
    # A token with closed quotes that ends at its first '>' reads the same wherever its bytes stand.
    if m["tag"] and len(m[0]) <= 200 and m[0].count(b">") == 1:
        _remember(m[0][1:-1], made)
    return made


def parse_page(source: bytes) -> _Tree:
    """Element tree of one HTML page.

    Tags in the body that close nothing but themselves are handled here, without a call; the rest by the tree's methods.
    """
    tree = _Tree()
    tree.open("html", {}, 0)
    n = len(source)
    read, tags, stack, n_open, parts, owners = _READ_TAGS.get, tree.tags, tree.stack, tree.n_open, tree.text_parts, tree.owners
    parents, items_, words, end_id, p0, p1, h0, h1 = tree.parent_id, tree.items, tree.words, tree.end_id, tree.p0, tree.p1, tree.h0, tree.h1
    inside = False  # the body has begun
    at = begin = following = 0
    pieces = iter(source.split(b"<"))
    following = len(next(pieces))
    for piece in pieces:
        begin = following
        following += len(piece) + 1
        if begin < at:  # inside what was read already
            continue
        token, bracket, _ = piece.partition(b">")
        seen = (read(token) or _read_form(token)) if bracket else None
        if seen is not None:
            end = begin + len(token) + 2
        else:
            m = _TOKEN.search(source, begin)
            if m is None:
                break
            begin, end = m.span()
            if m["tag"] or m["tag2"]:
                seen = _read_tag(m)
        if begin > at:
            raw = source[at:begin]
            if inside and raw.isascii() and b"&" not in raw:
                parts.append(raw)
                owners.append(stack[-1])
            else:
                tree.text(raw, True, at)
                inside = tree.body >= 0
        at = end
        if seen is None:
            continue
        closing, name, tag, attrs, items, classes, flags = seen
        if closing:
            me = stack[-1]
            if tags[me] == tag and not flags & _FRAME:
                stack.pop()
                if flags & _COUNTED:
                    n_open[tag] -= 1
                end_id[me] = len(tags) - 1
                p1[me] = len(parts)
                h1[me] = end
            else:
                tree.finish(tag, begin, end)
            continue
        if not inside or flags & (_FRAME | _RAW):
            tree.start(tag, attrs, items, classes, begin, end)
            inside = tree.body >= 0
            if flags & _RAW and tags[stack[-1]] == tag:
                stop = re.compile(rb"</" + re.escape(name) + rb"(?=[\s/>])[^>]*>?", re.I).search(source, at)
                inner_end, after = (stop.start(), stop.end()) if stop else (n, n)
                tree.text(source[at:inner_end], tag in ("textarea", "title"), at)
                tree.close_top(after)
                at = after
            continue
        if flags & _ENDS_P and n_open["p"]:
            tree.close_implied({"p"}, {"td", "th", "table", "button", "body"}, begin)
        if flags & _ENDS_LIKE and any([n_open[t] for t in IMPLIED_END[tag][0]]):
            tree.close_implied(*IMPLIED_END[tag], begin)
        me = len(tags)
        tags.append(tag)
        parents.append(stack[-1])
        items_.append(items)
        words.append(classes)
        end_id.append(me)
        p0.append(len(parts))
        p1.append(len(parts))
        h0.append(begin)
        h1.append(end)
        if not flags & _VOID:
            stack.append(me)
            if flags & _COUNTED:
                n_open[tag] += 1
    tree.text(source[at:], True, at)
    tree.done(n)
    return tree


def _arrow_nodes(trees: list[_Tree | None], fields: tuple[str, ...]) -> pa.Array:
    offsets, total = [0], 0
    for tree in trees:
        total += len(tree.tags) if tree else 0
        offsets.append(total)
    merged: list[list] = [[] for _ in fields]
    for tree in trees:
        if tree:
            for target, column in zip(merged, tree.columns(fields)):
                target.extend(column)
    columns = [pa.array(values, type=_NODE[name][1]) for name, values in zip(fields, merged)]
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=list(fields))
    )


def _page_value(tree: _Tree, name: str) -> bytes | str:
    if name == "body_text":
        return " ".join(tree.rendered)
    return b"".join(tree.text_parts if name == "text" else tree.visible_parts)


def _shredder(carry: list[str], fields: tuple[str, ...], page_fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Trees hold no cycles and are dropped batch by batch, so scanning for cycles only costs time.
        gc.disable()
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                sources = batch.column(batch.schema.get_field_index("html")).cast(pa.binary()).to_pylist()
                trees = [parse_page(s) if s is not None else None for s in sources]
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in carry]
                for name in page_fields:
                    values = [_page_value(t, name) if t else None for t in trees]
                    arrays.append(pa.array(values, type=_PAGE[name][1]))
                arrays.append(_arrow_nodes(trees, fields))
                yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *page_fields, "nodes"])

    return run


def shred(
    pages: DataFrame,
    fields: tuple[str, ...] = EXTRACT_FIELDS,
    page_fields: tuple[str, ...] = ("text",),
    keep_html: bool = False,
) -> DataFrame:
    """Add ``nodes`` (and page-level text columns) to a table with an ``html`` column.

    One output row per input row and no shuffle. Other columns ride along; ``html``
    only with ``keep_html``. Rows with NULL html get an empty ``nodes`` array.
    """
    carried = [f for f in pages.schema.fields if keep_html or f.name != "html"]
    schema = T.StructType(
        carried
        + [T.StructField(n, _PAGE[n][0]) for n in page_fields]
        + [T.StructField("nodes", T.ArrayType(T.StructType([NODE_TYPE[n] for n in fields])))]
    )
    return pages.mapInArrow(_shredder([f.name for f in carried], fields, page_fields), schema)


# ---------------------------------------------------------------- page outlines
#: Siblings that make a group or a run.
MIN_REPEAT = 3
_SHOWN = T.StructType([NODE_TYPE[n] for n in ("node_id", "end_id", "depth", "tag", "classes", "attrs", "own_text")])
_MEMBER = T.StructType([NODE_TYPE[n] for n in ("tag", "classes", "attrs")] + [T.StructField("text", T.StringType())])
#: What a page summary looks at: no list of it is longer than what the summary shows.
SKELETON_TYPE = T.StructType([
    T.StructField("title", T.StringType()),        # text of the first title element
    T.StructField("groups", T.ArrayType(T.StructType([
        T.StructField("parent_id", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("second", T.IntegerType()),
        T.StructField("size", T.IntegerType()), T.StructField("sig", T.StringType()),
        T.StructField("a", _MEMBER), T.StructField("b", _MEMBER)]))),
    T.StructField("shown", T.ArrayType(_SHOWN)),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField("x", _SHOWN), T.StructField("size", T.IntegerType())]))),
])


def page_skeleton(tree: _Tree, max_depth: int) -> dict:
    """Groups of equal siblings, the elements an outline shows, and the runs it sums up (see ``SKELETON_TYPE``)."""
    ids, parents, depths, tags, classes, attrs, noise, t0, v0 = tree.columns(("node_id", "parent_id", "depth", "tag", "classes", "attrs", "noise", "t0", "v0"))
    n, end_id = len(tags), tree.end_id
    text, visible = b"".join(tree.text_parts), b"".join(tree.visible_parts)
    body = next(i for i in range(n) if tags[i] == "body" and parents[i] == 0)
    sigs = [".".join((t, *c)) for t, c in zip(tags, classes)]
    families: dict[int, list[int]] = {}
    alike: dict[tuple[int, str], list[int]] = {}
    for i, (parent, sig, hushed) in enumerate(zip(parents, sigs, noise)):
        # Noise elements are a family of their own.
        families.setdefault(-2 if hushed else parent, []).append(i)
        if i > body and not hushed:
            alike.setdefault((parent, sig), []).append(i)
    # Later members of a run of equal siblings are left out, with all that is below them.
    hidden, heads = [False] * n, []
    for kids in families.values():
        at = 0
        while at < len(kids):
            stop = at + 1
            while stop < len(kids) and sigs[kids[stop]] == sigs[kids[at]]:
                stop += 1
            if stop - at >= MIN_REPEAT:
                heads.append((kids[at], stop - at))
                for k in kids[at + 1 : stop]:
                    hidden[k] = True
            at = stop
    for i in range(1, n):
        if hidden[parents[i]]:
            hidden[i] = True
    named = lambda i: [(k, v) for k, v in attrs[i] if k in ("id", "href")]
    whole = lambda i: {"node_id": i, "end_id": end_id[i], "depth": depths[i], "tag": tags[i], "classes": classes[i], "attrs": named(i), "own_text": "".join(tree.own.get(i, ()))}
    seen = lambda i: visible[v0[i] : tree.v1[i]].decode("utf-8", "replace")
    member = lambda i: {"tag": tags[i], "classes": classes[i], "attrs": named(i), "text": seen(i)}
    shows = lambda i, depth: not (noise[i] or hidden[i]) and i >= body and depths[i] - 1 <= depth
    groups = sorted((parent, m[0], m[1], len(m), sig) for (parent, sig), m in alike.items() if len(m) >= MIN_REPEAT and seen(m[0]).strip())
    titled = next((i for i in range(n) if tags[i] == "title"), None)
    return {
        "title": None if titled is None else text[t0[titled] : tree.t1[titled]].decode("utf-8", "replace"),
        "groups": [{"parent_id": p, "first": a, "second": b, "size": size, "sig": sig, "a": member(a), "b": member(b)} for p, a, b, size, sig in groups],
        "shown": [whole(i) for i in range(body, n) if shows(i, max_depth)],
        "runs": [{"x": whole(i), "size": size} for i, size in heads if i > body and shows(i, max_depth + 1)],
    }


def outline_pages(pages: DataFrame, max_depth: int) -> DataFrame:
    """Add ``nodes`` (a ``SKELETON_TYPE`` struct) to a table with an ``html`` column, which is dropped; NULL html gives empty lists."""
    carried = [f for f in pages.schema.fields if f.name != "html"]
    names = [f.name for f in carried]
    nothing = {"title": None, "groups": [], "shown": [], "runs": []}
    made = to_arrow_type(SKELETON_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                sources = batch.column(batch.schema.get_field_index("html")).cast(pa.binary()).to_pylist()
                found = [nothing if s is None else page_skeleton(parse_page(s), max_depth) for s in sources]
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, made)], names=[*names, "nodes"])

    return pages.mapInArrow(run, T.StructType([*carried, T.StructField("nodes", SKELETON_TYPE)]))


def dom_nodes(pages: DataFrame, fields: tuple[str, ...] = tuple(_NODE)) -> DataFrame:
    """One row per element: ``page_id`` and the node columns."""
    tree = shred(pages.select("page_id", "html"), fields, ())
    return tree.select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.*")
