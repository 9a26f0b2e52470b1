"""Specs as rows: each compiled to a program, all run by one evaluator in one pass over the pages.

A program is a JSON text of step lists (see ``selectors``): what to iterate, and per field what to read. Compiling is a
distributed pass over the distinct specs; a spec that cannot be read, or uses something unsupported, gets an error text and no program,
and fails alone. Programs travel to their pages as data, so neither the plan nor the driver grows with the number of specs.

The evaluator shreds a page once for all of its programs. A step looks at the elements of a subtree once, with the set of
elements that the step before has found, so a selector costs its number of steps times the subtree, whatever its links. Values
leave as raw texts; transforms, typing and gates are Columns like everywhere else.
"""

from __future__ import annotations

import gc
import json
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from . import selectors, shred as shredding

# Compiler and evaluator travel to the executors inside the task, like the parser.
for _module in (sys.modules[__name__], selectors):
    cloudpickle.register_pickle_by_value(_module)

#: Row number of the row that holds a page's next link.
LINK = -1
#: Made when a test first asks for them.
_RARE = ("prev_id", "sib_pos", "tag_pos", "n_sib", "n_tag", "first_text")


class SpecError(ValueError):
    """A spec that cannot become a program."""


# -------------------------------------------------------------------- compiling
def _selector(text: object, kind: str) -> dict:
    if not isinstance(text, str):
        raise SpecError(f"a selector must be text, got {text!r}")
    sel = selectors.parse_selector(text, kind)
    return {"chains": [[[s.link, s.tests] for s in chain] for chain in sel.chains], "scope": sel.scope, "reads": sel.reads}


def _rule(rule: object, kinds: tuple[str, ...], transforms: tuple[str, ...]) -> dict:
    if not isinstance(rule, dict) or not isinstance(rule.get("field"), str):
        raise SpecError(f"not a field rule: {rule!r}")
    name, kind, how = rule["field"], rule.get("selector_type"), rule.get("transform")
    try:
        if kind not in kinds:
            raise SpecError(f"unknown selector type {kind!r}")
        if how is not None and how not in transforms:
            raise SpecError(f"unknown transform {how!r}")
        out = {"kind": kind, "how": how, "attribute": rule.get("attribute")}
        if kind in ("css", "xpath"):
            return out | {"read": _selector(rule.get("selector"), kind)}
        if not isinstance(rule.get("selector"), str):
            raise SpecError(f"a selector must be text, got {rule.get('selector')!r}")
        if kind == "regex":
            re.compile(rule["selector"], re.DOTALL)
        return out | {"read": rule["selector"]}
    except (ValueError, re.error, RecursionError) as problem:
        raise SpecError(f"field {name!r}: {problem}") from None


def compile_spec(text: str | None, cardinality: str, kinds: tuple[str, ...], transforms: tuple[str, ...], part: str = "field_rules") -> str:
    """The program of one stored spec; ``SpecError`` says what is wrong with it."""
    try:
        spec = json.loads(text or "")
    except (ValueError, RecursionError) as problem:
        raise SpecError(f"unreadable JSON: {problem}") from None
    if not isinstance(spec, dict) or not isinstance(spec.get(part), list):
        raise SpecError(f"a spec needs {part}")
    rules: dict[str, dict] = {}
    for rule in spec[part]:
        made = _rule(rule, kinds, transforms)
        rules[rule["field"]] = made
    container, kind = spec.get("container_selector"), spec.get("container_selector_type") or "css"
    try:
        if kind not in kinds or kind == "regex":
            raise SpecError(f"containers cannot be selected by {kind!r}")
        if cardinality == "one":
            each, found = "page", None
        elif kind == "json_ld":
            each, found = "object", container
        else:
            each, found = "element", _selector(container or "*", kind)
    except (ValueError, RecursionError) as problem:
        raise SpecError(f"container: {problem}") from None
    following = None
    if spec.get("next_page_selector"):
        kind = spec.get("next_page_selector_type") or "css"
        try:
            if kind not in ("css", "xpath"):
                raise SpecError(f"links cannot be selected by {kind!r}")
            following = {"kind": kind, "attribute": spec.get("next_page_attribute") or "href", "read": _selector(spec["next_page_selector"], kind)}
        except (ValueError, RecursionError) as problem:
            raise SpecError(f"next page: {problem}") from None
    return json.dumps({"each": each, "container": found, "rules": rules, "next": following}, ensure_ascii=False)


def compiled(specs: DataFrame, cardinality: str, kinds: tuple[str, ...], transforms: tuple[str, ...], part: str = "field_rules") -> DataFrame:
    """``spec_id, program, spec_error`` of the distinct specs of a frame with ``spec_id`` and ``spec_json``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            programs: list[str | None] = []
            errors: list[str | None] = []
            for text in batch.column(1).to_pylist():
                try:
                    programs.append(compile_spec(text, cardinality, kinds, transforms, part))
                    errors.append(None)
                except ValueError as problem:
                    programs.append(None)
                    errors.append(str(problem))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(programs, pa.string()), pa.array(errors, pa.string())], names=["spec_id", "program", "spec_error"])

    return specs.select("spec_id", "spec_json").distinct().mapInArrow(run, "spec_id string, program string, spec_error string")


# ------------------------------------------------------------------- evaluating
def _compare(op: str | None, value: str | None) -> Callable[[str], bool]:
    if op is None:
        return lambda a: True
    if op == "=":
        return lambda a: a == value
    if op == "!=":
        return lambda a: a != value
    if not value:
        return lambda a: False
    return {
        "~=": lambda a: value in a.split(), "|=": lambda a: a == value or a.startswith(value + "-"), "^=": lambda a: a.startswith(value),
        "$=": lambda a: a.endswith(value), "*=": lambda a: value in a,
    }[op]


def _check(test: list) -> Callable[[Page, int], bool]:
    """A test as a function of page and element."""
    kind, *args = test
    if kind == "any":
        return lambda p, i: True
    if kind == "tag":
        return lambda p, i: p.tag[i] == args[0]
    if kind == "class":
        return lambda p, i: args[0] in p.classes[i]
    if kind == "attr":
        name, good = args[0], _compare(args[1], args[2])
        return lambda p, i: (a := p.attr(i, name)) is not None and good(a)
    if kind == "nth":
        where, a, b = args
        place = {
            "sib": lambda p, i: p.sib_pos[i], "last": lambda p, i: p.n_sib[i] - p.sib_pos[i] + 1,
            "type": lambda p, i: p.tag_pos[i], "last_type": lambda p, i: p.n_tag[i] - p.tag_pos[i] + 1,
        }[where]
        if a == 0:
            return lambda p, i: place(p, i) == b
        return lambda p, i: (place(p, i) - b) % abs(a) == 0 and (place(p, i) - b) * a >= 0
    if kind == "child":
        return lambda p, i: p.parent_id[i] >= 0
    if kind == "root":
        return lambda p, i: p.parent_id[i] < 0
    if kind == "empty":
        return lambda p, i: p.end_id[i] == i and p.t0[i] == p.t1[i]
    if kind in ("is", "not"):
        groups = [[_check(t) for t in group] for group in args[0]]
        wanted = kind == "is"
        return lambda p, i: any(all(t(p, i) for t in group) for group in groups) == wanted
    if kind == "text":
        whole, good = args[0] == "all", _compare(args[1], args[2])
        return lambda p, i: good(p.text(i)) if whole else any(good(t) for t in p.own.get(i, ()))
    if kind == "space":
        name, whole, value = args[0], args[1] == "all", args[2]
        if name:
            return lambda p, i: " ".join((p.attr(i, name) or "").split()) == value
        return lambda p, i: " ".join((p.text(i) if whole else p.first_text[i] or "").split()) == value
    raise ValueError(f"unknown test {kind!r}")


class Page:
    """One shredded page as the evaluator sees it; columns of its elements are made when first asked for."""

    def __init__(self, html: bytes | str) -> None:
        self.html = html if isinstance(html, bytes) else html.encode("utf-8", "replace")
        self._tree = tree = shredding.parse_page(self.html)
        self.tag, self.parent_id, self.end_id, self.h0, self.h1 = tree.tags, tree.parent_id, tree.end_id, tree.h0, tree.h1
        self.t0, self.t1, self.attrs, self.classes = tree.t0, tree.t1, tree.attrs, tree.classes
        self.data = b"".join(tree.text_parts)
        self._objects: list[dict] | None = None

    def __getattr__(self, name: str) -> list | dict:
        if name == "by_tag":
            self.by_tag: dict[str, list[int]] = {}
            for i, tag in enumerate(self.tag):
                if tag in self.by_tag:
                    self.by_tag[tag].append(i)
                else:
                    self.by_tag[tag] = [i]
        elif name == "own":
            self.own = self._tree.own
        elif name in _RARE:
            setattr(self, name, self._tree.columns(("parent_id", name))[1])
        else:
            raise AttributeError(name)
        return self.__dict__[name]

    def attr(self, i: int, name: str) -> str | None:
        for k, v in self.attrs[i]:
            if k == name:
                return v
        return None

    def text(self, i: int) -> str:
        return self.data[self.t0[i] : self.t1[i]].decode("utf-8", "replace")

    def source(self, i: int) -> str:
        return self.html[self.h0[i] : self.h1[i]].decode("utf-8", "replace")

    def objects(self) -> list[dict]:
        """JSON-LD objects in document order: arrays and graphs unfolded, a graph's wrapper after its members."""
        if self._objects is None:
            self._objects = []
            for i, tag in enumerate(self.tag):
                if tag != "script" or (self.attr(i, "type") or "").lower() != "application/ld+json":
                    continue
                try:
                    todo = [(json.loads(self.text(i)), False)]
                except (ValueError, RecursionError):
                    continue
                while todo:
                    value, done = todo.pop()
                    if isinstance(value, list):
                        todo += [(x, False) for x in reversed(value)]
                    elif isinstance(value, dict) and not done and isinstance(value.get("@graph"), list):
                        todo += [(value, True), *((x, False) for x in reversed(value["@graph"]))]
                    elif isinstance(value, dict):
                        self._objects.append(value)
        return self._objects


class Finder:
    """A compiled selector: the elements it finds below (or at) an element, in document order."""

    def __init__(self, data: dict) -> None:
        self.scope, self.reads = data["scope"], data["reads"]
        self.chains = [[(link, [_check(t) for t in tests]) for link, tests in chain] for chain in data["chains"]]
        # A first step that names a tag starts from the elements of that tag.
        self.first: list[tuple[str | None, list]] = []
        for _, tests in (chain[0] for chain in data["chains"]):
            tag = next((t[1] for t in tests if t[0] == "tag"), None)
            self.first.append((tag, [_check(t) for t in tests if tag is None or tuple(t) != ("tag", tag)]))
        # The usual rule, one step to an element of a named tag, need not find more than it reads.
        self.short = len(self.chains) == 1 and len(self.chains[0]) == 1 and self.scope != "page" and self.chains[0][0][0] != "self" and self.first[0][0] is not None
        if self.short:
            self.short_tag, self.short_tests = self.first[0]
            self.short_child, self.short_from = self.chains[0][0][0] == "/", 0 if self.scope == "self" else 1

    def _each(self, p: Page, root: int) -> Iterator[int]:
        """``find`` of a short selector, one by one."""
        ids = p.by_tag.get(self.short_tag)
        if ids:
            high, tests, child = p.end_id[root], self.short_tests, self.short_child
            for at in range(bisect_left(ids, root + self.short_from), len(ids)):
                i = ids[at]
                if i > high:
                    return
                if child and p.parent_id[i] != root:
                    continue
                for test in tests:
                    if not test(p, i):
                        break
                else:
                    yield i

    def find(self, p: Page, root: int) -> list[int]:
        if len(self.chains) == 1:
            return self._chain(p, root, self.chains[0], *self.first[0])
        return sorted({i for chain, first in zip(self.chains, self.first) for i in self._chain(p, root, chain, *first)})

    def _chain(self, p: Page, root: int, chain: list, tag: str | None, tests: list) -> list[int]:
        link = chain[0][0]
        if link == "self":
            return [root]
        if self.scope == "page":
            low, high = 0, len(p.tag) - 1
            pool = self._pool(p, 0, 0 if link == "/" else high, tag)
        else:
            low, high = root, p.end_id[root]
            pool = self._pool(p, low if self.scope == "self" else low + 1, high, tag)
            if link == "/":
                pool = [i for i in pool if p.parent_id[i] == root]
        found = [i for i in pool if all([t(p, i) for t in tests])]
        for link, tests in chain[1:]:
            if not found:
                break
            found = [i for i in self._linked(p, found, link, high) if all(t(p, i) for t in tests)]
        return found

    @staticmethod
    def _pool(p: Page, low: int, high: int, tag: str | None) -> list[int] | range:
        if tag is None:
            return range(low, high + 1)
        ids = p.by_tag.get(tag, [])
        return ids[bisect_left(ids, low) : bisect_right(ids, high)]

    @staticmethod
    def _linked(p: Page, found: list[int], link: str, high: int) -> Iterator[int]:
        """Elements that hang on ``found`` (in document order) by ``link``; each element is looked at once."""
        if link in (" ", "//"):
            reach = -1
            for i in found:
                if i > reach:  # an element inside another found one adds nothing
                    yield from range(i + 1, p.end_id[i] + 1)
                    reach = p.end_id[i]
            return
        near = set(found)
        if link in (">", "/"):
            reach = -1
            for i in found:
                if i > reach:
                    yield from (j for j in range(i + 1, p.end_id[i] + 1) if p.parent_id[j] in near)
                    reach = p.end_id[i]
        elif link == "+":
            first = found[0]
            yield from (j for j in range(first + 1, high + 1) if p.prev_id[j] in near)
        else:
            after: set[int] = set()  # parents with a found child so far
            for j in range(found[0], high + 1):
                if p.parent_id[j] in after:
                    yield j
                if j in near and p.parent_id[j] >= 0:
                    after.add(p.parent_id[j])

    def read(self, p: Page, root: int, attribute: str | None) -> str | None:
        found = self._each(p, root) if self.short else self.find(p, root)
        if self.reads == "text()":
            return next((p.first_text[i] for i in found if p.first_text[i] is not None), None)
        if self.reads:
            return next((a for i in found if (a := p.attr(i, self.reads[1:].lower())) is not None), None)
        for i in found:
            return p.attr(i, attribute) if attribute and attribute != "text" else p.text(i)
        return None


def path_text(value: object, dotted: str) -> str | None:
    """Text of the scalar at a dotted path; of a list its first element counts."""
    for part in [*dotted.split("."), None]:
        if isinstance(value, list):
            value = value[0] if value else None
        if part is not None:
            value = value.get(part) if isinstance(value, dict) else None
    return str(value) if isinstance(value, (str, int, float)) else None


class Program:
    """A runnable program."""

    def __init__(self, text: str) -> None:
        data = json.loads(text)
        self.each, self.container = data["each"], data["container"]
        if self.each == "element":
            self.container = Finder(self.container)
        self.rules: dict[str, tuple[Callable[[Page, int | None], str | None], str | None]] = {
            name: (self._reader(rule), rule["how"]) for name, rule in data["rules"].items()}
        self.paths = {name: rule["read"] for name, rule in data["rules"].items() if rule["kind"] == "json_ld"}
        following = data["next"]
        self.next = self._reader(following) if following else None

    @staticmethod
    def _reader(rule: dict) -> Callable[[Page, int | None], str | None]:
        read, attribute = rule["read"], rule["attribute"]
        if rule["kind"] in ("css", "xpath"):
            finder = Finder(read)
            return lambda p, i: finder.read(p, i or 0, attribute)
        if rule["kind"] == "json_ld":
            return lambda p, i: next((v for o in p.objects() if (v := path_text(o, read)) is not None), None)
        pattern = re.compile(read, re.DOTALL)

        def search(p: Page, i: int | None) -> str | None:
            m = pattern.search(p.html.decode("utf-8", "replace") if i is None else p.source(i))
            return m and (m[1] if pattern.groups else m[0])

        return search

    def rows(self, p: Page) -> Iterator[dict[str, str | None]]:
        if self.each == "object":
            for o in p.objects():
                kind = o.get("@type")
                if self.container is None or kind == self.container or isinstance(kind, list) and self.container in kind:
                    yield {name: path_text(o, self.paths[name]) if name in self.paths else None for name in self.rules}
            return
        for i in [None] if self.each == "page" else self.container.find(p, 0):
            yield {name: read(p, i) for name, (read, _) in self.rules.items()}


CELLS = T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("how", T.StringType())]))


def run_programs(pages: DataFrame, fields: list[str], links: bool = False) -> DataFrame:
    """Rows of pages by their programs: the columns of ``pages`` but html and programs, ``slot, row_no, cells``.

    ``pages``: page_id, page_url, html, ``programs`` (array of texts, NULL for a bad spec) and any others. ``slot`` is the place of
    the program in the list. ``cells`` follow ``fields``: the raw text and its transform, 'absent' for a field without rule.
    With ``links``, a next link is the one cell of a row numbered ``LINK``.
    """
    carry = [f for f in pages.schema.fields if f.name not in ("html", "programs")]
    schema = T.StructType([*carry, T.StructField("slot", T.IntegerType()), T.StructField("row_no", T.IntegerType()), T.StructField("cells", CELLS)])
    names = [f.name for f in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        ready: dict[str, Program] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                at: list[int] = []
                slots: list[int] = []
                numbers: list[int] = []
                ends, raws, kinds = [0], [], []
                sources = batch.column(batch.schema.get_field_index("html")).cast(pa.binary()).to_pylist()
                listed = batch.column(batch.schema.get_field_index("programs")).to_pylist()
                for row, (source, texts) in enumerate(zip(sources, listed)):
                    page = Page(source or b"") if texts and any(texts) else None
                    for slot, text in enumerate(texts or ()):
                        if text is None or source is None:
                            continue
                        if text not in ready:
                            if len(ready) >= 1_000:
                                ready.clear()
                            ready[text] = Program(text)
                        program = ready[text]
                        hows = [(program.rules[f][1] or "") if f in program.rules else "absent" for f in fields]
                        if links and program.next and (value := program.next(page, 0)):
                            at.append(row), slots.append(slot), numbers.append(LINK), raws.append(value), kinds.append(""), ends.append(len(raws))
                        for number, values in enumerate(program.rows(page)):
                            at.append(row), slots.append(slot), numbers.append(number)
                            raws.extend([values.get(f) for f in fields]), kinds.extend(hows), ends.append(len(raws))
                take = pa.array(at, pa.int64())
                made = pa.StructArray.from_arrays([pa.array(raws, pa.string()), pa.array(kinds, pa.string())], names=["raw", "how"])
                cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(n)).take(take) for n in names), pa.array(slots, pa.int32()), pa.array(numbers, pa.int32()),
                     cells], names=schema.names)

    return pages.mapInArrow(run, schema)


def run_one(pages: DataFrame, program: str, keep_html: bool, sources: bool) -> DataFrame:
    """The elements that one program finds on every page: the columns of ``pages``, ``next_raw`` and ``found``.

    ``found`` has a struct per container, or one for the page: raw texts of the css and xpath rules by their position (``f0`` ...),
    and with ``sources`` the container's html. Rules of other kinds are NULL there. NULL html finds nothing.
    """
    rules = list(json.loads(program)["rules"].values())
    tree = [i for i, rule in enumerate(rules) if rule["kind"] in ("css", "xpath")]
    names = [*(f"f{i}" for i in tree), "source"]
    carried = [f for f in pages.schema.fields if keep_html or f.name != "html"]
    found_type = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    schema = T.StructType([*carried, T.StructField("next_raw", T.StringType()), T.StructField("found", found_type)])
    carry = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        ready = Program(program)
        readers = [read for read, _ in ready.rules.values()]
        readers = [readers[i] for i in tree]
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                following: list[str | None] = []
                ends, columns = [0], [[] for _ in names]
                for source in batch.column(batch.schema.get_field_index("html")).cast(pa.binary()).to_pylist():
                    page = None if source is None else Page(source)
                    following.append(ready.next(page, 0) if page and ready.next else None)
                    roots = [] if page is None else [0] if ready.each == "page" else ready.container.find(page, 0)
                    for column, read in zip(columns, readers):
                        column.extend([read(page, i) for i in roots])
                    columns[-1].extend([page.source(i) for i in roots] if sources else [None] * len(roots))
                    ends.append(len(columns[-1]))
                made = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(n)) for n in carry), pa.array(following, pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], names=schema.names)

    return pages.mapInArrow(run, schema)
