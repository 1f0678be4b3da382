"""Complexity, signals with their lines, and shapes of parsed functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from .lexer import CodeError
from .parser import Function, Node, Parser

DECISIONS = {"if", "while", "loop", "for", "arm"}
LOGIC = ("&&", "||")
#: Macros that mark unfinished code, and the one that panics.
STUBS, PANIC = {"todo", "unimplemented", "dbg"}, "panic"


def inside(node: Node, stop: set[str]) -> Iterator[Node]:
    """The node and all below it, but nothing of the kinds to stop at."""
    todo = [node]
    while todo:
        here = todo.pop()
        if here.kind not in stop:
            yield here
            todo += reversed(here.kids)


def decisions(body: Node) -> tuple[int, int]:
    """Decisions and uses of ?, without closures and nested items."""
    count = tries = 0
    for n in inside(body, {"closure", "item"}):
        count += n.kind in DECISIONS or n.kind == "binary" and n.text in LOGIC
        tries += n.kind == "try"
    return count, tries


class Walk:
    """One statement: the deepest level, the worst condition, stubs and panics."""

    def __init__(self, stmt: Node):
        self.most, self.logic, self.worst, self.stubs, self.panics = 0, 0, None, [], []
        self.visit(stmt, 0)

    def deeper(self, node: Node, depth: int) -> None:
        self.most = max(self.most, depth + 1)
        self.visit(node, depth + 1)

    def condition(self, node: Node, depth: int) -> None:
        n = sum(x.kind == "binary" and x.text in LOGIC for x in inside(node, {"closure", "if", "match", "block"}))
        if n > self.logic:
            self.logic, self.worst = n, (node.first, node.last)
        self.visit(node, depth)

    def visit(self, node: Node, depth: int) -> None:
        kind, kids = node.kind, node.kids
        if kind == "item":
            return
        if kind == "if":
            self.condition(kids[0], depth)
            self.deeper(kids[1], depth)
            for other in kids[2:]:
                # an else-if goes on at the level of its chain
                self.visit(other, depth) if other.kind == "if" else self.deeper(other, depth)
        elif kind == "match":
            self.visit(kids[0], depth)
            self.most = max(self.most, depth + 1)
            for arm in kids[1:]:
                for x in arm.kids:
                    self.condition(x.kids[0], depth + 1) if x.kind == "guard" else self.visit(x, depth + 1)
        elif kind in ("while", "for", "loop"):
            for x in kids[:-1]:
                self.condition(x, depth) if kind == "while" else self.visit(x, depth)
            self.deeper(kids[-1], depth)
        elif kind in ("closure", "async"):
            self.deeper(kids[0], depth)
        elif kind == "let":
            for k, x in enumerate(kids):
                self.deeper(x, depth) if k else self.visit(x, depth)
        else:
            if kind == "macro":
                place = (node.first, node.last)
                self.stubs += [place] if node.text in STUBS else []
                self.panics += [place] if node.text == PANIC else []
            elif kind == "method" and {"unwrap": 0, "expect": 1}.get(node.text) == len(kids) - 2:
                self.panics.append((kids[-1].first, kids[-1].last))
            for x in kids:
                self.visit(x, depth)


def signals(f: Function) -> tuple[dict[str, int], dict[str, list]]:
    values = {"nesting": 0, "lines": f.last - f.first + 1, "bumps": 0, "bool_ops": 0, "stubs": 0, "panics": 0}
    spans: dict[str, list] = {k: [] for k in values} | {"lines": [(f.first, f.last)]}
    for stmt in f.body.kids:
        w = Walk(stmt)
        if w.most > values["nesting"]:
            values["nesting"], spans["nesting"] = w.most, [(stmt.first, stmt.last)]
        if w.most >= 2:
            values["bumps"] += 1
            spans["bumps"].append((stmt.first, stmt.last))
        if w.logic > values["bool_ops"]:
            values["bool_ops"], spans["bool_ops"] = w.logic, [w.worst]
        for name, sites in (("stubs", w.stubs), ("panics", w.panics)):
            values[name] += len(sites)
            spans[name] += sites
    return values, spans


def each(text: str, measure: Callable[[Function], list[dict]], put: Callable[[dict], None]) -> None:
    """put() each measured row as soon as its item is read. Raises at the text's end what reading it whole would have: the first bad token, else what could not be parsed, else what could not be measured."""
    failed: list[RecursionError] = []

    def one(f: Function) -> None:
        try:
            for row in [] if failed else measure(f):
                put(row)
        except RecursionError as e:
            failed.append(e)

    parser = Parser(text, one)
    try:
        parser.file()
    except (CodeError, RecursionError):
        parser.rest()
        raise
    if failed:
        raise failed[0]


def function_rows(f: Function) -> list[dict]:
    """A function that a coverage report can hold: none in tests, none inside others."""
    if f.is_test:
        return []
    count, tries = decisions(f.body)
    values, spans = signals(f)
    name = f"{f.owner}::{f.name}" if f.owner else f.name
    return [{"name": name, "start_line": f.first, "end_line": f.last, "decisions": count, "tries": tries, "signals": values, "spans": spans}]


def functions(text: str) -> list[dict]:
    out: list[dict] = []
    each(text, function_rows, out.append)
    return out


def shape(node: Node, found: set[int]) -> tuple[str, int]:
    """The hash of a subtree without names and values, and its number of nodes; all hashes below go into found."""
    parts, size = [], 1
    for k in node.kids:
        if k.kind in ("called", "item"):
            continue
        h, n = shape(k, found)
        parts.append(h)
        size += n
    kind = "stmt" if node.kind == "stmt" else node.kind
    text = "" if node.kind in ("macro", "method") else node.text
    digest = hashlib.blake2b(f"{kind}\x00{text}\x00{len(parts)}\x00{''.join(parts)}".encode(), digest_size=8).hexdigest()
    found.add(int(digest, 16) - (1 << 63))
    return digest, size


def shape_rows(outer: Function) -> list[dict]:
    """A function that is not in a test, and nested ones, under bare names: the set of shapes and the number of nodes."""
    out, todo = [], [outer]
    while todo:
        f = todo.pop(0)
        if f.is_test:
            continue
        found: set[int] = set()
        tree = Node("fn", f.first, f.last, [f.body], f.params)
        _, size = shape(tree, found)
        out.append({"name": f.name, "start_line": f.first, "end_line": f.last, "node_count": size, "shapes": sorted(found)})
        todo = f.nested + todo
    return out


def shapes(text: str) -> list[dict]:
    out: list[dict] = []
    each(text, shape_rows, out.append)
    return out
