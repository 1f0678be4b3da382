"""A recursive-descent parser for Rust items, statements and expressions.

It keeps what measures and shapes need: control flow, operators, calls, closures, macros as opaque leaves, and the lines of
each node. Types and patterns are read over; a pattern keeps its outline. A text it cannot read raises CodeError.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import islice

from .lexer import CodeError, Token, stream


@dataclass
class Node:
    kind: str
    first: int
    last: int
    kids: list[Node] = field(default_factory=list)
    text: str = ""
    braced: bool = False  # of macros


@dataclass
class Function:
    name: str
    owner: str | None
    first: int
    last: int
    body: Node
    params: str
    nested: list[Function]
    is_test: bool


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")
BINARY = {op: p for p, ops in enumerate([["||"], ["&&"], ["==", "!=", "<", ">", "<=", ">="], ["|"], ["^"], ["&"], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]], 4) for op in ops}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="}
ITEM = {"fn", "struct", "enum", "impl", "trait", "mod", "use", "static", "type", "extern", "pub", "macro_rules"}
ENDS = {")", "]", "}", ",", ";", "=>", ""}


#: Tokens read at once, and the most that a look ahead needs.
READ, LOOK = 2048, 4


class Parser:
    """t holds the tokens from the last item's end to a little ahead. With a sink, functions that are in no other go there item by item, and found keeps none."""

    def __init__(self, text: str, sink: Callable[[Function], None] | None = None):
        self.source, self.sink, self.inside = stream(text), sink, 0
        self.t, self.i, self.found = [], 0, []
        self.fill()

    # tokens
    def fill(self) -> None:
        self.t += islice(self.source, READ)

    def rest(self) -> None:
        """Over what is left of the text, for errors in its tokens."""
        for _ in self.source:
            pass

    def between(self) -> None:
        """After an item: what was read is let go. Nobody holds a place in t across items."""
        if self.i > READ:
            del self.t[: self.i - 1]
            self.i = 1
        if self.sink and not self.inside:
            for f in self.found:
                self.sink(f)
            self.found.clear()

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def at(self, *texts: str) -> bool:
        token = self.t[self.i]
        return token.text in texts and token.kind in ("name", "punct")

    def ahead(self, n: int = 1) -> str:
        return self.t[min(self.i + n, len(self.t) - 1)].text

    def take(self) -> Token:
        token = self.now
        if token.kind == "end":
            raise CodeError(f"line {token.line}: the text ends too early")
        self.i += 1
        if self.i + LOOK > len(self.t):
            self.fill()
        return token

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.take()
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.at(text):
            raise CodeError(f"line {self.now.line}: {text!r} expected, not {self.now.text!r}")
        return self.take()

    def prior(self) -> int:
        return self.t[self.i - 1].last

    def group(self) -> Token:
        """Over a bracketed group; its last token."""
        stack = [OPEN[self.take().text]]
        while stack:
            token = self.take()
            if token.kind == "punct" and token.text in OPEN:
                stack.append(OPEN[token.text])
            elif token.kind == "punct" and token.text in CLOSE and token.text != stack.pop():
                raise CodeError(f"line {token.line}: {token.text!r} does not fit")
        return token

    def angles(self) -> str:
        """Over <...>; the outline of what is inside."""
        begin, depth = self.i, 0
        while True:
            if self.at(*OPEN):
                self.group()
                continue
            token = self.take()
            if token.kind == "punct":
                depth += {"<": 1, "<<": 2, ">": -1, ">>": -2}.get(token.text, 0)
                if token.text in (">=", ">>="):  # a closing angle before an equals sign
                    depth -= token.text.count(">")
                    if depth == 0:
                        self.i -= 1
                        self.t[self.i] = token._replace(text="=")
                if depth < 0:  # the second of >> closes an outer list
                    self.i -= 1
                    self.t[self.i] = token._replace(text=">")
                    depth = 0
                if depth == 0:
                    return outline(self.t[begin : self.i])

    def until(self, *stops: str) -> str:
        """Over tokens and groups to one of the stops; their outline."""
        begin = self.i
        while not self.at(*stops):
            if self.at(*OPEN):
                self.group()
            elif self.now.kind == "punct" and self.now.text in CLOSE:
                raise CodeError(f"line {self.now.line}: one of {stops} expected")
            else:
                self.take()
        return outline(self.t[begin : self.i])

    # types
    def type(self) -> None:
        while self.at("&", "&&", "*", "mut", "const", "dyn", "impl", "?", "unsafe", "async", "~") or self.now.kind == "life":
            if self.now.kind == "life" and self.ahead() not in ("mut", "dyn", "+") and self.t[self.i + 1].kind not in ("name", "punct"):
                break
            self.take()
            if self.at("+"):
                self.take()
        if self.eat("for"):
            self.angles()
            return self.type()
        if self.eat("extern"):
            if self.now.kind == "str":
                self.take()
            return self.type()
        if self.at("(", "["):
            self.group()
        elif self.eat("fn"):
            self.group()
        elif self.at("!") or self.at("_"):
            self.take()
        elif self.at("<"):
            self.angles()
        elif self.now.kind == "name":
            self.take()
            if self.at("!"):
                self.take()
                self.group()
        elif not self.at("::"):
            raise CodeError(f"line {self.now.line}: a type expected, not {self.now.text!r}")
        while True:
            if self.eat("::"):
                if self.at("<"):
                    self.angles()
                elif not self.at("("):
                    self.take()
            elif self.at("<"):
                self.angles()
            elif self.at("(") and self.t[self.i - 1].kind == "name":
                self.group()
            elif self.eat("->"):
                self.type()
            else:
                break
        while self.at("+") and (self.t[self.i + 1].kind in ("name", "life") or self.ahead() in ("?", "(", "for", "~", "::")):
            self.take()
            if self.now.kind == "life":
                self.take()
            else:
                self.type()
        return None

    # items
    def file(self) -> list[Function]:
        self.items("", None)
        return self.found

    def attributes(self) -> list[str]:
        out = []
        while self.at("#"):
            self.take()
            self.eat("!")
            begin = self.i
            self.group()
            out.append("".join(t.text for t in self.t[begin + 1 : self.i - 1]))
        return out

    def items(self, end: str, owner: str | None) -> None:
        while self.now.text != end if end else self.now.kind != "end":
            self.item(owner)
            self.between()
        if end:
            self.need(end)

    def skip_visibility(self) -> None:
        if self.eat("pub") and self.at("("):
            self.group()

    def item(self, owner: str | None) -> None:
        marks = self.attributes()
        if not self.now.text or self.at("}"):
            return
        self.skip_visibility()
        self.eat("default") if self.ahead() in ("fn", "impl", "const", "type", "unsafe", "async") else None
        while self.at("const", "async", "unsafe", "safe", "extern", "auto") and self.ahead() in ("fn", "unsafe", "async", "extern", "impl", "trait", "const", "mod") or self.at("extern") and self.t[self.i + 1].kind == "str":
            self.take()
            if self.now.kind == "str":
                self.take()
        if self.at("fn"):
            self.function(owner, "test" in marks)
        elif self.eat("impl"):
            if self.at("<") and self.ahead() != "<":
                self.angles()
            self.eat("const")
            self.eat("!")
            begin = self.i
            self.type()
            if self.eat("for"):
                begin = self.i
                self.type()
            name = path_name(self.t[begin : self.i])
            self.until("{")
            self.take()
            self.items("}", name)
        elif self.eat("trait"):
            name = self.take().text
            if self.until("{", ";") is not None and self.eat(";"):
                return
            self.take()
            self.items("}", name)
        elif self.eat("mod"):
            self.take()
            if not self.eat(";"):
                self.need("{")
                kept, gone = self.found, "cfg(test)" in marks
                self.found = [] if gone else kept
                self.inside += gone
                self.items("}", owner)
                self.inside -= gone
                self.found = kept
        elif self.at("{"):  # extern "C" { ... }
            self.group()
        elif self.at("struct", "enum", "union"):
            self.until("{", ";", "(")
            if self.at("("):
                self.group()
                self.until(";")
            self.group() if self.at("{") else self.take()
        elif self.at("use", "static", "const", "type", "extern"):
            self.until(";")
            self.take()
        elif self.now.kind == "name" and (self.ahead() == "!" or self.ahead() == "::"):
            self.until("!")
            self.take()
            if self.now.kind == "name":
                self.take()
            brace = self.at("{")
            self.group()
            if not brace:
                self.eat(";")
        elif not self.eat(";"):
            raise CodeError(f"line {self.now.line}: an item expected, not {self.now.text!r}")

    def function(self, owner: str | None, is_test: bool) -> None:
        first = self.need("fn").line
        name = self.take().text
        if self.at("<"):
            self.angles()
        begin = self.i
        self.group()
        params = outline(self.t[begin : self.i])
        if self.eat("->"):
            self.type()
        if self.at("where"):
            self.until("{", ";")
        if self.eat(";"):
            return
        kept, self.found = self.found, []
        self.inside += 1
        body = self.block()
        self.inside -= 1
        nested, self.found = self.found, kept
        self.found.append(Function(name, owner, first, body.last, body, params, nested, is_test))

    # statements
    def block(self) -> Node:
        first = self.need("{").line
        kids = []
        while not self.at("}"):
            if (s := self.statement()) is not None:
                kids.append(s)
        return Node("block", first, self.take().last, kids)

    def starts_item(self) -> bool:
        t, nxt = self.now.text, self.ahead()
        if self.now.kind != "name":
            return False
        if t in ("const", "static"):
            return nxt != "{" and not (t == "static" and nxt in ("|", "||", "move")) and not (t == "const" and nxt in ("async", "move", "|", "||"))
        if t == "unsafe":
            return nxt != "{"
        if t == "async":
            return nxt in ("fn", "unsafe", "extern")
        if t == "union":
            return self.t[self.i + 1].kind == "name"
        return t in ITEM and nxt != "!" if t != "macro_rules" else nxt == "!"

    def statement(self) -> Node | None:
        first = self.now.line
        self.attributes()
        if self.eat(";"):
            return None
        if self.at("}"):
            return None
        if self.at("let"):
            self.take()
            shape, kids = self.until(":", "=", ";"), []
            if self.eat(":"):
                self.type()
            if self.eat("="):
                kids.append(self.expression())
                if self.eat("else"):
                    kids.append(self.block())
            return Node("let", first, self.need(";").last, kids, shape)
        if self.starts_item():
            self.item(None)
            return Node("item", first, self.prior())
        node = self.expression(statement=True)
        ended = self.eat(";")
        if not ended and not self.at("}") and not block_like(node):
            raise CodeError(f"line {self.now.line}: ';' expected, not {self.now.text!r}")
        return Node("stmt", first, self.prior(), [node], ";" if ended else "")

    # expressions
    def expression(self, plain: bool = False, least: int = 0, statement: bool = False) -> Node:
        """plain: no struct literal, as in conditions. least: the weakest operator to take."""
        first = self.now.line
        self.attributes()
        left = self.prefix(plain, least)
        if statement and block_like(left) and not self.at(".", "?"):
            return left
        left = self.postfix(left)
        while True:
            op = self.now.text if self.now.kind in ("punct", "name") else ""
            if op == "as" and least <= 13:
                self.take()
                self.type()
                left = Node("cast", first, self.prior(), [left])
            elif op in BINARY and self.now.kind == "punct" and BINARY[op] >= least:
                self.take()
                right = self.expression(plain, BINARY[op] + 1)
                left = Node("binary", first, right.last, [left, right], op)
            elif op in ("..", "..=") and least <= 3:
                self.take()
                kids = [left] if self.range_ends(plain) else [left, self.expression(plain, 4)]
                left = Node("range", first, self.prior(), kids, op)
            elif op in ASSIGN and self.now.kind == "punct" and least <= 2:
                self.take()
                right = self.expression(plain, 2)
                left = Node("assign", first, right.last, [left, right], op)
            else:
                return left

    def range_ends(self, plain: bool) -> bool:
        return self.now.text in ENDS and self.now.kind in ("punct", "end") or plain and self.at("{")

    def prefix(self, plain: bool, least: int) -> Node:
        token, first = self.now, self.now.line
        done = lambda kind, kids=(), text="": Node(kind, first, self.prior(), list(kids), text)
        if token.kind in ("num", "str", "char"):
            self.take()
            return done("lit", text=("float" if "." in token.text else "int") if token.kind == "num" else token.kind)
        if token.kind == "life":
            self.take()
            if self.eat(":"):
                inner = self.prefix(plain, least)
                inner.first = first
                return inner
            return done("life")
        if token.kind == "punct":
            if token.text in ("-", "!", "*", "&", "&&"):
                self.take()
                text = token.text
                if text in ("&", "&&"):
                    if self.at("raw") and self.ahead() in ("const", "mut"):
                        self.take()
                        self.take()
                    elif self.eat("mut"):
                        text += "mut"
                return done("unary", [self.expression(plain, 14)], text)
            if token.text in ("|", "||"):
                return self.closure(first, plain)
            if token.text in ("..", "..="):
                self.take()
                return done("range", [] if self.range_ends(plain) else [self.expression(plain, 4)], token.text)
            if token.text == "(":
                kids, comma = self.listed("(", ")")
                return kids[0] if len(kids) == 1 and not comma else done("tuple", kids)
            if token.text == "[":
                return done("array", self.listed("[", "]")[0])
            if token.text == "{":
                return self.block()
            if token.text in ("<", "::"):
                return self.path(first, plain)
            raise CodeError(f"line {first}: an expression expected, not {token.text!r}")
        word = token.text
        if word == "if":
            return self.conditional()
        if word == "match":
            self.take()
            subject = self.expression(plain=True)
            self.need("{")
            arms = []
            while not self.at("}"):
                arms.append(self.arm())
            self.take()
            return done("match", [subject, *arms])
        if word in ("while", "loop", "for"):
            self.take()
            if word == "while":
                kids = [self.expression(plain=True)]
            elif word == "for":
                self.until("in")
                self.take()
                kids = [self.expression(plain=True)]
            else:
                kids = []
            return done(word, [*kids, self.block()])
        if word in ("unsafe", "const") and self.ahead() == "{":
            self.take()
            return done(word, [self.block()])
        if word in ("async", "gen") and (self.ahead() == "{" or self.ahead() == "move" and self.ahead(2) == "{"):
            self.take()
            self.eat("move")
            return done("async", [self.block()])
        if word in ("move", "static", "async", "const") and self.ahead() in ("|", "||", "move", "async", "static"):
            while self.at("move", "static", "async", "const"):
                self.take()
            return self.closure(first, plain)
        if word == "for" and self.ahead() == "<":
            self.take()
            self.angles()
            return self.closure(first, plain)
        if word == "let":
            self.take()
            shape = self.until("=")
            self.take()
            return done("let_in", [self.expression(plain, 6)], shape)  # binds closer than && and ||
        if word in ("return", "break", "continue", "yield"):
            self.take()
            if word != "return" and self.now.kind == "life":
                self.take()
            empty = word == "continue" or self.range_ends(plain)
            return done(word, [] if empty else [self.expression(plain)])
        return self.path(first, plain)

    def closure(self, first: int, plain: bool) -> Node:
        shape = ""
        if not self.eat("||"):
            self.need("|")
            shape = self.until("|")
            self.take()
        if self.eat("->"):
            self.type()
            body = self.block()
        else:
            body = self.expression(plain)
        return Node("closure", first, body.last, [body], shape)

    def conditional(self) -> Node:
        first = self.need("if").line
        kids = [self.expression(plain=True), self.block()]
        if self.eat("else"):
            kids.append(self.conditional() if self.at("if") else self.block())
        return Node("if", first, self.prior(), kids)

    def arm(self) -> Node:
        first = self.now.line
        self.attributes()
        shape, kids = self.until("if", "=>"), []
        if self.eat("if"):
            kids.append(Node("guard", self.now.line, 0, [self.expression()]))
            kids[0].last = self.prior()
        self.need("=>")
        body = self.expression(statement=True)
        kids.append(body)
        if not self.eat(",") and not self.at("}") and not block_like(body):
            raise CodeError(f"line {self.now.line}: ',' expected, not {self.now.text!r}")
        return Node("arm", first, body.last, kids, shape)

    def listed(self, begin: str, end: str) -> tuple[list[Node], bool]:
        self.need(begin)
        kids, comma = [], False
        while not self.at(end):
            kids.append(self.expression())
            if self.at(",", ";"):
                comma = True
                self.take()
            elif not self.at(end):
                raise CodeError(f"line {self.now.line}: {end!r} expected, not {self.now.text!r}")
        self.take()
        return kids, comma

    def path(self, first: int, plain: bool) -> Node:
        generics = ""
        if self.at("<"):
            self.angles()
        elif not self.at("::"):
            if self.now.kind != "name":
                raise CodeError(f"line {first}: an expression expected, not {self.now.text!r}")
            self.take()
        name = self.t[self.i - 1].text
        while self.at("::"):
            self.take()
            if self.at("<"):
                generics = self.angles()
            else:
                name, generics = self.take().text, ""
        if self.at("!") and self.ahead() in OPEN:
            self.take()
            self.group()
            return Node("macro", first, self.prior(), [], name, self.t[self.i - 1].text == "}")
        if self.at("{") and not plain and self.is_struct():
            self.take()
            kids = []
            while not self.at("}"):
                self.attributes()
                if self.eat(".."):
                    if not self.at("}"):
                        kids.append(self.expression())
                    continue
                line = self.take().line
                kids.append(Node("field", line, self.prior(), [self.expression()] if self.eat(":") else []))
                kids[-1].last = self.prior()
                if not self.eat(",") and not self.at("}"):
                    raise CodeError(f"line {self.now.line}: '}}' expected, not {self.now.text!r}")
            self.take()
            return Node("struct", first, self.prior(), kids, generics)
        return Node("path", first, self.prior(), [], generics)

    def is_struct(self) -> bool:
        a, b = self.t[min(self.i + 1, len(self.t) - 1)], self.ahead(2)
        return a.text in ("}", "..", "#") or a.kind in ("name", "num") and b in (":", ",", "}")

    def postfix(self, node: Node) -> Node:
        while True:
            if self.eat("?"):
                node = Node("try", node.first, self.prior(), [node])
            elif self.at("("):
                node = Node("call", node.first, 0, [node, *self.listed("(", ")")[0]])
                node.last = self.prior()
            elif self.at("["):
                node = Node("index", node.first, 0, [node, *self.listed("[", "]")[0]])
                node.last = self.prior()
            elif self.at("."):
                self.take()
                member = self.take()
                if self.at("::"):
                    self.take()
                    self.angles()
                if member.kind == "name" and member.text != "await" and self.at("("):
                    args = self.listed("(", ")")[0]
                    node = Node("method", node.first, self.prior(), [node, *args, Node("called", member.line, self.prior())], member.text)
                else:
                    node = Node("await" if member.text == "await" else "member", node.first, self.prior(), [node])
            else:
                return node


def block_like(node: Node) -> bool:
    return node.kind in ("if", "match", "while", "loop", "for", "block", "unsafe", "async", "const") or node.braced


def path_name(path: list[Token]) -> str | None:
    """The last name of a plain path type, without what is in angles; null for other types."""
    if not path or path[0].kind != "name" and path[0].text != "::" or path[0].text in ("dyn", "impl", "fn", "mut", "const"):
        return None
    depth, name = 0, None
    for t in path:
        depth += {"<": 1, "<<": 2, ">": -1, ">>": -2}.get(t.text, 0) if t.kind == "punct" else 0
        if depth == 0 and t.kind == "name":
            name = t.text
    return name


#: Words that an outline keeps.
KEPT = {"self", "mut", "ref", "_", "dyn", "impl", "box"}


def outline(some: list[Token]) -> str:
    """Tokens without names and values."""
    return " ".join(t.text if t.kind == "punct" or t.text in KEPT else t.kind for t in some)
