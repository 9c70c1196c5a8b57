"""Java sources to signatures, in the same form as class files give them."""

from __future__ import annotations

import re

from .bytecode import ABSTRACT, ENUM, FINAL, INTERFACE, NATIVE, PRIVATE, PROTECTED, PUBLIC, STATIC, STRICT, SYNCHRONIZED, TRANSIENT, VOLATILE, line_order, modifiers

BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)
TOKEN = re.compile(r'"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|[\w$]+|\.\.\.|->|::|[^\'"]', re.S)
WORDS = {"public": PUBLIC, "private": PRIVATE, "protected": PROTECTED, "static": STATIC, "final": FINAL, "synchronized": SYNCHRONIZED, "volatile": VOLATILE, "transient": TRANSIENT, "native": NATIVE, "abstract": ABSTRACT, "strictfp": STRICT, "default": 0, "sealed": 0}
CLOSING = {"(": ")", "[": "]", "{": "}"}
KINDS = ("class", "interface", "enum")


class SourceError(ValueError):
    pass


def tokens(text: str) -> list[str]:
    out, at = [], BLANK.match(text).end()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or text.startswith("/*", at):
            raise SourceError(f"unfinished text or comment at {at}")
        out.append(m.group())
        at = BLANK.match(text, m.end()).end()
    return out


class Source:
    """Reads declarations; bodies and values are passed over."""

    def __init__(self, text: str, sort_fields: bool = False, sort_methods: bool = False, sort_inner: bool = False):
        self.t, self.i, self.sorts = tokens(text), 0, (sort_fields, sort_methods, sort_inner)

    def peek(self, ahead: int = 0) -> str:
        return self.t[self.i + ahead] if self.i + ahead < len(self.t) else ""

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if not got or wanted and got not in wanted:
            raise SourceError(f"{got!r} at token {self.i} in place of {' '.join(wanted) or 'more'}")
        self.i += 1
        return got

    def has(self, word: str) -> bool:
        if self.peek() != word:
            return False
        self.i += 1
        return True

    def name(self) -> str:
        got = self.take()
        if not re.match(r"[^\W\d]|[$_]", got):
            raise SourceError(f"{got!r} at token {self.i - 1} in place of a name")
        return got

    def skip_group(self) -> None:
        """Over a bracket and all in it, however deep."""
        open_ = [CLOSING[self.take("(", "[", "{")]]
        while open_:
            got = self.take()
            if got in CLOSING:
                open_.append(CLOSING[got])
            elif got == open_[-1]:
                open_.pop()
            elif got in (")", "]", "}"):
                raise SourceError(f"{got!r} at token {self.i - 1} closes nothing")

    def skip_annotations(self) -> None:
        while self.peek() == "@" and self.peek(1) != "interface":
            self.take()
            self.name()
            while self.has("."):
                self.name()
            if self.peek() == "(":
                self.skip_group()

    def flags(self) -> int:
        out = 0
        while True:
            self.skip_annotations()
            if self.peek() == "non" and self.peek(1) == "-":
                self.i += 3
            elif self.peek() in WORDS and not (self.peek() == "sealed" and self.peek(1) in ("(", "=", ";")):
                out |= WORDS[self.take()]
            else:
                return out

    def dims(self) -> str:
        out = ""
        self.skip_annotations()
        while self.peek() == "[" and self.peek(1) == "]":
            self.i += 2
            out += "[]"
            self.skip_annotations()
        return out

    def type(self, whole: bool = False) -> str:
        """A type, without packages and outer classes unless whole."""
        self.skip_annotations()
        if self.has("?"):
            return f"? {self.take()} {self.type(whole)}" if self.peek() in ("extends", "super") else "?"
        out = self.name()
        while True:
            if self.peek() == "<":
                out += f"<{','.join(self.arguments(whole))}>"
            elif self.peek() == "." and self.peek(1) != ".":
                self.take()
                self.skip_annotations()
                out = f"{out}.{self.name()}" if whole else self.name()
            else:
                return out + self.dims()

    def types(self, whole: bool = False, mark: str = ",") -> list[str]:
        out = [self.type(whole)]
        while self.has(mark):
            out.append(self.type(whole))
        return out

    def arguments(self, whole: bool = False) -> list[str]:
        self.take("<")
        out = [] if self.peek() == ">" else self.types(whole)
        self.take(">")
        return out

    def parameters(self) -> str:
        """Type parameters as they are written."""
        if not self.has("<"):
            return ""
        out = []
        while True:
            self.skip_annotations()
            name = self.name()
            out.append(name + (" extends " + " & ".join(self.types(True, "&")) if self.has("extends") else ""))
            if not self.has(","):
                self.take(">")
                return f"<{','.join(out)}>"

    def skip_value(self) -> None:
        """Over a value, up to the comma or semicolon that ends it; commas in type arguments don't."""
        while self.peek() not in (",", ";"):
            if self.peek() in CLOSING:
                self.skip_group()
            elif self.peek() == "<":
                start = self.i
                try:
                    self.arguments()
                except SourceError:
                    self.i = start + 1
            else:
                self.take()

    def unit(self) -> list[tuple[str, str, str]]:
        package, out = "", []
        while self.peek():
            if self.has(";"):
                continue
            start = self.i
            self.skip_annotations()
            if self.has("package"):
                package = self.name()
                while self.has("."):
                    package += "." + self.name()
                self.take(";")
            elif self.peek() == "import":
                while self.take() != ";":
                    pass
            else:
                self.i = start
                name, lines = self.declaration(package, 0, self.flags())
                out.append((package, name, "\n".join(lines)))
        return out

    def begins_class(self) -> bool:
        return self.peek() in KINDS or self.peek() == "@" or self.peek() == "record" and self.peek(2) in ("(", "<")

    def declaration(self, package: str, level: int, access: int) -> tuple[str, list[str]]:
        self.has("@")
        kind = self.take(*KINDS, "record")
        name = self.name()
        access |= {"interface": INTERFACE, "enum": ENUM, "record": FINAL}.get(kind, 0)
        shown = access & ~(STATIC if access & (ENUM | INTERFACE) else 0) & ~(ABSTRACT if access & INTERFACE else 0)
        head = modifiers(shown, "c") + ("interface " if access & INTERFACE else "class ") + (f"{package}." if package else "") + name + self.parameters()
        fields, methods, inner = [], [], []
        pad = "  " * (level + 1)
        put = lambda flags, kind_, rest: f"{kind_};{level};{pad}{modifiers(flags, kind_)}{rest}"
        given = self.given() if kind == "record" else []
        fields += [put(PRIVATE | FINAL, "f", f"{t} {n};") for t, n in given]
        beside: list[str] = []
        while self.peek() in ("extends", "implements", "permits"):
            word = self.take()
            found = self.types()
            if word == "extends" and kind == "class":
                head += f" extends {found[0]}" if found[0] != "Object" else ""
            elif word != "permits":
                beside += found
        head += f" implements {','.join(beside)}" if beside else ""
        self.take("{")
        if kind == "enum":
            self.constants(lambda n: fields.append(put(PUBLIC | STATIC | FINAL | ENUM, "f", f"{name} {n};")))
        made = False
        while not self.has("}"):
            if self.has(";"):
                continue
            flags = self.flags()
            if self.peek() == "{":
                self.skip_group()
                continue
            if self.begins_class():
                inner.append(self.declaration("", level + 1, flags | (PUBLIC | STATIC if access & INTERFACE else 0))[1])
                continue
            self.parameters()
            self.skip_annotations()
            if self.peek() == name and self.peek(1) in ("(", "{"):
                self.take()
                made = True
                types = [t for t, _ in (self.given() if self.peek() == "(" else given)]
                back, called = "", "<init>"
            else:
                back, called = self.type(), self.name()
                if self.peek() != "(":
                    more = FINAL | STATIC | PUBLIC if access & INTERFACE else 0
                    while True:
                        fields.append(put(flags | more, "f", f"{back}{self.dims()} {called};"))
                        if self.has("="):
                            self.skip_value()
                        if self.take(",", ";") == ";":
                            break
                        called = self.name()
                    continue
                types = [t for t, _ in self.given()]
                back += self.dims() + " "
            thrown = self.types() if self.has("throws") else []
            if self.has("default"):
                self.skip_value()
            if self.peek() == "{":
                self.skip_group()
            else:
                self.take(";")
            if access & ENUM and called == "<init>":
                flags |= PRIVATE
                if types in ([], ["String", "int"]):
                    continue
            if access & STRICT:
                flags &= ~STRICT
            if access & INTERFACE:
                flags = (flags | PUBLIC) & ~ABSTRACT
            methods.append(put(flags, "m", f"{back}{called}({','.join(types)}){' throws ' + ','.join(thrown) if thrown else ''}"))
        if kind in ("class", "record") and not made:  # the constructor that a compiler adds
            methods.insert(0, put(access & (PUBLIC | PROTECTED | PRIVATE), "m", f"<init>({','.join(t for t, _ in given)})"))
        if self.sorts[0]:
            fields.sort(key=line_order)
        if self.sorts[1]:
            methods.sort(key=line_order)
        if self.sorts[2]:
            inner.sort(key=lambda b: line_order(b[0]))
        return name, [f"c;{level};{'  ' * level}{head}", *fields, *methods, *(x for b in inner for x in b)]

    def constants(self, add) -> None:
        while True:
            self.skip_annotations()
            if self.peek() == "}" or self.has(";"):
                return
            add(self.name())
            if self.peek() == "(":
                self.skip_group()
            if self.peek() == "{":
                self.skip_group()
            self.has(",")

    def given(self) -> list[tuple[str, str]]:
        """A method's parameters as (type, name); a receiver is none."""
        self.take("(")
        out = []
        while not self.has(")"):
            self.flags()
            type_ = self.type()
            type_ += "[]" if self.has("...") else ""
            name = self.name()
            while self.has("."):
                name = self.name()
            if name != "this":
                out.append((type_ + self.dims(), name))
            if self.peek() != ")":
                self.take(",")
        return out


def source_signatures(text: str, sort_fields: bool = False, sort_methods: bool = False, sort_inner: bool = False) -> list[tuple[str, str, str]]:
    """(package, class name, signature) of each top-level class. A source that can't be read gives one signature that begins with e;

    In old sources that use enum as a name (Enumeration enum), the word stands for en everywhere.
    """
    if "Enumeration enum" in text:
        text = text.replace("enum", "en")
    try:
        return Source(text.removeprefix("﻿"), sort_fields, sort_methods, sort_inner).unit()
    except (SourceError, RecursionError) as e:
        return [("", "", f"e;Failed to parse Java. [{e}]")]
