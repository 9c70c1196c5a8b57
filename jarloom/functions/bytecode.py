"""Class files to signatures: one line for the class, then its fields, methods and inner classes."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# fixed values: access flags, in the order in which modifiers are written
PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL, SYNCHRONIZED, VOLATILE, BRIDGE, TRANSIENT = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x40, 0x80
NATIVE, INTERFACE, ABSTRACT, STRICT, SYNTHETIC, ENUM = 0x100, 0x200, 0x400, 0x800, 0x1000, 0x4000
MODIFIERS = [
    ("synthetic", SYNTHETIC, "cfm"), ("bridge", BRIDGE, "cm"), ("public", PUBLIC, "cfm"), ("protected", PROTECTED, "cfm"), ("private", PRIVATE, "cfm"),
    ("final", FINAL, "cfm"), ("abstract", ABSTRACT, "cfm"), ("static", STATIC, "cfm"), ("native", NATIVE, "cfm"), ("synchronized", SYNCHRONIZED, "m"),
    ("enum", ENUM, "cfm"), ("strictfp", STRICT, "cfm"), ("transient", TRANSIENT, "f"), ("volatile", VOLATILE, "f"),
]
PRIMITIVES = {"Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double", "V": "void"}
ANNOTATION = "java/lang/annotation/Annotation"


def modifiers(access: int, kind: str) -> str:
    return "".join(f"{word} " for word, flag, kinds in MODIFIERS if access & flag and kind in kinds)


def simple(name: str) -> str:
    """A type's name without packages and outer classes."""
    return name.replace("$", "/").replace(".", "/").rstrip("/").rsplit("/", 1)[-1]


def dotted(name: str) -> str:
    return name.replace("/", ".").replace("$", ".")


class Types:
    """Reads descriptors and generic signatures from left to right."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def more(self, stop: str = "") -> bool:
        return self.at < len(self.text) and self.text[self.at] not in (stop or "\0")

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def until(self, marks: str) -> str:
        start = self.at
        while self.text[self.at] not in marks:
            self.at += 1
        return self.text[start : self.at]

    def one(self) -> str:
        c = self.take()
        if c == "[":
            return self.one() + "[]"
        if c == "*":
            return "?"
        if c in "+-":
            return ("? extends " if c == "+" else "? super ") + self.one()
        if c == "^":
            return self.one()
        if c == "T":
            name = self.until(";")
            self.take()
            return name
        if c == "L":
            while True:  # what outer classes are given as parameters is left out
                name, given = simple(self.until("<;.")), ""
                if self.text[self.at] == "<":
                    self.take()
                    given = f"<{','.join(self.many('>'))}>"
                    self.take()
                if self.take() == ";":
                    return name + given
        return PRIMITIVES[c]

    def many(self, stop: str = "") -> list[str]:
        out = []
        while self.more(stop):
            out.append(self.one())
        return out

    def parameters(self) -> str:
        """<T:bound...>: the first bound belongs to the name, each further one is an item without a name; Object is not written."""
        if not self.more() or self.text[0] != "<":
            return ""
        self.take()
        items = []
        while self.more(">"):
            name = self.until(":")
            while self.more() and self.text[self.at] == ":":
                self.take()
                if self.text[self.at] == ":":
                    continue
                bound = self.one()
                items.append(name + (f" extends {bound}" if bound != "Object" else ""))
                name = ""
        self.take()
        return f"<{','.join(x for x in items if x)}>"


def method_types(text: str) -> tuple[str, str]:
    """What comes back (with thrown types, where a generic signature names them) and the parameters."""
    t = Types(text[text.index("(") + 1 :])
    given = ",".join(t.many(")"))
    t.take()
    return ",".join(t.many()), given


@dataclass
class Member:
    access: int
    name: str
    descriptor: str
    generic: str | None
    thrown: list[str] = field(default_factory=list)


class ClassFile:
    """The parts of a class file that its signature needs; bodies are skipped."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        magic, _, _, count = self.read(">IHHH")
        if magic != 0xCAFEBABE:
            raise ValueError("not a class file")
        self.pool: list = [None] * count
        k = 1
        while k < count:
            (tag,) = self.read(">B")
            if tag == 1:
                (n,) = self.read(">H")
                self.pool[k] = self.bytes(n).replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
            elif tag in (7, 8, 16, 19, 20):
                (self.pool[k],) = self.read(">H")
            elif tag in (3, 4, 9, 10, 11, 12, 17, 18):
                self.read(">I")
            elif tag in (5, 6):
                self.read(">Q")
                k += 1
            elif tag == 15:
                self.read(">BH")
            else:
                raise ValueError(f"constant of kind {tag}")
            k += 1
        self.access, this, above, n = self.read(">HHHH")
        self.name, self.above = self.class_at(this), self.class_at(above)
        self.interfaces = [self.class_at(k) for k in self.read(f">{n}H")]
        self.fields, self.methods = self.members(), self.members()
        found = self.attributes()
        self.generic = self.text(found.get("Signature"))
        self.access |= SYNTHETIC * ("Synthetic" in found)
        self.inner: list[tuple[str, str, str, int]] = []  # its name, its outer class, its simple name, its access
        table = found.get("InnerClasses", b"\0\0")
        for k in range(struct.unpack_from(">H", table)[0]):
            i, o, s, a = struct.unpack_from(">HHHH", table, 2 + 8 * k)
            if o and s:
                self.inner.append((self.class_at(i), self.class_at(o), self.pool[s], a))

    def read(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def bytes(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("cut short")
        return self.data[self.at - n : self.at]

    def class_at(self, k: int) -> str:
        return self.pool[self.pool[k]] if k else ""

    def text(self, raw: bytes | None) -> str | None:
        return self.pool[struct.unpack(">H", raw)[0]] if raw else None

    def attributes(self) -> dict[str, bytes]:
        out = {}
        for _ in range(self.read(">H")[0]):
            name, n = self.read(">HI")
            out[self.pool[name]] = self.bytes(n)
        return out

    def members(self) -> list[Member]:
        out = []
        for _ in range(self.read(">H")[0]):
            access, name, descriptor = self.read(">HHH")
            a = self.attributes()
            thrown = a.get("Exceptions", b"\0\0")
            names = [self.class_at(k) for k in struct.unpack_from(f">{struct.unpack_from('>H', thrown)[0]}H", thrown, 2)]
            out.append(Member(access | SYNTHETIC * ("Synthetic" in a), self.pool[name], self.pool[descriptor], self.text(a.get("Signature")), names))
        return out


def line_order(line: str) -> tuple[str, str]:
    return line.lower(), line


class MissingInner(Exception):
    pass


def written(m: Member, c: ClassFile, access: int) -> bool:
    """Not what compilers add: synthetic methods, static initializers, and an enum's own values, valueOf and constructors."""
    if m.access & (SYNTHETIC | BRIDGE) or m.name == "<clinit>":
        return False
    if access & ENUM:
        if m.access & STATIC and (m.name == "values" and m.descriptor.startswith("()") or m.name == "valueOf" and m.descriptor.startswith("(Ljava/lang/String;)")):
            return False
        if m.access & PRIVATE and m.name == "<init>" and m.descriptor.startswith(("()", "(Ljava/lang/String;I)", "(Ljava/lang/String;ILjava/lang/String;I)")):
            return False
    return True


def class_line(c: ClassFile, access: int, level: int, inside: bool) -> str:
    given, above, beside = "", simple(c.above), [simple(x) for x in c.interfaces]
    if c.generic:
        t = Types(c.generic)
        given = t.parameters()
        rest = t.many()
        above, beside = (rest[0], rest[1:]) if c.interfaces else (",".join(rest), [])
    if access & INTERFACE and c.interfaces == [ANNOTATION]:
        beside = []
    line = modifiers(access, "c") + ("interface " if access & INTERFACE else "class ") + (simple(c.name) if inside else dotted(c.name)) + given
    if c.above not in ("", "java/lang/Object") and not access & ENUM:
        line += f" extends {above}"
    return f"c;{level};{'  ' * level}{line}{' implements ' + ','.join(beside) if beside else ''}".strip()


def block(c: ClassFile, access: int, parent: str | None, known: dict[str, ClassFile], sort_fields: bool, sort_methods: bool, sort_inner: bool) -> list[str]:
    level = c.name.rsplit("/", 1)[-1].count("$")
    if access & INTERFACE:
        access &= ~(ABSTRACT | STATIC)
    if access & ENUM:
        access &= ~(FINAL | STATIC | ABSTRACT)
    pad = "  " * (level + 1)
    fields = [f"f;{level};{pad}{modifiers(m.access, 'f')}{Types(m.generic or m.descriptor).one()} {m.name};" for m in c.fields if not m.access & SYNTHETIC]
    methods = []
    for m in c.methods:
        if not written(m, c, access):
            continue
        back, given = method_types(m.generic or m.descriptor)
        if parent is not None and m.name == "<init>" and not access & (ENUM | STATIC) and given.startswith(parent):  # the outer instance
            given = given[len(parent) :].removeprefix(",")
        own = m.access & ~(STRICT if access & STRICT else 0) & ~(ABSTRACT if access & INTERFACE else 0)
        thrown = f" throws {','.join(map(simple, m.thrown))}" if m.thrown else ""
        methods.append(f"m;{level};{pad}{modifiers(own, 'm')}{'' if m.name == '<init>' else back + ' '}{m.name}({given}){thrown}")
    inner: dict[str, int] = {}
    for _, outer, name, a in c.inner:
        if outer == c.name:
            inner[f"{dotted(c.name)}.{name}"] = a
    blocks = []
    for name in reversed(inner):
        if name not in known:
            raise MissingInner(name)
        blocks.append(block(known[name], inner[name], simple(c.name), known, sort_fields, sort_methods, sort_inner))
    if sort_inner:
        blocks.sort(key=lambda b: line_order(b[0]))
    lines = [class_line(c, access, level, parent is not None)]
    lines += sorted(fields, key=line_order) if sort_fields else fields
    lines += sorted(methods, key=line_order) if sort_methods else methods
    return lines + [x for b in blocks for x in b]


def class_signature(data: bytes, inner: list[bytes], sort_fields: bool = False, sort_methods: bool = False, sort_inner: bool = False) -> tuple[str, str, str]:
    """(package, class name, signature) of a class file with the class files of its inner classes. What can't be read gives a signature that begins with e;"""
    try:
        c = ClassFile(data)
        known = {dotted(x.name): x for x in map(ClassFile, inner)}
        package, _, name = dotted(c.name).rpartition(".")
        try:
            return package, name, "\n".join(block(c, c.access, None, known, sort_fields, sort_methods, sort_inner))
        except MissingInner as e:
            return package, name, f"e;-1;Failed to parse [{dotted(c.name)}]. Cannot find inner-class bytecode: [{e}]"
    except (ValueError, struct.error, IndexError, KeyError, TypeError, AttributeError) as e:
        return "", "", f"e;Could not parse bytecode. [{e}]"
