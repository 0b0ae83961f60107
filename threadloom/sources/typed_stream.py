"""Text of a typed stream, the archive format of attributed strings, read by its grammar.

A stream is a version, its signature and a system version, then groups: a type encoding and a value for each of its
codes. Encodings and class names are shared strings, objects and classes shared objects: each is written out once and
numbered, later ones are back-references. An object is its class, groups of its own, and an end mark. A class is a
name, a version and its superclass.
"""

from __future__ import annotations

import struct

SIGNATURE = b"streamtyped"
# The marks of the format.
TWO_BYTES, FOUR_BYTES, FLOATING, NEW, NIL, END, FIRST_REFERENCE = 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x92
INTEGERS, PLAIN_BYTES = "sSiIlLqQB", "cC"
#: Objects within objects at most; deeper streams are taken for broken.
DEPTH = 100


class Broken(ValueError):
    pass


class _Found(Exception):
    """Carries the payload of the first object of the wanted class."""


class Stream:
    """One pass over a stream's bytes; every read stays within them."""

    def __init__(self, data: bytes, wanted: str):
        self.data, self.at, self.wanted = data, 0, wanted
        self.strings: list[bytes] = []
        self.objects: list[tuple[str, ...] | None] = []  # classes by the names of their chain, others None

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Broken
        self.at += n
        return self.data[self.at - n : self.at]

    def mark(self) -> int:
        return self.take(1)[0]

    def integer(self, mark: int | None = None) -> int:
        mark = self.mark() if mark is None else mark
        if mark == TWO_BYTES:
            return struct.unpack("<H", self.take(2))[0]
        if mark == FOUR_BYTES:
            return struct.unpack("<I", self.take(4))[0]
        if FLOATING <= mark < FIRST_REFERENCE:
            raise Broken
        return mark

    def reference(self, mark: int, table: list):
        number = self.integer(mark) - FIRST_REFERENCE
        if not 0 <= number < len(table):
            raise Broken
        return table[number]

    def shared_string(self) -> bytes | None:
        mark = self.mark()
        if mark == NIL:
            return None
        if mark != NEW:
            return self.reference(mark, self.strings)
        self.strings.append(self.take(self.integer()))
        return self.strings[-1]

    def klass(self, depth: int) -> tuple[str, ...]:
        """The names of a class and of those above it."""
        mark = self.mark()
        if mark == NIL:
            return ()
        if mark != NEW:
            return self.reference(mark, self.objects) or ()
        if depth > DEPTH:
            raise Broken
        name = (self.shared_string() or b"").decode("ascii", "replace")
        self.integer()  # the class's version
        at = len(self.objects)
        self.objects.append((name,))
        self.objects[at] = (name, *self.klass(depth + 1))
        return self.objects[at]

    def object(self, depth: int) -> None:
        mark = self.mark()
        if mark == NIL:
            return
        if mark != NEW:
            self.reference(mark, self.objects)
            return
        if depth > DEPTH:
            raise Broken
        self.objects.append(None)
        chain = self.klass(depth)
        while self.data[self.at : self.at + 1] != bytes([END]):
            self.group(depth + 1, chain)
        self.at += 1

    def group(self, depth: int, owner: tuple[str, ...] = ()) -> None:
        codes = (self.shared_string() or b"").decode("ascii", "replace")
        at = 0
        while at < len(codes):
            at = self.value(codes, at, depth, owner)

    def value(self, codes: str, at: int, depth: int, owner: tuple[str, ...]) -> int:
        """Read what the code at `at` stands for; returns the place of the next code."""
        code = codes[at]
        if code == "+":
            payload = self.take(self.integer())
            if self.wanted in owner:
                raise _Found(payload)
        elif code == "@":
            self.object(depth)
        elif code == "#":
            self.klass(depth)
        elif code in "*%:":
            mark = self.mark()
            if mark == NEW:
                self.objects.append(None)
                self.shared_string()
            elif mark != NIL:
                self.reference(mark, self.objects)
        elif code in PLAIN_BYTES:
            self.take(1)
        elif code in INTEGERS:
            self.integer()
        elif code in "fd":
            mark = self.mark()
            if mark == FLOATING:
                self.take(4 if code == "f" else 8)
            else:
                self.integer(mark)
        elif code == "[":
            digits = at + 1
            while codes[digits : digits + 1].isdigit():
                digits += 1
            count, end = int(codes[at + 1 : digits] or 0), _closing(codes, at, "[", "]")
            if codes[digits:end] in PLAIN_BYTES:
                self.take(count)
            elif count > len(self.data):
                raise Broken
            else:
                for _ in range(count):
                    self.value(codes[digits:end], 0, depth, owner)
            return end + 1
        elif code in "{(":
            end = _closing(codes, at, code, "}" if code == "{" else ")")
            inner = codes[at + 1 : end].partition("=")[2]
            place = 0
            while place < len(inner):
                place = self.value(inner, place, depth, owner)
            return end + 1
        else:
            raise Broken
        return at + 1


def _closing(codes: str, at: int, opening: str, closing: str) -> int:
    depth = 0
    for i in range(at, len(codes)):
        depth += (codes[i] == opening) - (codes[i] == closing)
        if not depth:
            return i
    raise Broken


def first_text(data: bytes | None, wanted: str = "NSString") -> str | None:
    """The text of a stream's first object that is of class `wanted` or below it: an attributed string begins with its own.

    Null, other bytes, and streams that break off before or hold no such object give null; an empty text too.
    """
    if not data:
        return None
    stream = Stream(bytes(data), wanted)
    try:
        stream.integer()
        if stream.take(stream.integer()) != SIGNATURE:
            return None
        stream.integer()
        while stream.at < len(stream.data):
            stream.group(0)
    except _Found as found:
        return found.args[0].decode("utf-8", "replace") or None
    except (Broken, RecursionError):
        return None
    return None
