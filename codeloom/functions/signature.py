"""Generic signatures of class files as readable text.

The grammar is that of the Java Virtual Machine Specification, 4.7.9.1: type parameters with bounds, class types with
arguments and wildcards, type variables, arrays, and what methods take, return and throw."""

from __future__ import annotations

_PRIMITIVE = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


class _Signature:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, expected: str = "") -> str:
        c = self.peek()
        if not c or (expected and c != expected):
            raise ValueError(f"a signature has {c!r} at {self.at}, not {expected or 'more'}")
        self.at += 1
        return c

    def until(self, stops: str) -> str:
        start = self.at
        while self.peek() and self.peek() not in stops:
            self.at += 1
        return self.text[start : self.at]

    def type(self) -> str:
        c = self.take()
        if c in _PRIMITIVE:
            return _PRIMITIVE[c]
        if c == "[":
            return self.type() + "[]"
        if c == "T":
            name = self.until(";")
            self.take(";")
            return name
        if c != "L":
            raise ValueError(f"no type begins with {c!r}")
        out = ""
        while True:
            out += self.until("<;.").replace("/", ".")
            if self.peek() == "<":
                out += self.arguments()
            if self.take() == ";":
                return out
            out += "."

    def arguments(self) -> str:
        self.take("<")
        out = []
        while self.peek() != ">":
            c = self.peek()
            if c in "*+-":
                self.take()
            out.append("?" if c == "*" else f"? extends {self.type()}" if c == "+" else f"? super {self.type()}" if c == "-" else self.type())
        self.take(">")
        return f"<{', '.join(out)}>"

    def parameters(self) -> str:
        """Type parameters; a bound that all types have is left out."""
        if self.peek() != "<":
            return ""
        self.take()
        out = []
        while self.peek() != ">":
            name, bounds = self.until(":"), []
            while self.peek() == ":":
                self.take()
                if self.peek() not in (":", ">") and self.peek() in "LT[":
                    bounds.append(self.type())
            bounds = [b for b in bounds if b != "java.lang.Object"]
            out.append(name + (f" extends {' & '.join(bounds)}" if bounds else ""))
        self.take(">")
        return f"<{', '.join(out)}>"


def readable(signature: str | None) -> str | None:
    """A class's, method's or field's signature as text; null stays null, what can't be read stays as it is."""
    if not signature:
        return signature
    s = _Signature(signature)
    try:
        own = s.parameters()
        if s.peek() == "(":
            s.take()
            takes = []
            while s.peek() != ")":
                takes.append(s.type())
            s.take()
            gives = s.type()
            thrown = []
            while s.peek() == "^":
                s.take()
                thrown.append(s.type())
            out = f"{own + ' ' if own else ''}{gives} ({', '.join(takes)})" + (f" throws {', '.join(thrown)}" if thrown else "")
        else:
            first = s.type()
            rest = []
            while s.peek():
                rest.append(s.type())
            out = f"{own + ' ' if own else ''}{', '.join([first, *rest])}"
    except ValueError:
        return signature
    return out if s.at == len(signature) else signature
