"""What stands at a place in a line of source: the name, how it is used, and with how many arguments."""

from __future__ import annotations

import re

_STARTS = re.compile(r"[^\W\d]|\$")
_NEW = re.compile(r"\bnew\s*$")
_RECEIVER = re.compile(r"(?<![\w$.)\]])(?:[^\W\d][\w$]*\s*\.\s*)+$")


def masked(text: str) -> str:
    """The text, as long as it was, with what is in literals and comments blanked; the quotes stay."""
    out, at, n = [], 0, len(text)
    while at < n:
        rest = text[at : at + 3]
        if rest.startswith("//"):
            end = text.find("\n", at)
            end = n if end < 0 else end
            out.append(" " * (end - at))
        elif rest.startswith("/*"):
            end = text.find("*/", at + 2)
            end = n if end < 0 else end + 2
            out.append(" " * (end - at))
        elif rest == '"""':
            end = text.find('"""', at + 3)
            end = n if end < 0 else end + 3
            out.append('"' + " " * (end - at - 2) + '"' if end - at > 1 else '"')
        elif text[at] in "\"'":
            end = at + 1
            while end < n and text[end] not in (text[at], "\n"):
                end += 2 if text[end] == "\\" else 1
            end = min(end + 1, n)
            out.append(text[at] + " " * (end - at - 2) + text[at] if end - at > 1 else text[at])
        else:
            end = at + 1
            out.append(text[at])
        at = end
    return "".join(out)


def name_at(line: str, column: int) -> tuple[int, int] | None:
    """(start, end) of the name at a column, the first being 1, or that ends just before it; none if there is none."""
    part = lambda k: 0 <= k < len(line) and (line[k].isalnum() or line[k] in "_$")
    at = min(column - 1, len(line) - 1)
    if not part(at):
        at -= 1
    if column < 1 or not part(at):
        return None
    start, end = at, at + 1
    while part(start - 1):
        start -= 1
    while part(end):
        end += 1
    return (start, end) if _STARTS.match(line[start]) else None


def count_arguments(after: str) -> int | None:
    """The number of arguments in the brackets with which a text begins; none if they don't close or hold what may be generic types."""
    text = masked(after)
    if not text.startswith("("):
        return None
    stack: list[str] = []
    found, empty = 0, True
    pairs = {")": "(", "]": "[", "}": "{"}
    for c in text:
        if c in "([{":
            if stack:
                empty = False
            stack.append(c)
        elif c in ")]}":
            if not stack or stack.pop() != pairs[c]:
                return None
            if not stack:
                return found + (not empty) if not (found and empty) else None
            empty = False
        elif c == "<" and "{" not in stack:
            return None
        elif c == "," and len(stack) == 1:
            if empty:
                return None
            found, empty = found + 1, True
        elif not c.isspace():
            empty = False
    return None


def use_at(line: str, column: int, following: str = "") -> dict | None:
    """(identifier, receiver, context, arguments) of the name at a column: context is constructor, call, member or none; the receiver is the
    names before a dot, none where a call's result stands there. ``following``: the lines after it, where a call's brackets may close."""
    place = name_at(line, column)
    if place is None:
        return None
    start, end = place
    before, after = masked(line[:start]).rstrip(), (line[end:] + "\n" + following).lstrip()
    call = after.startswith("(")
    receiver = _RECEIVER.search(masked(line[:start])) if before.endswith(".") else None
    context = "constructor" if _NEW.search(before) else "call" if call else "member" if before.endswith(".") else "none"
    return {"identifier": line[start:end], "receiver": re.sub(r"\s", "", receiver.group()).rstrip(".") if receiver else None, "context": context, "arguments": count_arguments(after) if call else None}
