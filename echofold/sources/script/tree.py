"""Nodes of a parsed file."""

from __future__ import annotations

from bisect import bisect_right
import re


class Node:
    """kind, source span, kept children in source-tree order, and markers of the node's own shape."""

    __slots__ = ("kind", "start", "end", "kids", "marks")

    def __init__(self, kind: str, start: int, end: int, kids: list["Node"], marks: list[str]):
        self.kind, self.start, self.end, self.kids, self.marks = kind, start, end, kids, marks

    def __repr__(self) -> str:
        inner = ", ".join(map(repr, self.kids))
        return f"{self.kind}{sorted(self.marks) if self.marks else ''}({inner})"


_BREAK = re.compile("\r\n|[\n\r\u2028\u2029]")


class LineMap:
    """1-based line numbers of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in _BREAK.finditer(text))]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)
