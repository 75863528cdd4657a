"""Structural fingerprints of syntax trees.

A node stands for its kind, its markers and its kept children; names and literals are no part of it. Each
subtree has a hash over its kind and its children's hashes in order, markers first. In post-order a subtree
is a contiguous range of hashes, so a candidate region needs only the ends of its range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

from echofold.sources.script.tree import LineMap, Node

#: The kinds of nodes that are candidate regions.
CANDIDATE_KINDS = frozenset(
    """
    ClassDeclaration InterfaceDeclaration TypeAliasDeclaration EnumDeclaration ModuleDeclaration FunctionDeclaration
    MethodDeclaration Constructor GetAccessor SetAccessor PropertyDeclaration
    PropertySignature MethodSignature CallSignature ConstructSignature IndexSignature
    VariableStatement EnumMember ArrowFunction FunctionExpression
    """.split()
)


#: The kinds of names and literals, which are no part of a structure. The parser makes no nodes of them.
DROPPED_KINDS = frozenset(
    """
    Identifier PrivateIdentifier StringLiteral NumericLiteral NoSubstitutionTemplateLiteral RegularExpressionLiteral
    BigIntLiteral TrueKeyword FalseKeyword NullKeyword
    """.split()
)


def tag(node: Node) -> str:
    return node.kind


def markers(node: Node) -> list[str]:
    """What a node's own shape adds beside its kind, in order."""
    return sorted(node.marks)


def keeps_structural_child(kind: str) -> bool:
    return kind not in DROPPED_KINDS and not kind.startswith("JSDoc")


@dataclass(frozen=True)
class NormalizedNode:
    """A tree of tags: markers first, as leaves, then the kept children. count takes in the node itself."""

    tag: str
    children: tuple["NormalizedNode", ...] = ()
    count: int = 1


def normalize(root: Node) -> NormalizedNode:
    """The normalized tree of a node of any depth."""
    stack: list[tuple[Node, list[NormalizedNode], list[NormalizedNode], bool]] = [(root, top := [], [], False)]
    while stack:
        node, siblings, own, done = stack.pop()
        if done:
            siblings.append(NormalizedNode(tag(node), tuple(own), 1 + sum(c.count for c in own)))
            continue
        own += [NormalizedNode(m) for m in markers(node)]
        stack.append((node, siblings, own, True))
        stack += [(kid, own, [], False) for kid in reversed(node.kids) if keeps_structural_child(kid.kind)]
    return top[0]


def subtree_hash(kind: str, children: list[int]) -> int:
    """53 bits, dependent on the order of children."""
    packed = kind.encode() + b"\0" + struct.pack(f"<{len(children)}Q", *children)
    return int.from_bytes(blake2b(packed, digest_size=8).digest(), "little") >> 11


@lru_cache(maxsize=4096)
def marker_hash(marker: str) -> int:
    return subtree_hash(marker, [])


def post_order(root: Node) -> tuple[list[int], list[tuple[Node, int, int]]]:
    """The hashes below root, itself left out, and for each candidate node the range of its subtree's."""
    hashes: list[int] = []
    found: list[tuple[Node, int, int]] = []
    waiting: list[tuple[Node, int, list[int]]] = []  # (node, where its range begins, its parent's child hashes)
    stack: list[tuple[Node, list[int], bool]] = [(kid, [], False) for kid in reversed(root.kids)]
    while stack:
        node, of_parent, done = stack.pop()
        if not done:
            own: list[int] = []
            waiting.append((node, len(hashes), own))
            for marker in sorted(node.marks):
                own.append(marker_hash(marker))
            hashes += own
            stack.append((node, of_parent, True))
            stack += [(kid, own, False) for kid in reversed(node.kids)]
            continue
        _, begin, own = waiting.pop()
        value = subtree_hash(node.kind, own)
        hashes.append(value)
        of_parent.append(value)
        if node.kind in CANDIDATE_KINDS:
            found.append((node, begin, len(hashes)))
    return hashes, found


def node_count(node: Node) -> int:
    """Nodes and markers of a subtree, the node itself included."""
    waiting, total = [node], 0
    while waiting:
        now = waiting.pop()
        total += 1 + len(now.marks)
        waiting += now.kids
    return total


def fingerprints(node: Node) -> set[int]:
    """The distinct hashes of a subtree."""
    return set(post_order(Node("", 0, 0, [node], []))[0])


def candidates(root: Node, text: str, min_lines: int, min_nodes: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(start_line, end_line, nodes, fingerprints) of the regions large enough, in document order."""
    lines = LineMap(text)
    hashes, found = post_order(root)
    for node, begin, end in sorted(found, key=lambda c: (c[0].start, -c[0].end, -c[2])):
        if end - begin < min_nodes:
            continue
        first, last = lines.line(node.start), lines.line(node.end)
        if last - first + 1 >= min_lines:
            yield first, last, end - begin, sorted(set(hashes[begin:end]))
