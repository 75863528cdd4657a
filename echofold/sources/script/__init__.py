"""A parser for TypeScript and JavaScript that keeps structure and leaves names and literals out.

It builds the tree that the language's public compiler interface describes, child for child, except that
identifiers and literals give no node: they are no part of a structural fingerprint. Syntax that it doesn't
know raises ParseError; nothing is skipped.
"""

from echofold.sources.script.parser import parse
from echofold.sources.script.tokens import ParseError
from echofold.sources.script.tree import Node

__all__ = ["Node", "ParseError", "parse"]
