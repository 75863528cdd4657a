"""Recursive-descent parser over the token scanner.

Methods return a Node, or None for an identifier or literal, which have no node. Where the grammar needs
to look far ahead (arrow functions, type arguments in expressions) the parser tries one reading, and
remembers for each place whether that failed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from echofold.sources.script.tokens import PUNCTUATION, RESERVED, ParseError, Scanner
from echofold.sources.script.tree import Node

MODIFIERS = frozenset("public private protected static abstract override readonly declare export default async accessor const in out".split())
TYPE_KEYWORDS = frozenset("any unknown never string number boolean symbol object bigint undefined intrinsic".split())
ASSIGNMENTS = frozenset(p for p in PUNCTUATION if p.endswith("=") and p not in ("==", "===", "!=", "!==", "<=", ">="))
#: Binding strengths of binary operators.
STRENGTH = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "as": 8, "satisfies": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
LITERAL_KINDS = ("number", "string", "regex")


def keyword_kind(word: str) -> str:
    return f"{word[0].upper()}{word[1:]}Keyword"


def mark_kind(mark: str) -> str:
    return PUNCTUATION[mark] if mark in PUNCTUATION else keyword_kind(mark)


class Parser:
    def __init__(self, text: str, jsx: bool):
        self.s = Scanner(text)
        self.text = text
        self.jsx = jsx
        self.no_in = False
        self.no_conditional_type = False
        self.colon_must_follow = self.arrow_before_colon = False
        self.failed: set[tuple[str, int]] = set()

    # Tokens

    @property
    def kind(self) -> str:
        return self.s.kind

    @property
    def value(self) -> str:
        return self.s.value

    def fail(self, message: str | None = None):
        raise ParseError(message or f"Unexpected {'end of file' if self.kind == 'end' else repr(self.value)}", self.s.start)

    def at(self, *marks: str) -> bool:
        return self.s.kind in marks

    def word(self, *words: str) -> bool:
        return self.s.kind == "name" and self.s.value in words

    def identifier_here(self) -> bool:
        return self.s.kind == "name" and self.s.value not in RESERVED

    def take(self, mark: str) -> bool:
        if self.s.kind == mark:
            self.s.next()
            return True
        return False

    def take_word(self, word: str) -> bool:
        if self.word(word):
            self.s.next()
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            self.fail(f"'{mark}' expected.")

    def need_word(self, word: str) -> None:
        if not self.take_word(word):
            self.fail(f"'{word}' expected.")

    def identifier(self) -> None:
        if not self.identifier_here():
            self.fail("Identifier expected.")
        self.s.next()

    def any_name(self) -> None:
        if self.kind != "name":
            self.fail("Identifier expected.")
        self.s.next()

    def semicolon(self) -> None:
        if not self.take(";") and not (self.at("}", "end") or self.s.fresh):
            self.fail("';' expected.")

    def node(self, kind: str, start: int, *kids, marks: list[str] | tuple = ()) -> Node:
        flat: list[Node] = []
        for kid in kids:
            if isinstance(kid, list):
                flat += [k for k in kid if k is not None]
            elif kid is not None:
                flat.append(kid)
        return Node(kind, start, self.s.before, flat, list(marks))

    def token_node(self) -> Node:
        """A node for the current token."""
        start, kind = self.s.start, mark_kind(self.value)
        self.s.next()
        return self.node(kind, start)

    def optional(self, mark: str) -> Node | None:
        return self.token_node() if self.s.kind == mark else None

    def ahead(self, look: Callable[[], bool]) -> bool:
        state, flags = self.s.state(), (self.no_in, self.no_conditional_type)
        try:
            return look()
        except ParseError:
            return False
        finally:
            self.s.restore(state)
            self.no_in, self.no_conditional_type = flags

    def attempt(self, name: str, read: Callable[[], object]):
        """What read returns, or False (and nothing consumed) if it fails here."""
        here = (name, self.s.start)
        if here in self.failed:
            return False
        state, flags = self.s.state(), (self.no_in, self.no_conditional_type)
        try:
            return read()
        except ParseError:
            self.s.restore(state)
            self.no_in, self.no_conditional_type = flags
            self.failed.add(here)
            return False

    def with_in(self, read: Callable[[], object], no_in: bool = False):
        before, self.no_in = self.no_in, no_in
        found = read()
        self.no_in = before
        return found

    def listed(self, close: str, item: Callable[[], Node | None]) -> list:
        """Items with commas between and maybe one behind, up to and with close."""
        found = []
        while not self.at(close):
            found.append(item())
            if not self.take(","):
                break
        self.close(close)
        return found

    def close(self, mark: str) -> None:
        if mark == ">":
            if self.kind != ">":
                self.fail("'>' expected.")
            self.s.next()
        else:
            self.need(mark)

    # Files and statements

    def file(self) -> Node:
        statements = []
        while not self.at("end"):
            statements.append(self.statement())
        return self.node("SourceFile", 0, statements)

    def block(self, kind: str = "Block") -> Node:
        start = self.s.start
        self.need("{")
        return self.node(kind, start, self.with_in(self._statements_to_brace))

    def _statements_to_brace(self) -> list:
        found = []
        while not self.at("}"):
            if self.at("end"):
                self.fail("'}' expected.")
            found.append(self.statement())
        self.need("}")
        return found

    def statement(self) -> Node:
        start = self.s.start
        kind = self.kind
        if kind == "{":
            return self.block()
        if kind == ";":
            self.s.next()
            return self.node("EmptyStatement", start)
        if kind == "@":
            return self.declaration(start)
        if kind == "name":
            word = self.value
            handler = _STATEMENTS.get(word)
            if handler:
                return handler(self, start)
            if word in _DECLARATORS and self.ahead(self._declaration_follows):
                return self.declaration(start)
            if word not in RESERVED and self.ahead(lambda: self.s.next() or self.at(":")):
                self.s.next()
                self.need(":")
                return self.node("LabeledStatement", start, self.statement())
        expression = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", start, expression)

    def _declaration_follows(self) -> bool:
        """Whether the words here, of which some may be plain identifiers, begin a declaration."""
        while self.kind == "name":
            word = self.value
            self.s.next()
            if word in ("var", "let", "const", "function", "class", "enum"):
                return word != "let" or self.identifier_here() or self.at("{", "[")
            if word in ("interface", "type"):
                return self.identifier_here() and not self.s.fresh
            if word in ("namespace", "module"):
                return not self.s.fresh and (self.identifier_here() or self.kind == "string")
            if word == "global":
                return self.at("{") or self.identifier_here() or self.word("export")
            if word == "import":
                return self.kind in ("string", "*", "{") or self.kind == "name"
            if word == "export":
                return True
            if word == "using":
                return self.identifier_here() and not self.s.fresh and not self.word("of")
            if word == "await":
                if not self.word("using"):
                    return False
                continue
            if word in ("abstract", "accessor", "async", "declare", "private", "protected", "public", "readonly", "static", "override"):
                if self.s.fresh:
                    return False
                continue
            return False
        return False

    def decorators_and_modifiers(self, members: bool = False, parameter: bool = False) -> tuple[list[Node], list[str]]:
        """Modifier nodes in source order, and their markers."""
        nodes, marks = [], []
        while True:
            start = self.s.start
            if self.at("@"):
                self.s.next()
                nodes.append(self.node("Decorator", start, self.left_hand_side()))
                marks.append("decorator")
                continue
            if self.kind != "name" or self.value not in MODIFIERS or not self.ahead(lambda: self._modifier(members, parameter)):
                return nodes, marks
            kind = keyword_kind(self.value)
            self.s.next()
            nodes.append(self.node(kind, start))
            marks.append(f"modifier:{kind}")

    def _modifier(self, members: bool, parameter: bool) -> bool:
        """Whether the word here is a modifier where it stands, by what follows it."""
        word = self.value
        self.s.next()
        if parameter:
            return word in ("public", "private", "protected", "readonly", "override") and (self.kind == "name" or self.at("{", "["))
        if members:
            if word in ("const", "export", "default", "in", "out") or self.s.fresh and word != "static":
                return False
            return self.kind in ("name", "private", "string", "number") or self.at("[", "*")
        if word == "const":
            return self.word("enum")
        if word in ("export", "default"):
            return True
        if word == "async":
            return self.word("function") and not self.s.fresh
        if word in ("in", "out", "accessor"):
            return False
        return self.kind == "name" and not self.s.fresh or self.at("@")

    def declaration(self, start: int) -> Node:
        if self.word("export") and (special := self.export_form(start)):
            return special
        mods, marks = self.decorators_and_modifiers()
        word = self.value if self.kind == "name" else ""
        if word in ("var", "let", "const", "using", "await"):
            return self.variables(start, mods, marks)
        if word == "function":
            return self.function(start, mods, marks, "FunctionDeclaration")
        if word == "class":
            return self.class_like(start, mods, marks, "ClassDeclaration")
        if word == "interface":
            return self.interface(start, mods, marks)
        if word == "type":
            self.s.next()
            self.identifier()
            parameters = self.type_parameters()
            self.need("=")
            aliased = self.type()
            self.semicolon()
            return self.node("TypeAliasDeclaration", start, mods, parameters, aliased, marks=marks)
        if word == "enum":
            return self.enum(start, mods, marks)
        if word in ("namespace", "module", "global"):
            return self.module(start, mods, marks)
        if word == "import":
            return self.import_form(start, mods, marks)
        if mods and any(m.kind == "DefaultKeyword" for m in mods):
            # export default <expression>: no modifiers, an assignment.
            expression = self.assignment()
            self.semicolon()
            return self.node("ExportAssignment", start, [m for m in mods if m.kind == "Decorator"], expression, marks=[m for m in marks if m == "decorator"])
        return self.fail("Declaration expected.")

    def variables(self, start: int, mods: list[Node], marks: list[str]) -> Node:
        declared = self.variable_list()
        self.semicolon()
        return self.node("VariableStatement", start, mods, declared, marks=marks)

    def variable_list(self) -> Node:
        start = self.s.start
        word = self.value
        self.s.next()
        if word == "await":
            self.need_word("using")
        # Of the two using forms the flags of let, const and neither are seen.
        keyword = {"using": "var", "await": "const"}.get(word, word)
        items = [self.variable()]
        while self.take(","):
            items.append(self.variable())
        return self.node("VariableDeclarationList", start, items, marks=[f"variable:{keyword}"])

    def variable(self) -> Node:
        start = self.s.start
        name = self.binding_name()
        definite = self.token_node() if self.at("!") and not self.s.fresh else None
        annotation = self.annotation()
        initializer = self.assignment() if self.take("=") else None
        return self.node("VariableDeclaration", start, name, definite, annotation, initializer, marks=["definite"] if definite else [])

    def binding_name(self) -> Node | None:
        if self.at("[", "{"):
            return self.binding_pattern()
        if self.kind == "private":
            self.fail("Identifier expected.")
        self.identifier()
        return None

    def binding_pattern(self) -> Node:
        start = self.s.start
        if self.take("["):
            return self.node("ArrayBindingPattern", start, self.with_in(lambda: self.listed("]", self._array_binding)))
        self.need("{")
        return self.node("ObjectBindingPattern", start, self.with_in(lambda: self.listed("}", self._object_binding)))

    def _array_binding(self) -> Node:
        start = self.s.start
        if self.at(","):
            return Node("OmittedExpression", start, start, [], [])
        dots = self.optional("...")
        name = self.binding_name()
        return self.node("BindingElement", start, dots, name, self.assignment() if self.take("=") else None)

    def _object_binding(self) -> Node:
        start = self.s.start
        dots = self.optional("...")
        property_name = None
        if dots is None and (self.kind in ("string", "number") or self.at("[") or self.ahead(lambda: self.s.next() or self.at(":"))):
            property_name = self.property_name()
            self.need(":")
            name = self.binding_name()
        else:
            name = self.binding_name()
        return self.node("BindingElement", start, dots, property_name, name, self.assignment() if self.take("=") else None)

    def property_name(self) -> Node | None:
        start = self.s.start
        if self.take("["):
            expression = self.with_in(self.expression)
            self.need("]")
            return self.node("ComputedPropertyName", start, expression)
        if self.kind not in ("name", "private", "string", "number"):
            self.fail("Property name expected.")
        self.s.next()
        return None

    def function(self, start: int, mods: list[Node], marks: list[str], kind: str) -> Node:
        self.need_word("function")
        star = self.optional("*")
        if self.kind == "name" and (self.value not in RESERVED):
            self.s.next()
        elif kind == "FunctionDeclaration" and not any(m.kind == "DefaultKeyword" for m in mods):
            self.fail("Identifier expected.")
        return self.node(kind, start, mods, star, *self.signature(), self.body(kind == "FunctionDeclaration"), marks=marks)

    def signature(self) -> tuple[list, list, Node | None]:
        parameters = self.type_parameters()
        return parameters, self.parameters(), self.return_annotation()

    def body(self, may_lack: bool) -> Node | None:
        if self.at("{"):
            return self.block()
        if not may_lack:
            self.fail("'{' expected.")
        self.semicolon()
        return None

    def parameters(self) -> list:
        self.need("(")
        return self.with_in(lambda: self.listed(")", self.parameter))

    def parameter(self) -> Node:
        start = self.s.start
        mods, marks = self.decorators_and_modifiers(parameter=True)
        dots = self.optional("...")
        if self.word("this"):
            self.s.next()
            name = None
        else:
            name = self.binding_name()
        question = self.optional("?")
        annotation = self.annotation()
        initializer = self.assignment() if self.take("=") else None
        return self.node("Parameter", start, mods, dots, name, question, annotation, initializer, marks=[*marks, *(["optional"] if question else [])])

    def annotation(self) -> Node | None:
        return self.type() if self.take(":") else None

    def return_annotation(self) -> Node | None:
        return self.return_type() if self.take(":") else None

    def class_like(self, start: int, mods: list[Node], marks: list[str], kind: str) -> Node:
        self.need_word("class")
        if self.identifier_here() and not (self.word("implements") and self.ahead(lambda: self.s.next() or self.kind == "name")):
            self.s.next()
        parameters = self.type_parameters()
        heritage = self.heritage()
        self.need("{")
        return self.node(kind, start, mods, parameters, heritage, self.with_in(self._members), marks=marks)

    def heritage(self) -> list[Node]:
        found = []
        while self.word("extends", "implements"):
            start, token = self.s.start, keyword_kind(self.value)
            self.s.next()
            types = [self.heritage_type()]
            while self.take(","):
                types.append(self.heritage_type())
            found.append(self.node("HeritageClause", start, types, marks=[f"heritage:{token}"]))
        return found

    def heritage_type(self) -> Node:
        start = self.s.start
        expression = self.left_hand_side()
        if expression is not None and expression.kind == "ExpressionWithTypeArguments":
            return expression
        arguments = self.type_arguments() if self.at("<", "<<") else []
        return self.node("ExpressionWithTypeArguments", start, expression, arguments)

    def _members(self) -> list:
        found = []
        while not self.at("}"):
            found.append(self.member())
        self.need("}")
        return found

    def member(self) -> Node:
        start = self.s.start
        if self.take(";"):
            return self.node("SemicolonClassElement", start)
        mods, marks = self.decorators_and_modifiers(members=True)
        if self.word("static") and self.ahead(lambda: self.s.next() or self.at("{")):
            self.s.next()
            return self.node("ClassStaticBlockDeclaration", start, mods, self.block(), marks=marks)
        if self.word("get", "set") and self.ahead(self._accessor_follows):
            kind = "GetAccessor" if self.value == "get" else "SetAccessor"
            self.s.next()
            name = self.property_name()
            return self.node(kind, start, mods, name, *self.signature(), self.body(True), marks=marks)
        if (self.word("constructor") or self.kind == "string" and self.value[1:-1] == "constructor") and self.ahead(lambda: self.s.next() or self.at("(", "<")):
            self.s.next()
            return self.node("Constructor", start, mods, *self.signature(), self.body(True), marks=marks)
        if self.at("[") and self.ahead(self._index_signature_follows):
            return self.index_signature(start, mods, marks)
        star = self.optional("*")
        name = self.property_name()
        question = self.optional("?")
        definite = self.token_node() if question is None and self.at("!") and not self.s.fresh else None
        marks = [*marks, *(["optional"] if question else []), *(["definite"] if definite else [])]
        if star or self.at("(", "<"):
            return self.node("MethodDeclaration", start, mods, star, name, question, definite, *self.signature(), self.body(True), marks=marks)
        annotation = self.annotation()
        initializer = self.assignment() if self.take("=") else None
        self.semicolon()
        return self.node("PropertyDeclaration", start, mods, name, question, definite, annotation, initializer, marks=marks)

    def _accessor_follows(self) -> bool:
        self.s.next()
        return (self.kind in ("name", "private", "string", "number") or self.at("[")) and not self.at("(")

    def _index_signature_follows(self) -> bool:
        self.need("[")
        while self.word("public", "private", "protected", "readonly", "static"):
            self.s.next()
        if not self.kind == "name":
            return False
        self.s.next()
        return self.at(":", ",") or self.at("?")

    def index_signature(self, start: int, mods: list[Node], marks: list[str]) -> Node:
        self.need("[")
        parameters = self.listed("]", self.parameter)
        annotation = self.annotation()
        self.member_end()
        return self.node("IndexSignature", start, mods, parameters, annotation, marks=marks)

    def member_end(self) -> None:
        if not self.take(","):
            self.semicolon()

    def interface(self, start: int, mods: list[Node], marks: list[str]) -> Node:
        self.need_word("interface")
        self.identifier()
        return self.node("InterfaceDeclaration", start, mods, self.type_parameters(), self.heritage(), self.type_members(), marks=marks)

    def enum(self, start: int, mods: list[Node], marks: list[str]) -> Node:
        self.need_word("enum")
        self.identifier()
        self.need("{")
        return self.node("EnumDeclaration", start, mods, self.listed("}", self._enum_member), marks=marks)

    def _enum_member(self) -> Node:
        start = self.s.start
        name = self.property_name()
        return self.node("EnumMember", start, name, self.assignment() if self.take("=") else None)

    def module(self, start: int, mods: list[Node], marks: list[str]) -> Node:
        if self.take_word("global"):
            body = self.block("ModuleBlock")
            return self.node("ModuleDeclaration", start, mods, body, marks=marks)
        self.s.next()
        if self.kind == "string":
            self.s.next()
            body = self.block("ModuleBlock") if self.at("{") else self.semicolon()
            return self.node("ModuleDeclaration", start, mods, body, marks=marks)
        return self._dotted_module(start, mods, marks)

    def _dotted_module(self, start: int, mods: list[Node], marks: list[str]) -> Node:
        self.any_name()
        if self.take("."):
            body = self._dotted_module(self.s.start, [], [])
        else:
            body = self.block("ModuleBlock")
        return self.node("ModuleDeclaration", start, mods, body, marks=marks)

    # Imports and exports

    def import_form(self, start: int, mods: list[Node], marks: list[str]) -> Node:
        self.need_word("import")
        if self.kind == "string":
            self.s.next()
            attributes = self.import_attributes()
            self.semicolon()
            return self.node("ImportDeclaration", start, mods, attributes, marks=marks)
        clause_start = self.s.start
        if self.word("type") and self.ahead(self._type_only_follows):
            self.s.next()
        elif self.word("defer") and self.ahead(lambda: self.s.next() or self.at("*")):
            self.s.next()
        bindings = None
        if self.kind == "name":
            self.any_name()
            if self.take("="):
                return self.import_equals(start, mods, marks)
            if self.take(","):
                bindings = self.named_bindings()
        else:
            bindings = self.named_bindings()
        clause = self.node("ImportClause", clause_start, bindings)
        self.need_word("from")
        self.module_name()
        attributes = self.import_attributes()
        self.semicolon()
        return self.node("ImportDeclaration", start, mods, clause, attributes, marks=marks)

    def _type_only_follows(self) -> bool:
        self.s.next()
        if self.at("{", "*"):
            return True
        if self.kind != "name":
            return False
        if self.value != "from":
            return True
        self.s.next()
        return self.word("from") or self.at("=", ",")

    def module_name(self) -> None:
        if self.kind != "string":
            self.fail("String literal expected.")
        self.s.next()

    def import_equals(self, start: int, mods: list[Node], marks: list[str]) -> Node:
        if self.word("require") and self.ahead(lambda: self.s.next() or self.at("(")):
            at = self.s.start
            self.s.next()
            self.need("(")
            self.module_name()
            self.need(")")
            reference = self.node("ExternalModuleReference", at)
        else:
            reference = self.entity_name()
        self.semicolon()
        return self.node("ImportEqualsDeclaration", start, mods, reference, marks=marks)

    def named_bindings(self) -> Node:
        start = self.s.start
        if self.take("*"):
            self.need_word("as")
            self.any_name()
            return self.node("NamespaceImport", start)
        self.need("{")
        return self.node("NamedImports", start, self.listed("}", lambda: self.specifier("ImportSpecifier")))

    def specifier(self, kind: str) -> Node:
        start = self.s.start

        def name():
            if self.kind not in ("name", "string"):
                self.fail("Identifier expected.")
            self.s.next()

        name()
        # At most: type a as b. Words may be names themselves.
        while self.kind in ("name", "string"):
            name()
        return self.node(kind, start)

    def import_attributes(self) -> Node | None:
        if not (self.word("with") or self.word("assert") and not self.s.fresh):
            return None
        start = self.s.start
        self.s.next()
        self.need("{")
        return self.node("ImportAttributes", start, self.listed("}", self._import_attribute))

    def _import_attribute(self) -> Node:
        start = self.s.start
        if self.kind not in ("name", "string"):
            self.fail()
        self.s.next()
        self.need(":")
        return self.node("ImportAttribute", start, self.assignment())

    def export_form(self, start: int) -> Node | None:
        """Exports other than those of declarations; None if a declaration follows."""
        state = self.s.state()
        self.need_word("export")
        if self.take("="):
            expression = self.assignment()
            self.semicolon()
            return self.node("ExportAssignment", start, expression)
        if self.word("as") and self.ahead(lambda: self.s.next() or self.word("namespace")):
            self.s.next()
            self.s.next()
            self.identifier()
            self.semicolon()
            return self.node("NamespaceExportDeclaration", start)
        if self.word("type") and self.ahead(lambda: self.s.next() or self.at("{", "*")):
            self.s.next()
        if self.at("*"):
            at = self.s.start
            self.s.next()
            clause = None
            if self.take_word("as"):
                if self.kind not in ("name", "string"):
                    self.fail()
                self.s.next()
                clause = self.node("NamespaceExport", at)
            self.need_word("from")
            self.module_name()
            attributes = self.import_attributes()
            self.semicolon()
            return self.node("ExportDeclaration", start, clause, attributes)
        if self.at("{"):
            at = self.s.start
            self.s.next()
            clause = self.node("NamedExports", at, self.listed("}", lambda: self.specifier("ExportSpecifier")))
            attributes = None
            if self.take_word("from"):
                self.module_name()
                attributes = self.import_attributes()
            self.semicolon()
            return self.node("ExportDeclaration", start, clause, attributes)
        if self.word("default"):
            self.s.next()
            declares = self.word("function", "class", "interface", "abstract") or self.at("@") or self.word("async") and self.ahead(lambda: self.s.next() or self.word("function") and not self.s.fresh)
            if self.word("abstract", "interface") and not self.ahead(lambda: self.s.next() or self.kind == "name" and not self.s.fresh):
                declares = False
            if not declares:
                expression = self.assignment()
                self.semicolon()
                return self.node("ExportAssignment", start, expression)
        self.s.restore(state)
        return None

    # Statements by their first word

    def if_statement(self, start: int) -> Node:
        self.s.next()
        condition = self.parenthesised()
        then = self.statement()
        return self.node("IfStatement", start, condition, then, self.statement() if self.take_word("else") else None)

    def parenthesised(self) -> Node | None:
        self.need("(")
        found = self.with_in(self.expression)
        self.need(")")
        return found

    def do_statement(self, start: int) -> Node:
        self.s.next()
        inner = self.statement()
        self.need_word("while")
        condition = self.parenthesised()
        self.take(";")
        return self.node("DoStatement", start, inner, condition)

    def while_statement(self, start: int) -> Node:
        self.s.next()
        condition = self.parenthesised()
        return self.node("WhileStatement", start, condition, self.statement())

    def for_statement(self, start: int) -> Node:
        self.s.next()
        waits = self.token_node() if self.word("await") else None
        self.need("(")
        first = None
        if not self.at(";"):
            declares = self.word("var", "const") or self.word("let", "using", "await") and self.ahead(self._declaration_follows)
            first = self.with_in(self.variable_list if declares else self.expression, no_in=True)
        if self.take_word("of"):
            over = self.with_in(self.assignment)
            self.need(")")
            return self.node("ForOfStatement", start, waits, first, over, self.statement())
        if self.take_word("in"):
            over = self.with_in(self.expression)
            self.need(")")
            return self.node("ForInStatement", start, first, over, self.statement())
        self.need(";")
        condition = None if self.at(";") else self.with_in(self.expression)
        self.need(";")
        step = None if self.at(")") else self.with_in(self.expression)
        self.need(")")
        return self.node("ForStatement", start, first, condition, step, self.statement())

    def jump_statement(self, start: int) -> Node:
        kind = "BreakStatement" if self.value == "break" else "ContinueStatement"
        self.s.next()
        if self.identifier_here() and not self.s.fresh:
            self.s.next()
        self.semicolon()
        return self.node(kind, start)

    def return_statement(self, start: int) -> Node:
        self.s.next()
        value = None if self.at(";", "}", "end") or self.s.fresh else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", start, value)

    def throw_statement(self, start: int) -> Node:
        self.s.next()
        if self.s.fresh:
            self.fail("Line break not permitted here.")
        value = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", start, value)

    def with_statement(self, start: int) -> Node:
        self.s.next()
        scope = self.parenthesised()
        return self.node("WithStatement", start, scope, self.statement())

    def switch_statement(self, start: int) -> Node:
        self.s.next()
        subject = self.parenthesised()
        at = self.s.start
        self.need("{")
        clauses = []
        while not self.at("}"):
            begin = self.s.start
            if self.take_word("case"):
                test = self.with_in(self.expression)
                self.need(":")
                clauses.append(self.node("CaseClause", begin, test, self._clause()))
            else:
                self.need_word("default")
                self.need(":")
                clauses.append(self.node("DefaultClause", begin, self._clause()))
        self.need("}")
        return self.node("SwitchStatement", start, subject, self.node("CaseBlock", at, clauses))

    def _clause(self) -> list:
        found = []
        while not (self.at("}", "end") or self.word("case", "default")):
            found.append(self.statement())
        return found

    def try_statement(self, start: int) -> Node:
        self.s.next()
        tried = self.block()
        caught = final = None
        at = self.s.start
        if self.take_word("catch"):
            variable = None
            if self.take("("):
                variable = self.variable()
                self.need(")")
            caught = self.node("CatchClause", at, variable, self.block())
        if self.take_word("finally"):
            final = self.block()
        if caught is None and final is None:
            self.fail("'catch' or 'finally' expected.")
        return self.node("TryStatement", start, tried, caught, final)

    def debugger_statement(self, start: int) -> Node:
        self.s.next()
        self.semicolon()
        return self.node("DebuggerStatement", start)

    def import_statement(self, start: int) -> Node:
        if self.ahead(lambda: self.s.next() or self.at("(", ".", "<")):
            expression = self.expression()
            self.semicolon()
            return self.node("ExpressionStatement", start, expression)
        return self.import_form(start, [], [])

    # Expressions

    def expression(self) -> Node | None:
        start = self.s.start
        left = self.assignment()
        while self.at(","):
            operator = self.token_node()
            left = self.node("BinaryExpression", start, left, operator, self.assignment(), marks=["operator:CommaToken"])
        return left

    def assignment(self) -> Node | None:
        start = self.s.start
        # In a ? (b) : c => d the middle isn't an arrow function, in a ? (b): c => d : e it is.
        self.arrow_before_colon, self.colon_must_follow = self.colon_must_follow, False
        if self.word("yield") and self.ahead(self._yield_follows):
            return self.yield_expression()
        if (arrow := self.arrow_function()) is not None:
            return arrow
        left = self.binary(0)
        if self.kind == ">":
            state = self.s.state()
            if self.s.greater() not in (">>=", ">>>="):
                self.s.restore(state)
        if self.kind in ASSIGNMENTS:
            kind = PUNCTUATION[self.kind]
            operator = self.token_node()
            return self.node("BinaryExpression", start, left, operator, self.assignment(), marks=[f"operator:{kind}"])
        if self.at("?"):
            question = self.token_node()
            self.colon_must_follow = True
            yes = self.with_in(self.assignment)
            if not self.at(":"):
                self.fail("':' expected.")
            colon = self.token_node()
            return self.node("ConditionalExpression", start, left, question, yes, colon, self.assignment(), marks=["optional"])
        return left

    def _yield_follows(self) -> bool:
        self.s.next()
        return self.s.fresh or not (self.at("=", ".", ":", "=>", "?.", "in") or self.kind in ASSIGNMENTS) or self.at(")", "]", ",", ";", "}")

    def yield_expression(self) -> Node:
        start = self.s.start
        self.s.next()
        star = value = None
        if not self.s.fresh:
            star = self.optional("*")
            if star or not self.at(")", "]", "}", ",", ";", ":", "end"):
                value = self.assignment()
        return self.node("YieldExpression", start, star, value)

    def arrow_function(self) -> Node | None:
        """An arrow function, if one begins here."""
        if self.kind == "name" and self.value not in RESERVED:
            if self.value == "async":
                found = self.attempt("arrow", self._arrow) if self.ahead(lambda: self.s.next() or not self.s.fresh and (self.identifier_here() or self.at("(", "<"))) else False
                if found:
                    return found
            if self.ahead(lambda: self.s.next() or self.at("=>") and not self.s.fresh):
                return self._arrow()
            return None
        if self.at("(") or self.at("<") and (not self.jsx or self.ahead(self._generic_arrow_in_jsx)):
            return self.attempt("arrow", self._arrow) or None
        return None

    def _generic_arrow_in_jsx(self) -> bool:
        self.s.next()
        self.take_word("const")
        self.identifier()
        return self.at(",") or self.at("=") or self.word("extends") and self.ahead(lambda: self.s.next() or not self.at("=", ">", "/"))

    def _arrow(self) -> Node:
        start, before_colon = self.s.start, self.arrow_before_colon
        mods, marks = [], []
        if self.word("async") and self.ahead(lambda: self.s.next() or not self.s.fresh and (self.identifier_here() or self.at("(", "<"))):
            mods, marks = [self.token_node()], ["modifier:AsyncKeyword"]
        if self.kind == "name":
            at = self.s.start
            self.identifier()
            head = ([], [self.node("Parameter", at)], None)
        else:
            head = self.signature()
        if not self.at("=>") or self.s.fresh:
            self.fail("'=>' expected.")
        arrow = self.token_node()
        body = self.block() if self.at("{") else self.assignment()
        if before_colon and head[2] is not None and not self.at(":"):
            self.fail("':' expected.")
        return self.node("ArrowFunction", start, mods, *head, arrow, body, marks=marks)

    def binary(self, least: int) -> Node | None:
        start = self.s.start
        left = self.unary()
        while True:
            operator = self.kind if self.kind != "name" else self.value
            if self.kind == "name" and operator not in ("in", "instanceof", "as", "satisfies"):
                return left
            state = None
            if operator == ">":
                state = self.s.state()
                operator = self.s.greater()
            strength = STRENGTH.get(operator, 0)
            if strength <= least or operator == "in" and self.no_in or operator in ("as", "satisfies") and self.s.fresh:
                if state:
                    self.s.restore(state)
                return left
            if operator in ("as", "satisfies"):
                self.s.next()
                left = self.node("AsExpression" if operator == "as" else "SatisfiesExpression", start, left, self.const_or_type())
                continue
            kind = mark_kind(operator)
            token = self.token_node()
            right = self.binary(strength - 1 if operator == "**" else strength)
            left = self.node("BinaryExpression", start, left, token, right, marks=[f"operator:{kind}"])

    def const_or_type(self) -> Node:
        if self.word("const"):
            at = self.s.start
            self.s.next()
            return self.node("TypeReference", at)
        return self.type()

    def unary(self) -> Node | None:
        start = self.s.start
        if self.at("++", "--", "+", "-", "~", "!"):
            kind = PUNCTUATION[self.kind]
            self.s.next()
            return self.node("PrefixUnaryExpression", start, self.unary(), marks=[f"operator:{kind}"])
        if self.kind == "name":
            kinds = {"delete": "DeleteExpression", "typeof": "TypeOfExpression", "void": "VoidExpression"}
            if self.value in kinds:
                kind = kinds[self.value]
                self.s.next()
                return self.node(kind, start, self.unary())
            if self.value == "await" and self.ahead(self._await_follows):
                self.s.next()
                return self.node("AwaitExpression", start, self.unary())
        if self.at("<") and not self.jsx:
            self.s.next()
            asserted = self.const_or_type()
            self.close(">")
            return self.node("TypeAssertionExpression", start, asserted, self.unary())
        operand = self.left_hand_side()
        if self.at("++", "--") and not self.s.fresh:
            kind = PUNCTUATION[self.kind]
            self.s.next()
            return self.node("PostfixUnaryExpression", start, operand, marks=[f"operator:{kind}"])
        return operand

    def _await_follows(self) -> bool:
        self.s.next()
        if self.s.fresh and not self.at("("):
            return self.kind in ("name", "string", "number", "template") and self.value not in ("in", "of", "instanceof")
        return self.kind in ("string", "number", "template", "private") or self.at("(", "[", "{", "/", "+", "-", "~", "!", "++", "--", "<") or self.kind == "name" and self.value not in ("in", "of", "instanceof", "as", "satisfies")

    def left_hand_side(self) -> Node | None:
        """A member or call chain."""
        start = self.s.start
        if self.word("new"):
            left = self.new_expression()
        else:
            left = self.primary()
        return self.chain(start, left, calls=True)

    def chain(self, start: int, left: Node | None, calls: bool) -> Node | None:
        while True:
            if self.at("."):
                self.s.next()
                if self.kind not in ("name", "private"):
                    self.fail("Identifier expected.")
                self.s.next()
                left = self.node("PropertyAccessExpression", start, left)
            elif self.at("?.") and calls:
                dot = self.token_node()
                if self.at("("):
                    left = self.node("CallExpression", start, left, dot, self.arguments())
                elif self.at("["):
                    left = self.node("ElementAccessExpression", start, left, dot, self._element())
                elif self.at("<", "<<"):
                    types = self.type_arguments()
                    left = self.node("CallExpression", start, left, dot, types, self.arguments())
                else:
                    if self.kind not in ("name", "private"):
                        self.fail("Identifier expected.")
                    self.s.next()
                    left = self.node("PropertyAccessExpression", start, left, dot)
            elif self.at("["):
                left = self.node("ElementAccessExpression", start, left, self._element())
            elif self.at("!") and not self.s.fresh:
                self.s.next()
                left = self.node("NonNullExpression", start, left)
            elif self.kind == "template":
                left = self.node("TaggedTemplateExpression", start, left, self.template())
            elif self.at("(") and calls:
                left = self.node("CallExpression", start, left, self.arguments())
            elif self.at("<", "<<"):
                types = self.attempt("arguments", self._expression_type_arguments)
                if types is False:
                    return left
                if self.at("(") and calls:
                    left = self.node("CallExpression", start, left, types, self.arguments())
                elif self.kind == "template":
                    left = self.node("TaggedTemplateExpression", start, left, types, self.template())
                else:
                    left = self.node("ExpressionWithTypeArguments", start, left, types)
                    if not calls:
                        return left
            else:
                return left

    def _element(self) -> Node | None:
        self.need("[")
        found = self.with_in(self.expression)
        self.need("]")
        return found

    def _expression_type_arguments(self) -> list:
        types = self.type_arguments()
        if self.at("(") or self.kind == "template":
            return types
        # No argument list: only if no operand can follow, else "<" and ">" compare.
        if self.at("<", ">", "+", "-") or not self.s.fresh and (self.kind in ("name", "string", "number", "private") and self.value not in ("in", "of", "instanceof", "as", "satisfies", "implements", "extends") or self.at("[", "{", "!", "~", "++", "--", "/", "@")):
            self.fail()
        return types

    def arguments(self) -> list:
        self.need("(")
        return self.with_in(lambda: self.listed(")", self._argument))

    def _argument(self) -> Node | None:
        start = self.s.start
        if self.take("..."):
            return self.node("SpreadElement", start, self.assignment())
        return self.assignment()

    def new_expression(self) -> Node:
        start = self.s.start
        self.s.next()
        if self.take("."):
            self.any_name()
            return self.node("MetaProperty", start)
        at = self.s.start
        target = self.new_expression() if self.word("new") else self.primary()
        target = self.chain(at, target, calls=False)
        if self.at("?."):
            self.fail("Optional chaining cannot appear in the callee of new.")
        # new C<T>(): the type arguments belong to the new expression.
        generic = target is not None and target.kind == "ExpressionWithTypeArguments"
        return self.node("NewExpression", start, target.kids if generic else target, self.arguments() if self.at("(") else [])

    def template(self) -> Node | None:
        """None for a template without substitutions."""
        start = self.s.start
        if not self.s.template_part():
            self.s.next()
            return None
        head = Node("TemplateHead", start, self.s.end, [], [])
        spans = self._template_spans("TemplateSpan", lambda: self.with_in(self.expression))
        return self.node("TemplateExpression", start, head, spans)

    def _template_spans(self, kind: str, inner: Callable[[], Node | None]) -> list:
        spans, more = [], True
        while more:
            self.s.next()
            at = self.s.start
            content = inner()
            if not self.at("}"):
                self.fail("'}' expected.")
            begin = self.s.start
            more = self.s.template_part()
            literal = Node("TemplateMiddle" if more else "TemplateTail", begin, self.s.end, [], [])
            spans.append(Node(kind, at, self.s.end, [n for n in (content, literal) if n is not None], []))
        self.s.next()
        return spans

    def primary(self) -> Node | None:
        start, kind = self.s.start, self.kind
        if kind == "name":
            return self._word_expression(start)
        if kind in ("number", "string"):
            self.s.next()
            return None
        if kind == "template":
            return self.template()
        if kind == "private":
            self.s.next()
            if not self.word("in"):
                self.fail("Expression expected.")
            return None
        if kind == "(":
            self.s.next()
            inner = self.with_in(self.expression)
            self.need(")")
            return self.node("ParenthesizedExpression", start, inner)
        if kind == "[":
            self.s.next()
            return self.node("ArrayLiteralExpression", start, self.with_in(lambda: self.listed("]", self._array_item)))
        if kind == "{":
            self.s.next()
            return self.node("ObjectLiteralExpression", start, self.with_in(lambda: self.listed("}", self._object_item)))
        if kind in ("/", "/="):
            self.s.regex()
            self.s.next()
            return None
        if kind == "<" and self.jsx:
            return self.jsx_element(child=False)
        if kind == "@":
            mods, marks = self.decorators_and_modifiers()
            return self.class_like(start, mods, marks, "ClassExpression")
        return self.fail("Expression expected.")

    def _word_expression(self, start: int) -> Node | None:
        word = self.value
        if word == "function":
            return self.function(start, [], [], "FunctionExpression")
        if word == "class":
            return self.class_like(start, [], [], "ClassExpression")
        if word == "async" and self.ahead(lambda: self.s.next() or self.word("function") and not self.s.fresh):
            return self.function(start, [self.token_node()], ["modifier:AsyncKeyword"], "FunctionExpression")
        if word in ("this", "super"):
            return self.token_node()
        if word == "new":
            return self.new_expression()
        if word == "import":
            self.s.next()
            if self.take("."):
                self.any_name()
                return self.node("MetaProperty", start)
            if not self.at("(", "<"):
                self.fail()
            return self.node("ImportKeyword", start)
        if word in ("true", "false", "null") or word not in RESERVED:
            self.s.next()
            return None
        return self.fail("Expression expected.")

    def _array_item(self) -> Node | None:
        if self.at(","):
            return Node("OmittedExpression", self.s.start, self.s.start, [], [])
        return self._argument()

    def _object_item(self) -> Node:
        start = self.s.start
        if self.take("..."):
            return self.node("SpreadAssignment", start, self.assignment())
        mods, marks = [], []
        if self.word("async") and self.ahead(lambda: self.s.next() or not self.s.fresh and (self.kind in ("name", "private", "string", "number") or self.at("[", "*"))):
            mods, marks = [self.token_node()], ["modifier:AsyncKeyword"]
        if self.word("get", "set") and self.ahead(self._accessor_follows):
            kind = "GetAccessor" if self.value == "get" else "SetAccessor"
            self.s.next()
            name = self.property_name()
            return self.node(kind, start, mods, name, *self.signature(), self.block(), marks=marks)
        star = self.optional("*")
        plain = self.kind == "name" and self.value not in RESERVED
        name = self.property_name()
        if star or self.at("(", "<"):
            return self.node("MethodDeclaration", start, mods, star, name, *self.signature(), self.block(), marks=marks)
        if self.take(":"):
            return self.node("PropertyAssignment", start, name, self.with_in(self.assignment))
        if not plain:
            self.fail("':' expected.")
        if self.at("="):
            equals = self.token_node()
            return self.node("ShorthandPropertyAssignment", start, equals, self.with_in(self.assignment))
        return self.node("ShorthandPropertyAssignment", start)

    # Types

    def type_parameters(self) -> list:
        if not self.at("<"):
            return []
        self.s.next()
        found = self.listed(">", self._type_parameter)
        return found

    def _type_parameter(self) -> Node:
        start = self.s.start
        mods, marks = [], []
        while self.word("const", "in", "out") and self.ahead(lambda: self.s.next() or self.kind == "name" and not self.word("extends")):
            kind = keyword_kind(self.value)
            mods.append(self.token_node())
            marks.append(f"modifier:{kind}")
        self.identifier()
        constraint = self.type() if self.take_word("extends") else None
        return self.node("TypeParameter", start, mods, constraint, self.type() if self.take("=") else None, marks=marks)

    def type_arguments(self) -> list:
        if self.at("<<"):
            self.s.split_first()
        self.need("<")
        found = self.with_conditional(lambda: self.listed(">", self.type))
        if not found:
            self.fail("Type argument list cannot be empty.")
        return found

    def with_conditional(self, read: Callable[[], object], off: bool = False):
        before, self.no_conditional_type = self.no_conditional_type, off
        found = read()
        self.no_conditional_type = before
        return found

    def return_type(self) -> Node:
        return self.type_predicate() or self.type()

    def type_predicate(self) -> Node | None:
        start = self.s.start
        if self.word("asserts") and self.ahead(lambda: self.s.next() or self.kind == "name" and (self.value not in RESERVED or self.value == "this") and not self.s.fresh):
            asserts = self.token_node()
            subject = self._predicate_subject()
            return self.node("TypePredicate", start, asserts, subject, self.type() if self.take_word("is") else None)
        if self.kind == "name" and (self.value not in RESERVED or self.value == "this") and self.ahead(lambda: self.s.next() or self.word("is") and not self.s.fresh):
            subject = self._predicate_subject()
            self.need_word("is")
            return self.node("TypePredicate", start, subject, self.type())
        return None

    def _predicate_subject(self) -> Node | None:
        at, is_this = self.s.start, self.word("this")
        self.s.next()
        return self.node("ThisType", at) if is_this else None

    def type(self) -> Node:
        start = self.s.start
        if (found := self.function_type()) is not None:
            return found
        checked = self.union()
        if self.no_conditional_type or self.s.fresh or not self.word("extends"):
            return checked
        self.s.next()
        bound = self.with_conditional(self.type, off=True)
        self.need("?")
        yes = self.with_conditional(self.type)
        self.need(":")
        return self.node("ConditionalType", start, checked, bound, yes, self.with_conditional(self.type))

    def function_type(self) -> Node | None:
        start = self.s.start
        if self.word("new") or self.word("abstract") and self.ahead(lambda: self.s.next() or self.word("new")):
            mods, marks = ([self.token_node()], ["modifier:AbstractKeyword"]) if self.word("abstract") else ([], [])
            self.s.next()
            parameters, arguments = self.type_parameters(), self.parameters()
            return self.node("ConstructorType", start, mods, parameters, arguments, self._arrow_type(), marks=marks)
        if self.at("<") or self.at("(") and self.ahead(self._function_type_follows):
            parameters, arguments = self.type_parameters(), self.parameters()
            return self.node("FunctionType", start, parameters, arguments, self._arrow_type())
        return None

    def _arrow_type(self) -> Node:
        self.need("=>")
        return self.return_type()

    def _function_type_follows(self) -> bool:
        self.need("(")
        if self.at(")", "..."):
            return True
        while self.kind == "name" and self.value in MODIFIERS and self.ahead(lambda: self.s.next() or self.kind == "name"):
            self.s.next()
        if self.identifier_here() or self.word("this"):
            self.s.next()
        elif self.at("{", "["):
            self.binding_pattern()
        else:
            return False
        if self.at(":", ",", "?", "="):
            return True
        if self.take(")"):
            return self.at("=>")
        return False

    def union(self) -> Node:
        return self._joined("|", "UnionType", lambda: self._joined("&", "IntersectionType", self.type_operator))

    def _joined(self, mark: str, kind: str, part: Callable[[], Node]) -> Node:
        start = self.s.start
        leading = self.take(mark)
        first = (self.function_type() or part()) if leading else part()
        if not leading and not self.at(mark):
            return first
        parts = [first]
        while self.take(mark):
            parts.append(self.function_type() or part())
        return self.node(kind, start, parts)

    def type_operator(self) -> Node:
        start = self.s.start
        if self.word("keyof", "unique", "readonly") and self.ahead(self._type_follows):
            self.s.next()
            return self.node("TypeOperator", start, self.type_operator())
        if self.word("infer") and self.ahead(lambda: self.s.next() or self.identifier_here()):
            self.s.next()
            at = self.s.start
            self.identifier()
            constraint = (self.attempt(f"infer{self.no_conditional_type}", self._infer_constraint) or None) if self.word("extends") else None
            return self.node("InferType", start, self.node("TypeParameter", at, constraint))
        return self.postfix_type()

    def _type_follows(self) -> bool:
        self.s.next()
        return self.kind in ("name", "string", "number", "template") and not (self.word("extends", "is") and not self.s.fresh) or self.at("(", "[", "{", "<", "-")

    def _infer_constraint(self) -> Node:
        self.need_word("extends")
        found = self.with_conditional(self.type, off=True)
        if not self.no_conditional_type and self.at("?"):
            self.fail()
        return found

    def postfix_type(self) -> Node:
        start = self.s.start
        found = self.plain_type()
        while not self.s.fresh and self.at("["):
            self.s.next()
            if self.take("]"):
                found = self.node("ArrayType", start, found)
            else:
                index = self.with_conditional(self.type)
                self.need("]")
                found = self.node("IndexedAccessType", start, found, index)
        return found

    def plain_type(self) -> Node:
        start, kind = self.s.start, self.kind
        if kind in ("string", "number"):
            self.s.next()
            return self.node("LiteralType", start)
        if kind == "-":
            self.s.next()
            if self.kind != "number":
                self.fail("Number expected.")
            self.s.next()
            return self.node("LiteralType", start, self.node("PrefixUnaryExpression", start, marks=["operator:MinusToken"]))
        if kind == "template":
            if not self.s.template_part():
                self.s.next()
                return self.node("LiteralType", start)
            head = Node("TemplateHead", start, self.s.end, [], [])
            return self.node("TemplateLiteralType", start, head, self._template_spans("TemplateLiteralTypeSpan", lambda: self.with_conditional(self.type)))
        if kind == "(":
            self.s.next()
            inner = self.with_conditional(self.type)
            self.need(")")
            return self.node("ParenthesizedType", start, inner)
        if kind == "[":
            self.s.next()
            return self.node("TupleType", start, self.with_conditional(lambda: self.listed("]", self._tuple_item)))
        if kind == "{":
            if self.ahead(self._mapped_follows):
                return self.with_conditional(self.mapped_type)
            return self.node("TypeLiteral", start, self.with_conditional(self.type_members))
        if kind != "name":
            return self.fail("Type expected.")
        word = self.value
        if word in TYPE_KEYWORDS and self.ahead(lambda: self.s.next() or not self.at(".")):
            if word != "intrinsic":
                return self.token_node()
        if word == "void":
            return self.token_node()
        if word in ("null", "true", "false"):
            self.s.next()
            return self.node("LiteralType", start)
        if word == "this":
            self.s.next()
            return self.node("ThisType", start)
        if word == "typeof":
            self.s.next()
            if self.word("import"):
                return self.import_type(start)
            name = self.entity_name()
            return self.node("TypeQuery", start, name, self.type_arguments() if self.at("<", "<<") and not self.s.fresh else [])
        if word == "import":
            return self.import_type(start)
        if word == "asserts" and (found := self.type_predicate()):
            return found
        if word in RESERVED:
            return self.fail("Type expected.")
        name = self.entity_name()
        return self.node("TypeReference", start, name, self.type_arguments() if self.at("<", "<<") and not self.s.fresh else [])

    def entity_name(self) -> Node | None:
        """A dotted name; plain ones have no node."""
        start = self.s.start
        if not (self.identifier_here() or self.word("this")):
            self.fail("Identifier expected.")
        found = self.token_node() if self.word("this") else self.s.next()
        while self.at("."):
            self.s.next()
            if self.kind not in ("name", "private"):
                self.fail("Identifier expected.")
            self.s.next()
            found = self.node("QualifiedName", start, found)
        return found

    def import_type(self, start: int) -> Node:
        self.need_word("import")
        self.need("(")
        argument = self.type()
        attributes = None
        if self.take(",") and self.at("{"):
            at = self.s.start
            self.s.next()
            self.any_name()
            self.need(":")
            self.need("{")
            attributes = self.node("ImportAttributes", at, self.listed("}", self._import_attribute))
            self.take(",")
            self.need("}")
        self.need(")")
        qualifier = self.entity_name() if self.take(".") else None
        return self.node("ImportType", start, argument, attributes, qualifier, self.type_arguments() if self.at("<", "<<") and not self.s.fresh else [])

    def _tuple_item(self) -> Node:
        start = self.s.start
        if self.ahead(self._named_item):
            dots = self.optional("...")
            self.s.next()
            question = self.optional("?")
            self.need(":")
            return self.node("NamedTupleMember", start, dots, question, self.type(), marks=["optional"] if question else [])
        if self.take("..."):
            return self.node("RestType", start, self.type())
        found = self.type()
        if self.take("?"):
            return self.node("OptionalType", start, found)
        return found

    def _named_item(self) -> bool:
        self.take("...")
        self.any_name()
        self.take("?")
        return self.at(":")

    def _mapped_follows(self) -> bool:
        self.need("{")
        if self.at("+", "-"):
            self.s.next()
            return self.word("readonly")
        self.take_word("readonly")
        self.need("[")
        self.any_name()
        return self.word("in")

    def mapped_type(self) -> Node:
        start = self.s.start
        self.need("{")
        readonly = None
        if self.at("+", "-"):
            readonly = self.token_node()
            self.need_word("readonly")
        elif self.word("readonly"):
            readonly = self.token_node()
        self.need("[")
        at = self.s.start
        self.any_name()
        self.need_word("in")
        parameter = self.node("TypeParameter", at, self.type())
        renamed = self.type() if self.take_word("as") else None
        self.need("]")
        question = None
        if self.at("+", "-"):
            question = self.token_node()
            self.need("?")
        elif self.at("?"):
            question = self.token_node()
        annotation = self.annotation()
        self.take(";") or self.take(",")
        self.need("}")
        return self.node("MappedType", start, readonly, parameter, renamed, question, annotation, marks=["optional"] if question else [])

    def type_members(self) -> list:
        self.need("{")
        found = []
        while not self.at("}"):
            found.append(self._type_member())
        self.need("}")
        return found

    def _type_member(self) -> Node:
        start = self.s.start
        if self.at("(", "<"):
            head = self.signature()
            self.member_end()
            return self.node("CallSignature", start, *head)
        if self.word("new") and self.ahead(lambda: self.s.next() or self.at("(", "<")):
            self.s.next()
            head = self.signature()
            self.member_end()
            return self.node("ConstructSignature", start, *head)
        mods, marks = self.decorators_and_modifiers(members=True)
        if self.at("[") and self.ahead(self._index_signature_follows):
            return self.index_signature(start, mods, marks)
        if self.word("get", "set") and self.ahead(self._accessor_follows):
            kind = "GetAccessor" if self.value == "get" else "SetAccessor"
            self.s.next()
            name = self.property_name()
            head = self.signature()
            self.member_end()
            return self.node(kind, start, mods, name, *head, marks=marks)
        name = self.property_name()
        question = self.optional("?")
        marks = [*marks, *(["optional"] if question else [])]
        if self.at("(", "<"):
            head = self.signature()
            self.member_end()
            return self.node("MethodSignature", start, mods, name, question, *head, marks=marks)
        annotation = self.annotation()
        initializer = self.assignment() if self.take("=") else None
        self.member_end()
        return self.node("PropertySignature", start, mods, name, question, annotation, initializer, marks=marks)

    # JSX

    def jsx_element(self, child: bool) -> Node:
        """An element or fragment; child: more children follow, so the last ">" isn't scanned past."""
        start = self.s.start
        self.need("<")
        if self.at(">"):
            opening = Node("JsxOpeningFragment", start, self.s.end, [], [])
            kids, closing_start = self._jsx_children()
            if not self.at(">"):
                self.fail("JSX fragment has no corresponding closing tag.")
            closing = Node("JsxClosingFragment", closing_start, self.s.end, [], [])
            return self._jsx_end("JsxFragment", start, [opening, *kids, closing], child)
        name_at = self.s.start
        tag = self._jsx_tag()
        name = self.text[name_at : self.s.before]
        types = self.type_arguments() if self.at("<") else []
        at = self.s.start
        attributes = []
        while not self.at(">", "/"):
            attributes.append(self._jsx_attribute())
        listed = Node("JsxAttributes", at, self.s.before if attributes else at, attributes, [])
        parts = [n for n in (tag, *types, listed) if n is not None]
        if self.take("/"):
            if not self.at(">"):
                self.fail("'>' expected.")
            return self._jsx_end("JsxSelfClosingElement", start, parts, child)
        opening = Node("JsxOpeningElement", start, self.s.end, parts, [])
        kids, closing_start = self._jsx_children()
        name_at = self.s.start
        closing_tag = self._jsx_tag()
        if self.text[name_at : self.s.before] != name:
            self.fail(f"Expected corresponding JSX closing tag for '{name}'.")
        if not self.at(">"):
            self.fail("'>' expected.")
        closing = Node("JsxClosingElement", closing_start, self.s.end, [closing_tag] if closing_tag else [], [])
        return self._jsx_end("JsxElement", start, [opening, *kids, closing], child)

    def _jsx_end(self, kind: str, start: int, kids: list[Node], child: bool) -> Node:
        found = Node(kind, start, self.s.end, kids, [])
        if not child:
            self.s.next()
        return found

    def _jsx_children(self) -> tuple[list[Node], int]:
        """Children after the current ">", up to and with the "</" of the closing tag; where that begins."""
        kids = []
        while True:
            self.s.jsx_child()
            start = self.s.start
            if self.kind == "jsxtext":
                kids.append(Node("JsxText", start, self.s.end, [], []))
            elif self.at("{"):
                self.s.next()
                dots = self.optional("...")
                inner = None if self.at("}") else self.with_in(self.expression)
                if not self.at("}"):
                    self.fail("'}' expected.")
                kids.append(Node("JsxExpression", start, self.s.end, [n for n in (dots, inner) if n is not None], []))
            elif self.ahead(lambda: self.s.next() or self.at("/")):
                self.s.next()
                self.s.next()
                return kids, start
            else:
                kids.append(self.jsx_element(child=True))

    def _jsx_tag(self) -> Node | None:
        start = self.s.start
        if self.kind != "name":
            self.fail("Identifier expected.")
        if self.word("this"):
            found = self.token_node()
        else:
            self.s.jsx_name()
            self.s.next()
            found = None
        if self.take(":"):
            self.s.jsx_name()
            self.s.next()
            return self.node("JsxNamespacedName", start)
        while self.take("."):
            self.any_name()
            found = self.node("PropertyAccessExpression", start, found)
        return found

    def _jsx_attribute(self) -> Node:
        start = self.s.start
        if self.take("{"):
            self.need("...")
            spread = self.assignment()
            self.need("}")
            return self.node("JsxSpreadAttribute", start, spread)
        if self.kind != "name":
            self.fail("Identifier expected.")
        self.s.jsx_name()
        self.s.next()
        name = None
        if self.take(":"):
            self.s.jsx_name()
            self.s.next()
            name = self.node("JsxNamespacedName", start)
        value = None
        if self.at("="):
            self.s.jsx_attribute_value()
            at = self.s.start
            if self.kind == "string":
                self.s.next()
            elif self.at("{"):
                self.s.next()
                dots = self.optional("...")
                inner = None if self.at("}") else self.with_in(self.expression)
                self.need("}")
                value = self.node("JsxExpression", at, dots, inner)
            else:
                value = self.jsx_element(child=False)
        return self.node("JsxAttribute", start, name, value)


_DECLARATORS = frozenset(
    """export import var let const function class enum interface type namespace module global declare abstract async using await
    accessor private protected public readonly static override""".split()
)
_STATEMENTS: dict[str, Callable[[Parser, int], Node]] = {
    "if": Parser.if_statement,
    "do": Parser.do_statement,
    "while": Parser.while_statement,
    "for": Parser.for_statement,
    "break": Parser.jump_statement,
    "continue": Parser.jump_statement,
    "return": Parser.return_statement,
    "throw": Parser.throw_statement,
    "with": Parser.with_statement,
    "switch": Parser.switch_statement,
    "try": Parser.try_statement,
    "debugger": Parser.debugger_statement,
    "import": Parser.import_statement,
    "var": lambda p, start: p.variables(start, [], []),
    "const": lambda p, start: p.declaration(start) if p.ahead(lambda: p.s.next() or p.word("enum")) else p.variables(start, [], []),
    "function": lambda p, start: p.function(start, [], [], "FunctionDeclaration"),
    "class": lambda p, start: p.class_like(start, [], [], "ClassDeclaration"),
    "enum": lambda p, start: p.enum(start, [], []),
    "export": lambda p, start: p.declaration(start),
}


def parse(text: str, jsx: bool) -> Node:
    """The tree of a file. Deep nesting is a matter of Python frames only."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 200_000))
    try:
        return Parser(text, jsx).file()
    finally:
        sys.setrecursionlimit(limit)
