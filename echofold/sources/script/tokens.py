"""The token scanner: one token at a time, as what a character begins depends on where it stands."""

from __future__ import annotations

import re


class ParseError(ValueError):
    """A file that is not a program the parser knows; offset is where."""

    def __init__(self, message: str, offset: int):
        super().__init__(message)
        self.offset = offset


#: Reserved words of the language: never identifiers.
RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if
    import in instanceof new null return super switch this throw true try typeof var void while with""".split()
)

#: Names of punctuation, longest first within a first character.
PUNCTUATION = {
    "{": "OpenBrace", "}": "CloseBrace", "(": "OpenParen", ")": "CloseParen", "[": "OpenBracket", "]": "CloseBracket",
    "...": "DotDotDotToken", ".": "DotToken", ";": "SemicolonToken", ",": "CommaToken", "?.": "QuestionDotToken",
    "??=": "QuestionQuestionEqualsToken", "??": "QuestionQuestionToken", "?": "QuestionToken", ":": "ColonToken", "@": "AtToken",
    "=>": "EqualsGreaterThanToken", "===": "EqualsEqualsEqualsToken", "==": "EqualsEqualsToken", "=": "EqualsToken",
    "!==": "ExclamationEqualsEqualsToken", "!=": "ExclamationEqualsToken", "!": "ExclamationToken",
    "++": "PlusPlusToken", "+=": "PlusEqualsToken", "+": "PlusToken", "--": "MinusMinusToken", "-=": "MinusEqualsToken", "-": "MinusToken",
    "**=": "AsteriskAsteriskEqualsToken", "**": "AsteriskAsteriskToken", "*=": "AsteriskEqualsToken", "*": "AsteriskToken",
    "/=": "SlashEqualsToken", "/": "SlashToken", "%=": "PercentEqualsToken", "%": "PercentToken",
    "<<=": "LessThanLessThanEqualsToken", "<<": "LessThanLessThanToken", "<=": "LessThanEqualsToken", "<": "LessThanToken",
    ">>>=": "GreaterThanGreaterThanGreaterThanEqualsToken", ">>>": "GreaterThanGreaterThanGreaterThanToken",
    ">>=": "GreaterThanGreaterThanEqualsToken", ">>": "GreaterThanGreaterThanToken", ">=": "GreaterThanEqualsToken", ">": "GreaterThanToken",
    "&&=": "AmpersandAmpersandEqualsToken", "&&": "AmpersandAmpersandToken", "&=": "AmpersandEqualsToken", "&": "AmpersandToken",
    "||=": "BarBarEqualsToken", "||": "BarBarToken", "|=": "BarEqualsToken", "|": "BarToken",
    "^=": "CaretEqualsToken", "^": "CaretToken", "~": "TildeToken",
}

_NAME = r"(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_TRIVIA = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)+", re.S)
_BREAKS = re.compile(r"[\n\r\u2028\u2029]")
# A lone ">" is scanned by itself, since it may close type arguments; Scanner.greater() joins it on demand.
_MARKS = "|".join(re.escape(p) for p in sorted(PUNCTUATION, key=len, reverse=True) if not p.startswith(">") or p == ">")
_TOKEN = re.compile(
    rf"(?P<name>{_NAME})|(?P<private>\#{_NAME})"
    r"|(?P<number>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?)"
    r"|(?P<string>\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')"
    rf"|(?P<mark>\?\.(?![0-9])|{_MARKS.replace(re.escape('?.') + '|', '')})",
    re.S,
)
_GREATER = re.compile(r">>>=|>>>|>>=|>>|>=|>")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\\\]\n\r]|\\[^\n\r])*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_JSX_NAME = re.compile(rf"{_NAME}(?:-[\w$-]*)*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_TEXT = re.compile(r"[^{<}>]+")


class Scanner:
    """The current token: kind ("name", "private", "number", "string", "template", "end" or the punctuation
    itself), text, start, end, and whether a line break comes before it."""

    __slots__ = ("text", "kind", "value", "start", "end", "fresh", "before")

    def __init__(self, text: str):
        self.text = text
        self.end = self.before = 0
        if text.startswith("#!"):
            found = _BREAKS.search(text)
            self.end = found.start() if found else len(text)
        self.next()

    def state(self) -> tuple:
        return self.kind, self.value, self.start, self.end, self.fresh, self.before

    def restore(self, state: tuple) -> None:
        self.kind, self.value, self.start, self.end, self.fresh, self.before = state

    def next(self) -> None:
        self.before = at = self.end
        trivia = _TRIVIA.match(self.text, at)
        self.fresh = False
        if trivia:
            self.fresh = _BREAKS.search(self.text, at, trivia.end()) is not None
            at = trivia.end()
        self.start = at
        if at >= len(self.text):
            self.kind, self.value, self.end = "end", "", at
            return
        found = _TOKEN.match(self.text, at)
        if found is None:
            if self.text[at] == "`":
                self.kind, self.value, self.end = "template", "`", at + 1
                return
            raise ParseError(f"Invalid character {self.text[at]!r}", at)
        group = found.lastgroup
        self.value, self.end = found[0], found.end()
        self.kind = self.value if group == "mark" else group
        if group == "number" and self.end < len(self.text) and re.match(r"[^\W\d]|[$]", self.text[self.end]):
            raise ParseError("An identifier or keyword cannot immediately follow a numeric literal.", self.end)

    def greater(self) -> str:
        """The longest operator that begins with the current ">"."""
        found = _GREATER.match(self.text, self.start)
        self.kind = self.value = found[0]
        self.end = found.end()
        return self.value

    def split_first(self) -> None:
        """Leave only the first character of the current punctuation."""
        self.kind = self.value = self.value[0]
        self.end = self.start + 1

    def regex(self) -> None:
        found = _REGEX.match(self.text, self.start)
        if found is None:
            raise ParseError("Unterminated regular expression literal.", self.start)
        self.kind, self.value, self.end = "regex", found[0], found.end()

    def template_part(self) -> bool:
        """Scan on to the end of a template part, from after "`" or "}"; whether a substitution follows."""
        found = _TEMPLATE.match(self.text, self.end)
        if found is None:
            raise ParseError("Unterminated template literal.", self.start)
        self.end = found.end()
        return found[1] == "${"

    def jsx_name(self) -> None:
        """Extend the current name by what JSX allows in it."""
        found = _JSX_NAME.match(self.text, self.start)
        self.value, self.end = found[0], found.end()

    def jsx_string(self) -> None:
        """Rescan what follows "=" as a JSX string, where there is one."""
        found = _JSX_STRING.match(self.text, self.start)
        if found:
            self.kind, self.value, self.end = "string", found[0], found.end()

    def jsx_attribute_value(self) -> None:
        """As next(), but strings follow JSX rules and may hold line breaks and backslashes."""
        trivia = _TRIVIA.match(self.text, self.end)
        at = trivia.end() if trivia else self.end
        found = _JSX_STRING.match(self.text, at)
        if found:
            self.before = self.end
            self.kind, self.value, self.start, self.end, self.fresh = "string", found[0], at, found.end(), False
        else:
            self.next()

    def jsx_child(self) -> None:
        """The next token of JSX children, from the end of the current one: text, "{" or "<"."""
        self.before, self.start, self.fresh = self.end, self.end, False
        found = _JSX_TEXT.match(self.text, self.end)
        if found:
            self.kind, self.value, self.end = "jsxtext", found[0], found.end()
        elif self.end >= len(self.text):
            raise ParseError("JSX element has no corresponding closing tag.", self.start)
        elif self.text[self.end] in "{<":
            self.kind = self.value = self.text[self.end]
            self.end += 1
        else:
            raise ParseError(f"Unexpected token {self.text[self.end]!r} in JSX.", self.start)
