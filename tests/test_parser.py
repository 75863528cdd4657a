"""Parser and fingerprints on small sources; counts are derived by hand."""

import pytest

from echofold.functions.structure import post_order, subtree_hash
from echofold.sources.script import ParseError, parse
from echofold.sources.typescript import ScanError, scan_file, scan_text

CLAMP = "function clamp(level: number, top: number): boolean {\n  let rest = top - level;\n  if (rest) {\n    rest++;\n  }\n  return !rest;\n}\n"


def shape(text, jsx=False):
    return " ".join(map(repr, parse(text, jsx).kids))


def test_hand_counts():
    (whole,) = [e for e in scan_text("c.ts", CLAMP, 7, 1)]
    assert (whole[0], whole[1], whole[2], len(whole[3])) == (1, 7, 22, 20)
    assert scan_text("c.ts", CLAMP, 8, 1) == []
    (alias,) = scan_text("r.ts", "export type RouteA = Pair<string, boolean> | null;\n", 1, 1)
    assert alias[2] == 8


@pytest.mark.parametrize(
    "source, expected",
    [
        ("a + b;", "ExpressionStatement(BinaryExpression['operator:PlusToken'](PlusToken()))"),
        ("a?.b;", "ExpressionStatement(PropertyAccessExpression(QuestionDotToken()))"),
        ("-x;", "ExpressionStatement(PrefixUnaryExpression['operator:MinusToken']())"),
        ("a ? b : c;", "ExpressionStatement(ConditionalExpression['optional'](QuestionToken(), ColonToken()))"),
        ("let x: string = `a${b}c`;", "VariableStatement(VariableDeclarationList['variable:let'](VariableDeclaration(StringKeyword(), TemplateExpression(TemplateHead(), TemplateSpan(TemplateTail())))))"),
        ("a ? (b) : c => d;", "ExpressionStatement(ConditionalExpression['optional'](QuestionToken(), ParenthesizedExpression(), ColonToken(), ArrowFunction(Parameter(), EqualsGreaterThanToken())))"),
        ("f<T>(x);", "ExpressionStatement(CallExpression(TypeReference()))"),
        ("a < b > c;", "ExpressionStatement(BinaryExpression['operator:GreaterThanToken'](BinaryExpression['operator:LessThanToken'](LessThanToken()), GreaterThanToken()))"),
        ("x = y / 2 / z; r = /a[/]b/g;", "ExpressionStatement(BinaryExpression['operator:EqualsToken'](EqualsToken(), BinaryExpression['operator:SlashToken'](BinaryExpression['operator:SlashToken'](SlashToken()), SlashToken()))) ExpressionStatement(BinaryExpression['operator:EqualsToken'](EqualsToken()))"),
        ("a\n++b", "ExpressionStatement() ExpressionStatement(PrefixUnaryExpression['operator:PlusPlusToken']())"),
        ("a ** b ** c;", "ExpressionStatement(BinaryExpression['operator:AsteriskAsteriskToken'](AsteriskAsteriskToken(), BinaryExpression['operator:AsteriskAsteriskToken'](AsteriskAsteriskToken())))"),
        ("type A = B[]['c'] | null;", "TypeAliasDeclaration(UnionType(IndexedAccessType(ArrayType(TypeReference()), LiteralType()), LiteralType()))"),
        ("type F = (a?: string) => a is string;", "TypeAliasDeclaration(FunctionType(Parameter['optional'](QuestionToken(), StringKeyword()), TypePredicate(StringKeyword())))"),
        ("type M = { readonly [K in keyof T]?: T[K] };", "TypeAliasDeclaration(MappedType['optional'](ReadonlyKeyword(), TypeParameter(TypeOperator(TypeReference())), QuestionToken(), IndexedAccessType(TypeReference(), TypeReference())))"),
        ("class A extends B<C> implements D { static x!: number; }", "ClassDeclaration(HeritageClause['heritage:ExtendsKeyword'](ExpressionWithTypeArguments(TypeReference())), HeritageClause['heritage:ImplementsKeyword'](ExpressionWithTypeArguments()), PropertyDeclaration['definite', 'modifier:StaticKeyword'](StaticKeyword(), ExclamationToken(), NumberKeyword()))"),
        ("@d class A { @e() m() {} }", "ClassDeclaration['decorator'](Decorator(), MethodDeclaration['decorator'](Decorator(CallExpression()), Block()))"),
        ("import a, { type b as c } from 'd'; export * from 'e';", "ImportDeclaration(ImportClause(NamedImports(ImportSpecifier()))) ExportDeclaration()"),
        ("for (const x of y) if (x) break; else continue;", "ForOfStatement(VariableDeclarationList['variable:const'](VariableDeclaration()), IfStatement(BreakStatement(), ContinueStatement()))"),
        ("new Map<string, number>();", "ExpressionStatement(NewExpression(StringKeyword(), NumberKeyword()))"),
        ("const enum E { A = 1, B }", "EnumDeclaration['modifier:ConstKeyword'](ConstKeyword(), EnumMember(), EnumMember())"),
        ("namespace A.B { }", "ModuleDeclaration(ModuleDeclaration(ModuleBlock()))"),
        ("async () => await x;", "ExpressionStatement(ArrowFunction['modifier:AsyncKeyword'](AsyncKeyword(), EqualsGreaterThanToken(), AwaitExpression()))"),
    ],
)
def test_shapes(source, expected):
    assert shape(source) == expected


def test_jsx():
    assert shape("<A.B x={1} {...p}>t {y}<i/></A.B>;", True) == (
        "ExpressionStatement(JsxElement(JsxOpeningElement(PropertyAccessExpression(), JsxAttributes(JsxAttribute(JsxExpression()), JsxSpreadAttribute())), "
        "JsxText(), JsxExpression(), JsxSelfClosingElement(JsxAttributes()), JsxClosingElement(PropertyAccessExpression())))"
    )


@pytest.mark.parametrize("source", ["let = [[[[\n", "let 123 = ;\n", "a b", "x = {", "`abc", "'ab\n'", "type X = ;", "foo(a,, b)", "class { x y }", "<T"])
def test_errors_are_raised(source):
    with pytest.raises(ParseError):
        parse(source, False)


def test_scan_errors_name_the_file(tmp_path):
    with pytest.raises(ScanError, match="Unable to parse broken.ts"):
        scan_text("broken.ts", "let = [[[[\n", 1, 1)
    with pytest.raises(FileNotFoundError):
        scan_file(str(tmp_path / "missing.ts"), 1, 1)


def test_hashes_are_ordered_and_53_bits():
    a, b = subtree_hash("Block", []), subtree_hash("Parameter", [])
    assert subtree_hash("ArrowFunction", [a, b]) != subtree_hash("ArrowFunction", [b, a])
    assert subtree_hash("ArrowFunction", [a, b]) == subtree_hash("ArrowFunction", [a, b])
    assert 0 <= a < 2**53 and a != b


def test_names_and_literals_do_not_count():
    renamed = CLAMP.replace("clamp", "limit").replace("level", "size").replace("rest", "left")
    assert scan_text("a.ts", CLAMP, 1, 1) == scan_text("b.ts", renamed, 1, 1)
    assert scan_text("a.ts", "x = 1;\nvar y = 'a';\n", 1, 1) == scan_text("a.ts", "z = 22;\nvar y = `b`;\n", 1, 1)


def test_deep_nesting():
    inner = "leaf"
    for _ in range(1500):
        inner = f"(leaf + {inner})"
    hashes, found = post_order(parse(f"function f(leaf) {{ return {inner}; }}", True))
    assert len(found) == 1 and len(hashes) == 4 * 1500 + 4


def test_lines_follow_all_breaks():
    (entry,) = scan_text("a.ts", "// c\r\n/** doc */\rfunction f() { return 1;\n}", 1, 1)
    assert entry[:2] == (3, 5)


def test_normalized_trees():
    from echofold import keeps_structural_child, markers, normalize, tag

    (function,) = parse(CLAMP, False).kids
    tree = normalize(function)
    assert (tree.tag, tree.count) == ("FunctionDeclaration", 22) and tag(function) == tree.tag
    (member,) = parse("class Lamp { static volts?: number = 3; }", False).kids[0].kids
    assert markers(member) == ["modifier:StaticKeyword", "optional"]
    assert [c.tag for c in normalize(member).children] == ["modifier:StaticKeyword", "optional", "StaticKeyword", "QuestionToken", "NumberKeyword"]
    assert not any(map(keeps_structural_child, ("Identifier", "PrivateIdentifier", "StringLiteral", "TrueKeyword", "NullKeyword", "JSDocComment"))) and keeps_structural_child("ThisKeyword")

    def hashes(node):
        below = [hashes(c) for c in node.children]
        own = subtree_hash(node.tag, [h for h, _ in below])
        return own, {own}.union(*[s for _, s in below])

    from echofold import fingerprints

    assert hashes(tree)[1] == fingerprints(function)


def test_public_names():
    import echofold

    assert all(getattr(echofold, name) is not None for name in echofold.__all__)
    (function,) = parse(CLAMP, False).kids
    assert echofold.node_count(function) == 22 and len(echofold.fingerprints(function)) == 20
