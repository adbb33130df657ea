"""Catalyst-only lexer pieces (B1 segmentation building blocks).

Everything here returns ``Column`` expressions, so the work runs inside the
JVM (whole-stage codegen where Spark supports it) with no Python per row.

A file is tokenised inside its own row with one ``regexp_extract_all``; the
tokens are re-joined into two *masks* of the same byte length as the source:

* ``masked``: comments -> spaces, string/template/regex literals -> ``~``. Brace
  depth, statement heads and identifiers are read from this text, so braces
  or keywords inside strings and comments are never counted. Both masks have one
  character for each BYTE of a literal or comment, so places in them are byte offsets of the source.
* ``clean``: comments -> spaces, strings kept. Import/export clauses (whose
  source path lives in a string) are parsed from this text.

Newlines are kept by both masks, so ``split(x, '\\n')`` of content, masked and
clean give arrays of equal length whose elements line up.

A template literal is one token, with the literals inside its substitutions.
The pattern follows them ``NESTED`` levels down; a file with a deeper one is
scanned character by character with a stack of modes (``template_spans``).

Known deviations (documented, not bugs): a regex literal after ``)`` or an
operator other than those of ``TOKEN_RE``, JSX text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# One token per match: line comment | block comment | regex literal (a slash
# where an expression begins) | '..' | ".." | `..` | run of ordinary code |
# any single char. Possessive quantifiers keep very
# long literals from overflowing the regex engine's stack. Joined, the tokens
# give back the input exactly.
NESTED = 3


def _template_re(depth: int) -> str:
    """A whole template literal whose substitutions nest templates and braces at most ``depth`` levels deep."""
    return r"`(?:[^`\\$]++|\\.|\$(?!\{)|\$\{" + _code_re(depth) + r"\})*+`"


def _code_re(depth: int) -> str:
    """Code inside a substitution, up to the brace that closes it."""
    inner = "|" + _template_re(depth - 1) + r"|\{" + _code_re(depth - 1) + r"\}" if depth else ""
    return (r"(?:[^`{}'\"/]++|//[^\n]*+|/\*.*?\*/|/|'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"" + inner + ")*+")


TOKEN_RE = (
    r"(?s)//[^\n]*+|/\*.*?\*/"
    r"|/(?<=(?:[(,=:\[!&|?{};]|=>)\s{0,16}/|\breturn\s{1,16}/)"
    r"(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[A-Za-z]*+"
    r"|'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\""
    r"|" + _template_re(NESTED) + r"|[^/'\"`]++|."
)

# Keywords that open a top-level statement (a line at depth 0 starting with
# one of these, or with a decorator '@', starts a new statement).
STATEMENT_KEYWORDS = [
    "export", "import", "abstract", "class", "interface", "function", "async",
    "namespace", "module", "declare", "type", "enum", "const", "let", "var",
]

IDENT = r"[A-Za-z_$][\w$]*"

# Declaration head -> (keyword, name). Optional export/default/declare/
# abstract/async prefixes; 'const enum' is an enum.
DECL_RE = (
    r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    r"(?:const\s+)?(class|interface|function|namespace|module|enum|type|const|let|var)"
    r"\s*\*?\s*(" + IDENT + r")"
)

# import clause on comment-free text: 1 default name, 2 namespace alias,
# 3 named clause, 4 source path.
IMPORT_RE = (
    r"^\s*import\s+(?:type\s+)?(?:(" + IDENT + r")\s*,?\s*)?"
    r"(?:\*\s*as\s+(" + IDENT + r")|\{([^}]*)\})?\s*(?:from\s*)?['\"]([^'\"]*)['\"]"
)

# export list: export { a, b as c } [from '...']
EXPORT_LIST_RE = r"^\s*export\s+(?:type\s+)?\{([^}]*)\}\s*(?:from\s*['\"]([^'\"]*)['\"])?"

# export * [as ns] from '...': 1 name, 2 source path
EXPORT_STAR_RE = r"^\s*export\s+(?:type\s+)?\*\s*(?:as\s+([\w$]+)\s+)?from\s*['\"]([^'\"]*)['\"]"

# head of a variable declaration: 1 keyword
VARIABLE_HEAD_RE = r"^\s*(?:export\s+)?(?:declare\s+)?(const|let|var)\b(?!\s+enum\b)"

# type arguments of a call (their commas part no declarators), and the tokens of a declaration
TYPE_ARGUMENTS_RE = r"([\w$])<[\w\s,.\[\]|&$]*>(?=\()"
BINDING_TOKEN_RE = r"\.\.\.|=>|[=!<>]=++|[A-Za-z_$][\w$]*+|~++|\S"

# Method head at class-body depth 1 (modifiers, optional generator star,
# optional ?/!, optional type parameters, then '(').
METHOD_RE = (
    r"^\s*(?:(?:public|private|protected|static|readonly|abstract|async|override|get|set)\s+)*"
    r"\*?\s*(" + IDENT + r")\s*[?!]?\s*(?:<[^(]*>)?\s*\("
)

NOT_METHOD_NAMES = ["if", "for", "while", "switch", "catch", "return", "function", "super", "new"]


_built: dict[tuple, Column] = {}


def built_once(name: str, *columns: Column, build: Callable[..., Column]) -> Column:
    """``build(*columns)``, kept for plain column names: an expression with folds takes hundreds of calls into the JVM,
    and one expression object can stand in any number of plans."""
    key = (name, id(SparkContext._jvm), *(str(c) for c in columns))
    if not all(_PLAIN_NAME.match(k) for k in key[2:]):
        return build(*columns)
    if key not in _built:
        _built[key] = build(*columns)
    return _built[key]


_PLAIN_NAME = re.compile(r"^Column<'[A-Za-z_][\w.]*'>$")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(content: Column) -> Column:
    """array<string> of lexical tokens whose concatenation equals ``content``."""
    return built_once("tokens", content, build=_tokens)


def _tokens(content: Column) -> Column:
    # a lone backtick begins a template that the pattern cannot follow to its end
    return once(F.regexp_extract_all(content, F.lit(TOKEN_RE), 0),
                lambda found: F.when(F.array_contains(found, "`"), _scanned(content)).otherwise(found))


# Modes of the scan: what the brace or quote on top of the stack has opened.
_TEMPLATE, _SUBSTITUTION, _BRACE, _SINGLE, _DOUBLE, _LINE, _BLOCK = range(1, 8)


# the characters that open, close or escape something, and the runs of all others
_SIGNS = list("`$'\"/*{}\\\n")
_SIGN_RE = r"[^`$'\"/*{}\\\n]++|[`$'\"/*{}\\\n]"


def template_spans(content: Column) -> Column:
    """array<struct<start, stop>> (characters) of the outermost template literals that are closed: a fold over the
    characters that can change a mode, and the runs between them, whose state is a stack of modes. Any depth; linear in
    the text."""
    state = "struct<pos:int,skip:boolean,before:string,start:int,stack:array<int>,spans:array<struct<start:int,stop:int>>>"
    zero = F.from_json(F.lit('{"pos":0,"skip":false,"before":"","start":0,"stack":[],"spans":[]}'), state)

    def step(acc: Column, c: Column) -> Column:
        stack, pos, before = acc["stack"], acc["pos"], acc["before"]
        top = F.when(F.size(stack) > 0, F.element_at(stack, -1)).otherwise(0)
        code = top.isin(0, _SUBSTITUTION, _BRACE)
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))

        def push(mode: int) -> Column:
            return F.concat(stack, F.array(F.lit(mode)))

        inside = F.array_contains(stack, _TEMPLATE)
        opens = code & (c == "`")
        closes = (top == _TEMPLATE) & (c == "`") & ~acc["skip"]
        last = closes & ~F.array_contains(popped, _TEMPLATE)
        quiet = top.isin(_TEMPLATE, _SINGLE, _DOUBLE)
        new = (
            F.when(acc["skip"], stack)
            .when(opens, push(_TEMPLATE)).when(closes, popped)
            .when((top == _TEMPLATE) & (before == "$") & (c == "{"), push(_SUBSTITUTION))
            .when(code & (before == "/") & (c == "/"), push(_LINE))
            .when(code & (before == "/") & (c == "*"), push(_BLOCK))
            .when(code & (c == "'"), push(_SINGLE)).when(code & (c == '"'), push(_DOUBLE))
            .when(code & (c == "{") & inside, push(_BRACE))
            .when(top.isin(_SUBSTITUTION, _BRACE) & (c == "}"), popped)
            .when((top == _SINGLE) & c.isin("'", "\n"), popped).when((top == _DOUBLE) & c.isin('"', "\n"), popped)
            .when((top == _LINE) & (c == "\n"), popped)
            .when((top == _BLOCK) & (before == "*") & (c == "/"), popped)
            .otherwise(stack)
        )
        # a character that changes the mode is no first half of another sign
        act = once(new, lambda now: F.struct(
            (pos + 1).alias("pos"), (quiet & (c == "\\") & ~acc["skip"]).alias("skip"),
            F.when(acc["skip"] | (F.size(now) != F.size(stack)), F.lit("")).otherwise(c).alias("before"),
            F.when(opens & ~inside, pos).otherwise(acc["start"]).alias("start"), now.alias("stack"),
            F.when(last, F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("start"), (pos + 1).alias("stop")))))
            .otherwise(acc["spans"]).alias("spans"),
        ).cast(state))
        run = F.struct((pos + F.length(c)).alias("pos"), F.lit(False).alias("skip"), F.lit("").alias("before"),
                       acc["start"].alias("start"), stack.alias("stack"), acc["spans"].alias("spans")).cast(state)
        return F.when(c.isin(*_SIGNS), act).otherwise(run)

    return F.aggregate(F.regexp_extract_all(content, F.lit(_SIGN_RE), 0), zero, step, lambda acc: acc["spans"])


def _scanned(content: Column) -> Column:
    """``tokens`` of a text with deeply nested templates: these by the scan, what lies between by the pattern."""
    ends = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop")))
    plain = F.lit(TOKEN_RE)

    def piece(stops: Column, x: Column, i: Column) -> Column:
        following = F.get(stops, i + 1)
        after = F.coalesce(following["start"], F.length(content))
        between = F.regexp_extract_all(F.substring(content, x["stop"] + 1, after - x["stop"]), plain, 0)
        literal = F.when(following.isNotNull(), F.array(F.substring(content, following["start"] + 1, following["stop"] - following["start"])))
        return F.concat(between, F.coalesce(literal, F.array().cast("array<string>")))

    return once(F.concat(ends, template_spans(content)),
                lambda stops: F.flatten(F.transform(stops, lambda x, i: piece(stops, x, i))))


def _is_comment(t: Column) -> Column:
    return t.startswith("//") | t.startswith("/*")


def _is_string(t: Column) -> Column:
    # a longer token that begins with a slash and is no comment is a regex literal
    return (F.length(t) > 1) & ~_is_comment(t) & (
        t.startswith("'") | t.startswith('"') | t.startswith("`") | t.startswith("/")
    )


def _blank_out(t: Column, ch: str) -> Column:
    """``ch`` for every byte of a token but its newlines; single-line tokens
    (most) take the cheap ``repeat`` path, multi-line ones a regex."""
    return F.when(F.instr(t, "\n") == 0, F.repeat(F.lit(ch), F.octet_length(t))).otherwise(
        F.regexp_replace(F.decode(F.encode(t, "UTF-8"), "ISO-8859-1"), r"[^\n]", ch)
    )


def masked_text(toks: Column) -> Column:
    """comments -> spaces, strings -> '~' (same byte length, newlines kept)."""
    return F.array_join(
        F.transform(
            toks,
            lambda t: F.when(_is_comment(t), _blank_out(t, " "))
            .when(_is_string(t), _blank_out(t, "~"))
            .otherwise(t),
        ),
        "",
    )


def clean_text(toks: Column) -> Column:
    """comments -> spaces, strings kept (same byte length, newlines kept)."""
    return F.array_join(
        F.transform(toks, lambda t: F.when(_is_comment(t), _blank_out(t, " ")).otherwise(t)), ""
    )


def comment_tokens(toks: Column) -> Column:
    return F.filter(toks, _is_comment)


def strip_comments_text(toks: Column) -> Column:
    """Text with comment tokens removed (not blanked)."""
    return F.array_join(F.filter(toks, lambda t: ~_is_comment(t)), "")


_WS_OTHER = "\t\r\f\u000b"


# Where a line is cut before another statement or member: behind a semicolon, behind a closing brace before another
# or before a word that does not go on with the same statement, behind the opening brace of a class or namespace
# body, and before an export inside braces.
_GOES_ON = "from|as|satisfies|else|catch|finally|while|extends|implements|instanceof|in|of|is"
_CLOSE_CUT = r"(?<=;)(?=[ \t]*[^\s])|(?<=\})(?=[ \t]*(?:@|(?!(?:" + _GOES_ON + r")\b)[A-Za-z_$]))"
_CLOSE_CUT += r"|(?<=\})(?=[ \t]*\})"
_CUT_RE = _CLOSE_CUT + r"|(?<=\{)(?=[ \t]*export\b)"
_BODY_CUT_RE = _CLOSE_CUT + r"|(?<=\{)(?=[ \t]*[^\s}])"
_MAY_CUT_RE = r";[ \t]*+[^\s]|\}[ \t]*+(?:[@}]|(?!(?:" + _GOES_ON + r")\b)[A-Za-z_$])|\{[ \t]*+export\b|(?:class|namespace|module)[ \t][^\n{]*+\{[ \t]*+[^\s}]"
_BODY_RE = r"\b(?:class|namespace|module)\b"


def cut_lines(content: Column, masked: Column) -> Column:
    """A struct of three arrays (raw_l, mask_l, place_l) of equal length for the stretches of a file that the statement rules look at one by one: raw text,
    masked text, and how each lies in its line (1: does not begin it, 2: does not end it, 3: neither; null or 0: whole line).
    A stretch is a line, or a part of one where the line holds several statements. Without any such line the last array is empty."""
    return built_once("cut_lines", content, masked, build=_cut_lines)


def _cut_lines(content: Column, masked: Column) -> Column:
    raw_l, mask_l = F.split(content, "\n", -1), F.split(masked, "\n", -1)
    parts = F.transform(mask_l, lambda m: F.when(m.rlike(_MAY_CUT_RE), F.when(
        m.rlike(_BODY_RE), F.split(m, _BODY_CUT_RE, -1)).otherwise(F.split(m, _CUT_RE, -1))).otherwise(F.array(m)))
    block = 256  # prefix sums of the lengths: by blocks, then within one

    def raw_parts(raw: Column, segs: Column) -> Column:
        data = raw.cast("binary")
        lens = F.transform(segs, lambda m: F.octet_length(m))
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(segs) - 1) / block).cast("int")),
                             lambda k: total(F.slice(lens, k * block + 1, block)))
        return F.transform(segs, lambda m, i: F.decode(F.substring(
            data, total(F.slice(blocks, 1, F.floor(i / block).cast("int"))) + total(F.slice(lens, F.floor(i / block).cast("int") * block + 1, i % block)) + 1,
            F.octet_length(m)), "UTF-8"))

    def cut(parts: Column) -> Column:
        z = F.arrays_zip(raw_l.alias("r"), parts.alias("p"))
        raws = F.flatten(F.transform(z, lambda x: F.when(F.size(x["p"]) == 1, F.array(x["r"])).otherwise(raw_parts(x["r"], x["p"]))))
        places = F.flatten(F.transform(parts, lambda p: F.transform(
            p, lambda m, i: F.when(i > 0, 1).otherwise(0) + F.when(i < F.size(p) - 1, 2).otherwise(0))))
        return F.struct(raws.alias("raw_l"), F.flatten(parts).alias("mask_l"), places.alias("place_l"))

    whole = F.struct(raw_l.alias("raw_l"), mask_l.alias("mask_l"), F.array().cast("array<int>").alias("place_l"))
    return F.when(masked.rlike(_MAY_CUT_RE), once(parts, cut)).otherwise(whole)


# The blanks that the trim functions take off. They are given to these instead of being mapped to spaces before, as
# ``translate`` looks up every character of a text in a map.
BLANKS = " " + _WS_OTHER


def trim(s: Column) -> Column:
    return F.trim(s, F.lit(BLANKS))


def ltrim(s: Column) -> Column:
    return F.ltrim(s, F.lit(BLANKS))


def rtrim(s: Column) -> Column:
    return F.rtrim(s, F.lit(BLANKS))


def is_blank(s: Column) -> Column:
    return F.length(trim(s)) == 0


def _count(s: Column, char: str) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(char), F.lit("")))


def brace_delta(masked_line: Column) -> Column:
    """Opening minus closing brackets of a masked line (by bytes, no regex)."""
    up, down = ([_count(masked_line, c) for c in chars] for chars in ("{([", "})]"))
    return up[0] + up[1] + up[2] - down[0] - down[1] - down[2]


def first_word(masked_line: Column) -> Column:
    return F.regexp_extract(ltrim(masked_line), r"^(@|[A-Za-z_$][\w$]*)", 1)


def last_char(masked_line: Column) -> Column:
    return F.substring(rtrim(masked_line), -1, 1)


def strip_decorators(mcode: Column) -> Column:
    return F.regexp_replace(mcode, r"^\s*(?:@[\w$.]+\s*(?:\([^)]*\))?\s*)+", "")


def raw_type_of(head: Column, is_comment_only: Column) -> Column:
    """Syntax-node type name of a top-level statement from its masked code
    (decorators stripped). Names follow the public TypeScript grammar used by
    tree-sitter."""
    h = strip_decorators(head)
    return (
        F.when(is_comment_only, F.lit("comment"))
        .when(is_blank(h), F.lit(None))
        .when(h.rlike(r"^\s*import(\s|\{|\*|~|$)"), "import_statement")
        .when(h.rlike(r"^\s*export(\s|\{|\*|$)"), "export_statement")
        .when(h.rlike(r"^\s*abstract\s+class\b"), "abstract_class_declaration")
        .when(h.rlike(r"^\s*class\b"), "class_declaration")
        .when(h.rlike(r"^\s*interface\b"), "interface_declaration")
        .when(h.rlike(r"^\s*(async\s+)?function\s*\*"), "generator_function_declaration")
        .when(h.rlike(r"^\s*(async\s+)?function\b"), "function_declaration")
        .when(h.rlike(r"^\s*(const\s+)?enum\b"), "enum_declaration")
        .when(h.rlike(r"^\s*(const|let)\b"), "lexical_declaration")
        .when(h.rlike(r"^\s*var\b"), "variable_declaration")
        .when(h.rlike(r"^\s*type\s+[A-Za-z_$]"), "type_alias_declaration")
        .when(h.rlike(r"^\s*namespace\b"), "internal_module")
        .when(h.rlike(r"^\s*module\b"), "module")
        .when(h.rlike(r"^\s*declare\b"), "ambient_declaration")
        .otherwise("expression_statement")
    )


def raw_type_of_line(line: Column, word: Column) -> Column:
    """``raw_type_of`` for a masked line whose first word is ``word``, one of STATEMENT_KEYWORDS or '@': the word alone
    decides in most cases, and only decorators need to be stripped."""
    def rest(pattern: str, kind: str, other: Column | str = "expression_statement") -> Column:
        return F.when(line.rlike(r"^\s*" + pattern), kind).otherwise(other)

    function = F.when(line.rlike(r"^\s*(async\s+)?function\s*\*"), "generator_function_declaration")
    return (
        F.when(word == "@", raw_type_of(line, F.lit(False)))
        .when(word == "import", rest(r"import(\s|\{|\*|~|$)", "import_statement"))
        .when(word == "export", rest(r"export(\s|\{|\*|$)", "export_statement"))
        .when(word == "abstract", rest(r"abstract\s+class\b", "abstract_class_declaration"))
        .when(word == "class", "class_declaration")
        .when(word == "interface", "interface_declaration")
        .when(word == "function", function.otherwise("function_declaration"))
        .when(word == "async", function.otherwise(rest(r"async\s+function\b", "function_declaration")))
        .when(word == "enum", "enum_declaration")
        .when(word == "const", rest(r"const\s+enum\b", "enum_declaration", "lexical_declaration"))
        .when(word == "let", "lexical_declaration")
        .when(word == "var", "variable_declaration")
        .when(word == "type", rest(r"type\s+[A-Za-z_$]", "type_alias_declaration"))
        .when(word == "namespace", "internal_module")
        .when(word == "module", "module")
        .when(word == "declare", "ambient_declaration")
        .otherwise("expression_statement")
    )


def _head(mcode: Column, decorated: Column | None) -> Column:
    stripped = strip_decorators(mcode)
    return stripped if decorated is None else F.when(decorated, stripped).otherwise(mcode)


def decl_keyword(mcode: Column, decorated: Column | None = None) -> Column:
    return F.regexp_extract(_head(mcode, decorated), DECL_RE, 1)


def decl_name(mcode: Column, decorated: Column | None = None) -> Column:
    n = F.regexp_extract(_head(mcode, decorated), DECL_RE, 2)
    return F.when(n != "", n)


def identifiers(mcode: Column) -> Column:
    """Distinct identifiers of masked code (strings/comments already blanked)."""
    return F.array_distinct(F.regexp_extract_all(mcode, F.lit(r"(?<![\w$.])[A-Za-z_$][\w$]*"), 0))
