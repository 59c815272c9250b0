"""Tokens of Python, JavaScript, Java and Go, for the recogniser: kinds, and whether a token begins a line.

A kind is NAME, NUM, STR, a keyword or a sign itself. A text that cannot be cut into tokens (an open string or comment,
a stray sign, inconsistent indentation) gives None.
"""

import re

NAME = r"[^\W\d]\w*"

# The languages' keywords.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
    "javascript": "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async of get set from as null true false enum",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record sealed permits yield non when module open opens exports requires uses provides to with transitive",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

_PY_STRING = r"(?:[rRuUbBfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*')"
_PY_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"
_PYTHON = re.compile(
    rf"(?P<space>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\r\n]*)|(?P<newline>\r\n|\n|\r)|(?P<string>{_PY_STRING})|(?P<number>{_PY_NUMBER})|(?P<name>{NAME})"
    r"|(?P<sign>\.\.\.|\*\*=|//=|>>=|<<=|:=|->|[-+*/%@&|^]=|[=!<>]=|\*\*|//|>>|<<|[-+*/%@&|^~<>=()\[\]{},:;.!])",
    re.S,
)

_C_SPACE = r"(?P<space>[ \t\f\v﻿ ]+)|(?P<newline>\r\n|\n|\r| | )|(?P<comment>//[^\r\n]*|/\*(?:[^*]|\*(?!/))*\*/)"
_C_NUMBER = r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?"
_JAVA = re.compile(
    rf"{_C_SPACE}|(?P<string>\"\"\"[ \t\f]*\r?\n(?:[^\\]|\\.)*?\"\"\"|\"(?!\"\"[ \t\f]*\r?\n)(?:[^\"\\\r\n]|\\[^\r\n])*\"|'(?:[^'\\\r\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\[^\r\n])')"
    rf"|(?P<number>(?:{_C_NUMBER})[lLfFdD]?(?!\w))|(?P<name>[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<sign>->|::|\.\.\.|\+\+|--|&&|\|\||<<=|[-+*/%&|^=!<>]=|<<|[-+*/%&|^!~<>=()\[\]{},:;.?@])",
    re.S,
)
_GO = re.compile(
    rf"{_C_SPACE}|(?P<string>`[^`]*`|\"(?:[^\"\\\r\n]|\\[^\r\n])*\"|'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[0-7]{{3}}|[abfnrtv\\'\"]))')"
    rf"|(?P<number>(?:{_C_NUMBER})i?(?!\w))|(?P<name>{NAME})"
    r"|(?P<sign>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|:=|&\^|[-+*/%&|^=!<>]=|<<|>>|[-+*/%&|^!~<>=()\[\]{},:;.])",
    re.S,
)
_JS = re.compile(
    rf"{_C_SPACE}|(?P<string>\"(?:[^\"\\\r\n]|\\\r\n|\\.)*\"|'(?:[^'\\\r\n]|\\\r\n|\\.)*')|(?P<number>(?:{_C_NUMBER})n?(?![\w$]))|(?P<name>\#?(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<sign>=>|\?\.(?!\d)|\.\.\.|\+\+|--|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|>>>|\*\*|&&|\|\||\?\?|<<|>>|[-+*/%&|^=!<>]=|[-+*/%&|^!~<>=()\[\]{},:;.?])",
    re.S,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)


def python(text: str) -> tuple[list[str], list[bool]] | None:
    if text.startswith("﻿"):
        text = text[1:]
    words = KEYWORDS["python"]
    tokens: list[str] = []
    depth, pos, n = 0, 0, len(text)
    indents = [0]
    fresh = True  # at the start of a logical line
    match = _PYTHON.match
    while pos < n:
        if fresh and not depth:
            # Indentation: tabs to multiples of eight.
            col, p = 0, pos
            while p < n and text[p] in " \t\f":
                col = col // 8 * 8 + 8 if text[p] == "\t" else 0 if text[p] == "\f" else col + 1
                p += 1
            if p < n and text[p] not in "\r\n#" and text[p : p + 2] not in ("\\\n", "\\\r"):
                if col > indents[-1]:
                    indents.append(col)
                    tokens.append("INDENT")
                else:
                    while col < indents[-1]:
                        indents.pop()
                        tokens.append("DEDENT")
                    if col != indents[-1]:
                        return None
                fresh = False
            pos = p
            if pos >= n:
                break
        m = match(text, pos)
        if m is None:
            return None
        pos = m.end()
        kind = m.lastgroup
        if kind == "space" or kind == "comment":
            continue
        if kind == "newline":
            if not depth and not fresh:
                tokens.append("NEWLINE")
                fresh = True
            continue
        if kind == "name":
            t = m.group()
            tokens.append(t if t in words else "NAME")
        elif kind == "string":
            t = m.group()
            tokens.append("BYTES" if "b" in t[: min(t.find('"') % len(t), t.find("'") % len(t))].lower() else "STR")
        elif kind == "number":
            t = m.group()
            if len(t) > 1 and t[0] == "0" and t.replace("_", "").isdigit() and t.strip("0_"):
                return None
            tokens.append("NUM")
        else:
            t = m.group()
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth -= 1
                if depth < 0:
                    return None
            elif t == "!":
                return None
            tokens.append(t)
    if depth:
        return None
    if not fresh:
        tokens.append("NEWLINE")
    tokens += ["DEDENT"] * (len(indents) - 1)
    return tokens, [False] * len(tokens)


def _c_like(pattern: re.Pattern, text: str, words: frozenset, semicolons: bool) -> tuple[list[str], list[bool]] | None:
    tokens: list[str] = []
    lines: list[bool] = []
    pos, n, fresh = 0, len(text), True
    ends = {"NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
    match = pattern.match
    while pos < n:
        m = match(text, pos)
        if m is None:
            return None
        pos = m.end()
        kind = m.lastgroup
        if kind == "space":
            continue
        if kind == "comment" and "\n" not in m.group():
            continue
        if kind == "newline" or kind == "comment":
            # Go ends a statement at a line's end after these tokens.
            if semicolons and tokens and tokens[-1] in ends and not fresh:
                tokens.append(";")
                lines.append(False)
            fresh = True
            continue
        t = m.group()
        tokens.append("STR" if kind == "string" else "NUM" if kind == "number" else "NAME" if kind == "name" and t not in words else t)
        lines.append(fresh)
        fresh = False
    if semicolons and tokens and tokens[-1] in ends:
        tokens.append(";")
        lines.append(False)
    return tokens, lines


def java(text: str) -> tuple[list[str], list[bool]] | None:
    return _c_like(_JAVA, text.removeprefix("﻿"), KEYWORDS["java"], False)


def go(text: str) -> tuple[list[str], list[bool]] | None:
    return _c_like(_GO, text.removeprefix("﻿"), KEYWORDS["go"], True)


def javascript(text: str) -> tuple[list[str], list[bool]] | None:
    words = KEYWORDS["javascript"]
    tokens: list[str] = []
    lines: list[bool] = []
    pos, n, fresh = 0, len(text), True
    if text.startswith("#!"):
        pos = min([i for i in (text.find("\n"), n) if i >= 0])
    braces: list[bool] = []  # of each open brace: whether it is a template's ${
    # After these a slash divides; elsewhere it begins a regular expression.
    operands = {"NAME", "NUM", "STR", "REGEX", "TEMPLATE", "TAIL", ")", "]", "}", "this", "super", "null", "true", "false"}
    match = _JS.match
    while pos < n:
        c = text[pos]
        if c == "/" and (not tokens or tokens[-1] not in operands):
            m = _JS_REGEX.match(text, pos)
            if m:
                tokens.append("REGEX")
                lines.append(fresh)
                fresh, pos = False, m.end()
                continue
        if c == "`" or (c == "}" and braces and braces[-1]):
            m = _JS_TEMPLATE.match(text, pos + 1)
            if m is None:
                return None
            opens = m.group(1) == "${"
            if c == "`":
                tokens.append("HEAD" if opens else "TEMPLATE")
                if opens:
                    braces.append(True)
            else:
                tokens.append("MIDDLE" if opens else "TAIL")
                if not opens:
                    braces.pop()
            lines.append(fresh)
            fresh, pos = False, m.end()
            continue
        m = match(text, pos)
        if m is None:
            return None
        pos = m.end()
        kind = m.lastgroup
        if kind == "space":
            continue
        if kind == "newline" or kind == "comment":
            fresh |= kind == "newline" or "\n" in m.group()
            continue
        t = m.group()
        if t == "{":
            braces.append(False)
        elif t == "}":
            if not braces:
                return None
            braces.pop()
        tokens.append("STR" if kind == "string" else "NUM" if kind == "number" else "NAME" if kind == "name" and t not in words else t)
        lines.append(fresh)
        fresh = False
    return None if braces else (tokens, lines)


LEXERS = {"python": python, "javascript": javascript, "java": java, "go": go}
