"""Island grammars: the documentation, annotations, signatures and balanced bodies of functions; all else is water.

A language's island grammar knows its comments and texts (so that braces in them don't count), and what begins a
function or method. Nothing else of a file is parsed, so damaged files still give their islands.
"""

import re
from dataclasses import dataclass

_LINE = re.compile(r"\r\n|\n|\r")
_SPANS = {
    "python": re.compile(r"#[^\r\n]*|(?:\b[rRuUbBfFtT]{1,2})?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*')", re.S),
    "javascript": re.compile(r"//[^\r\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<=[=(,:;!&|?{}\[])[ \t]*/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/", re.S),
    "java": re.compile(r"//[^\r\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"\"\"[ \t]*\r?\n(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)+'", re.S),
    "go": re.compile(r"//[^\r\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\\r\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\r\n]|\\.)+'", re.S),
}
# What begins an island, at the start of a line; group 1 is its name.
_HEADS = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", re.M),
    "javascript": re.compile(
        r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*([\w$]+)|(?:const|let|var)[ \t]+([\w$]+)[ \t]*=[ \t]*(?:async\b[ \t]*)?(?:function\b|\([^()]*\)[ \t]*=>|[\w$]+[ \t]*=>)"
        r"|(?:(?:static|async|get|set)[ \t]+|\*[ \t]*)*(?!(?:if|for|while|switch|catch|return|function|with|constructor\b(?!\())\b)([\w$#]+)[ \t]*\([^;]*?\)[ \t]*\{)",
        re.M,
    ),
    "java": re.compile(r"^[ \t]*(?:@\w+(?:\([^)]*\))?[ \t]+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^>]+>[ \t]*)?(?!return\b|new\b|throw\b|else\b)[\w.<>\[\],? ]+[ \t]+(\w+)[ \t]*\([^;{]*?\)[^;{]*?[;{]", re.M),
    "go": re.compile(r"^func[ \t]*(?:\([^)]*\)[ \t]*)?(\w+)[ \t]*[\[(]", re.M),
}


@dataclass
class Island:
    name: str
    line: int
    signature: str
    doc: str | None
    code: str


class Water:
    """A file with its lines and the places of its comments and texts."""

    def __init__(self, text: str, language: str, start: int = 0):
        self.text, self.language = text, language
        self.starts = [0, *(m.end() for m in _LINE.finditer(text))]
        self.lines = _LINE.split(text)
        self.spans = [m.span() for m in _SPANS[language].finditer(text, start)]
        self.span_starts = [a for a, _ in self.spans]

    def line_of(self, pos: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, pos)

    def covered(self, pos: int) -> tuple[int, int] | None:
        """The comment or text that holds a place."""
        from bisect import bisect_right

        i = bisect_right(self.span_starts, pos) - 1
        return self.spans[i] if i >= 0 and self.spans[i][0] <= pos < self.spans[i][1] else None

    def balanced(self, pos: int, stop: str) -> int:
        """The place of the first of the signs ``stop`` outside brackets from pos on; -1 without one."""
        depth = 0
        n = len(self.text)
        while pos < n:
            span = self.covered(pos)
            if span:
                pos = span[1]
                continue
            c = self.text[pos]
            if not depth and c in stop:
                return pos
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth < 0:
                    return -1
            pos += 1
        return -1


def at_line(water: Water, line: int, name: str | None = None) -> Island | None:
    """The island that begins on a line (from 1), or None where no function begins there."""
    if not 1 <= line <= len(water.lines):
        return None
    begin = water.starts[line - 1]
    m = _HEADS[water.language].match(water.text, begin)
    found = next((g for g in m.groups() if g), None) if m else None
    if m is None or (name is not None and found != name):
        # The signature is cut off or of an unusual form: the name alone, as a word of the line.
        if name is None or not re.search(rf"(?<![\w$]){re.escape(name)}(?![\w$])", water.lines[line - 1]):
            return None
        found = name
    return _python(water, line, begin, found) if water.language == "python" else _braces(water, line, begin, found)


def _python(water: Water, line: int, begin: int, name: str) -> Island:
    text = water.text
    colon = water.balanced(begin + len(water.lines[line - 1]) - len(water.lines[line - 1].lstrip()), ":")
    if colon < 0:
        return Island(name, line, water.lines[line - 1].strip(), None, water.lines[line - 1])
    # The body: the lines further in than the head, blank ones and those within texts included.
    margin = len(water.lines[line - 1]) - len(water.lines[line - 1].lstrip())
    last = water.line_of(colon)
    end = last
    k = last + 1
    while k <= len(water.lines):
        row = water.lines[k - 1]
        span = water.covered(water.starts[k - 1])
        if row.strip() and not (span and span[0] < water.starts[k - 1]) and len(row) - len(row.lstrip()) <= margin:
            break
        if row.strip():
            end = k
        k += 1
    code = "\n".join(water.lines[line - 1 : end])
    # The documentation: a text that is the body's first statement.
    pos = colon + 1
    while True:
        gap = re.compile(r"[\s\\]*").match(text, pos)
        pos = gap.end()
        if pos < len(text) and text[pos] == "#":
            pos = water.covered(pos)[1] if water.covered(pos) else len(text)
            continue
        break
    doc = None
    m = re.compile(r"([rRuU]?)(\"\"\"|'''|\"|')").match(text, pos)
    if m:
        span = water.covered(pos)
        close = m.group(2)
        inside = text[m.end() : span[1] - len(close)] if span and span[0] == pos and text[span[1] - len(close) : span[1]] == close and span[1] - len(close) >= m.end() else None
        if inside is None and len(close) == 3 and text.find(close, m.end()) < 0:
            inside = text[m.end() :]  # cut off within the documentation
        after = text[span[1] : span[1] + 1] if span else ""
        if inside is not None and after not in (".", "[", "%", "+"):
            doc = _unescaped(inside) if not m.group(1).lower() == "r" else inside
    return Island(name, line, re.sub(r"\s+", " ", text[begin:colon]).strip(), doc, code)


def _unescaped(text: str) -> str:
    return re.sub(r"\\([\\'\"])|\\\r?\n", lambda m: m.group(1) or "", text)


def _braces(water: Water, line: int, begin: int, name: str) -> Island:
    text = water.text
    at = text.find(name, begin)
    opens = water.balanced(text.find("(", at + len(name)) if "(" in text[at + len(name) :] else at, "{;") if at >= 0 else -1
    end, close = len(text), -1
    if opens >= 0 and text[opens] == "{":
        close = water.balanced(opens + 1, "}")
        end = close + 1 if close >= 0 else len(text)
        if text[end : end + 1] == ";":
            end += 1
    elif opens >= 0:
        end = opens
    code = text[begin:end] if close >= 0 or (opens >= 0 and text[opens] == ";") else "\n".join(water.lines[line - 1 :])
    head = text[begin:opens] if opens >= 0 else water.lines[line - 1]
    return Island(name, line, re.sub(r"\s+", " ", head).strip(), _above(water, line), code.strip("\r\n"))


def _above(water: Water, line: int) -> str | None:
    """The documentation directly above a line: // lines in Go; a /** */ block in JavaScript and Java, annotations aside."""
    k = line - 1
    if water.language == "go":
        rows = []
        while k >= 1 and water.lines[k - 1].lstrip().startswith("//") and not water.lines[k - 1][:1].isspace():
            rows.append(water.lines[k - 1].strip())
            k -= 1
        # Directives such as //go:build are no documentation.
        rows = [r[2:].removeprefix(" ") for r in reversed(rows) if not re.match(r"//[a-z]+:\S|//(nolint|line )", r)]
        return "\n".join(rows) if rows else None
    while begin := _annotation(water, k):
        k = begin - 1
    if k < 1 or not water.lines[k - 1].rstrip().endswith("*/"):
        return None
    close = water.starts[k - 1] + len(water.lines[k - 1].rstrip())
    begin = text_begin(water, close)
    if begin is None or not water.text.startswith("/**", begin) or water.text.startswith("/**/", begin):
        return None
    # The block must stand alone on its lines.
    if water.text[water.starts[water.line_of(begin) - 1] : begin].strip():
        return None
    return cleaned(water.text[begin:close])


def _annotation(water: Water, line: int) -> int | None:
    """The line on which the annotations begin that end with a line: names after @, each maybe with arguments in brackets,

    over any number of lines; None where no annotation ends there."""
    end = water.starts[line - 1] + len(water.lines[line - 1]) if line >= 1 else 0
    k = line
    # Statements and comments end above annotations; inside an annotation's brackets they don't.
    while k >= 1 and water.lines[k - 1].strip() and not water.lines[k - 1].rstrip().endswith((";", "*/")):
        pos = water.starts[k - 1]
        while m := re.compile(r"\s*@\w[\w.]*[ \t]*").match(water.text, pos, end):
            pos = m.end()
            if water.text.startswith("(", pos):
                pos = water.balanced(pos + 1, ")") + 1 or end + 1
        if pos > water.starts[k - 1] and pos <= end and not water.text[pos:end].strip():
            return k
        k -= 1
    return None


def text_begin(water: Water, close: int) -> int | None:
    """Where the block comment that ends at a place begins."""
    span = water.covered(close - 1)
    if span and span[1] == close and water.text.startswith("/*", span[0]):
        return span[0]
    # Water swallowed by an open text further up: the nearest opening of a comment.
    begin = water.text.rfind("/*", 0, close - 2)
    return begin if begin >= 0 and "*/" not in water.text[begin : close - 2] else None


def cleaned(doc: str | None) -> str | None:
    """Documentation without its delimiters (quotes, comment signs, leading stars)."""
    if doc is None:
        return None
    text = doc.strip()
    m = re.match(r"[rRuU]?(\"\"\"|''')", text)
    if m:
        text = text[m.end() :].removesuffix(m.group(1))
    elif text.startswith("/*"):
        text = re.sub(r"^/\*+", "", text)
        text = re.sub(r"\**\*/$", "", text)
        text = "\n".join(re.sub(r"^\s*\*? ?", "", row) if i else row.strip() for i, row in enumerate(_LINE.split(text)))
    elif text.startswith("//"):
        text = "\n".join(re.sub(r"^\s*// ?", "", row) for row in _LINE.split(text))
    elif len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" and text[0] not in text[1:-1]:
        text = text[1:-1]
    return text.strip()


def islands(text: str, language: str) -> list[Island]:
    """All functions and methods of a file, in order."""
    water = Water(text, language)
    out = []
    for m in _HEADS[language].finditer(text):
        # The match may begin on blank lines before the head.
        at = m.start() + len(m.group(0)) - len(m.group(0).lstrip())
        if water.covered(at) is None:
            found = at_line(water, water.line_of(at))
            if found:
                out.append(found)
    return out
