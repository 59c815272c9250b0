"""Whether documentation says, in words of its own, what the code does."""

import re

# Words that only stand in for a description, in the languages of the test texts.
STAND_INS = frozenset(
    """add added adding a an the any be been is are will to do does doc docs docstring docstrings document documented documentation documenting
    describe described description desc comment comments comes come goes go here later soon missing none nothing empty blank fill filled in me it this that
    na n tbd tba todo fixme xxx wip hack placeholder stub summary short brief long text string no not yet available provided needed required write
    function functions func fn method methods class def definition define procedure routine member constructor helper of for and or with from my your name
    brak opisu opis opisy do uzupełnienia uzupełnić dokumentacja dokumentacji metoda metody funkcja funkcji klasa tu jest nie ma
    beschreibung dokumentation fehlt folgt hier keine kein methode funktion klasse noch später siehe ergänzen
    опис немає документація метод функція клас додати пізніше тут""".split()
)
# Whole lines that direct tools or mark what is left to do.
_DIRECTIVES = re.compile(
    r"""^\s*(\#\s*)?(noqa\b|type:\s*ignore|pylint:|flake8:|mypy:|pyright:|ruff:|isort:|fmt:|yapf:|pragma\b|coverage:|nosec\b|eslint\b|eslint-|jshint\b|jslint\b|istanbul\b|c8\b|prettier-|@?ts-|nolint\b|go:|lint:|noinspection\b|checkstyle|cspell|codespell|nosonar|@?suppress\w*|-\*-|vim:).*$"""
    r"""|^\s*(\#\s*)?(TODO|FIXME|XXX|HACK|TBD|TBA|WIP)\b.*$""",
    re.I | re.X,
)
# Sentences that only point elsewhere.
_POINTERS = re.compile(
    r"""^\W*(@?see\b(?!\s+(if|whether|that|how|to)\b)|@?inherit\w*\b|\{@inherit\w*\}|same\s+as\b|as\s+above\b|like\s+above\b|cf\.?\s|refer\s+to\b|refers\s+to\b|documented\s+(in|at)\b|overrides?\b[^.]*$|implements?\s+[\w.#]+$|ditto\b|copied\s+from\b|docs?\s+(in|at)\b|siehe\b|wie\s+oben\b|zob\.?\b|zobacz\b|patrz\b|jak\s+wyżej\b|див\.?\b|дивись\b|як\s+вище\b|:(py:)?(func|meth|class|mod):|https?://)""",
    re.I | re.X,
)
# The start of a part on parameters, results and the like: Google, NumPy, reStructuredText and tag style.
_SECTION = re.compile(
    r"^\s*(args|arguments|parameters|params|keyword args|keyword arguments|other parameters|attributes|returns?|return value|yields?|raises?|throws?|exceptions?|see also|references?|examples?|notes?|warnings?|todo|parametry|zwraca|argumenty|parameter|rückgabe|параметри|повертає)\s*:?\s*$", re.I
)
_TAG = re.compile(r"^\s*(:\w+(\s+[^:]*)?:|@(param|return|returns|throws|exception|arg|argument|see|since|author|version|deprecated|type|rtype|raises|yields|link|inheritdoc|override|template|typedef|callback|private|public|protected|async|static)\b)", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def pieces(name: str) -> list[str]:
    """The words in an identifier, lower case: camel case and underscores are borders."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\dA-Za-z_]+", name)]


def prose(doc: str) -> str:
    """The description in documentation: without parts on parameters and the like, directives, notes to do and pointers."""
    kept: list[str] = []
    rows = re.split(r"\r\n|\n|\r", doc)
    i = 0
    skip_tag = False
    while i < len(rows):
        row = rows[i]
        under = i + 1 < len(rows) and re.match(r"^\s*([-=~^*])\1{2,}\s*$", rows[i + 1])
        if _SECTION.match(row) and (row.rstrip().endswith(":") or under):
            # Up to a blank line that no further indented row follows, or the next section.
            margin = len(row) - len(row.lstrip())
            i += 2 if under else 1
            while i < len(rows):
                following = rows[i]
                if not following.strip():
                    j = i + 1
                    while j < len(rows) and not rows[j].strip():
                        j += 1
                    if j < len(rows) and not under and len(rows[j]) - len(rows[j].lstrip()) > margin:
                        i = j
                        continue
                    break
                if _SECTION.match(following) and following.rstrip().endswith(":"):
                    break
                i += 1
            skip_tag = False
            continue
        if _TAG.match(row):
            skip_tag = True
        elif not row.strip():
            skip_tag = False
            kept.append("")
        elif skip_tag and row[:1].isspace():
            pass
        elif _DIRECTIVES.match(row):
            skip_tag = False
        else:
            skip_tag = False
            kept.append(row)
        i += 1
    text = "\n".join(kept)
    # Sentence by sentence, without those that only point elsewhere.
    sentences = re.split(r"(?<=[.!?])\s+|\n\s*\n", text)
    return " ".join(s for s in sentences if s.strip() and not _POINTERS.match(s))


def says_something(doc: str | None, name: str, parameters: str = "", least: int = 2) -> bool:
    """Whether the description has at least ``least`` words that are no stand-ins, not of the name, and no parameters' names.

    Null, empty or blank documentation says nothing. parameters: the signature's text between its brackets.
    """
    if not doc or not doc.strip():
        return False
    own = {*pieces(name), name.lower()}
    own |= {w + "s" for w in own} | {w + "es" for w in own} | {w + "ed" for w in own} | {w + "ing" for w in own} | {w.removesuffix("e") + "ing" for w in own}
    given = {w.lower() for w in re.findall(r"\w+", re.sub(r"(?<=[=:])[^,)]*", "", parameters))}
    text = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", " ", prose(doc))
    # "name: start, end" and the like list parameters.
    words = [w.lower() for w in _WORD.findall(re.sub(r"[<{\[_]+(\w+)[>}\]_]+", r" \1 ", text))]
    return len({w for w in words if len(w) > 1 and w not in own and w not in STAND_INS and w not in given}) >= least
