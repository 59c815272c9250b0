"""Entities and imports of Python files, by the interpreter's own parser."""

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = "name string, type string, line_start int, line_end int, signature string, raw_code string, docstring string, parent string, dependencies array<string>"
_HEAD = re.compile(r"(?P<margin>[ \t]*)(?P<kind>def|class)[ \t]+(?P<name>\w+)")
IMPORT = "type string, module string, name string, alias string, full_name string, level int"


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return ""


def _signature(f: ast.FunctionDef) -> str:
    parts = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in f.args.args]
    parts += [f"*{f.args.vararg.arg}"] if f.args.vararg else []
    parts += [f"**{f.args.kwarg.arg}"] if f.args.kwarg else []
    return f"def {f.name}({', '.join(parts)})" + (f" -> {ast.unparse(f.returns)}" if f.returns else "")


def _row(node: ast.AST, rows: list[str], signature: str, kind: str, parent: str | None, calls: list[str]) -> dict:
    last = node.end_lineno or node.lineno
    code = "\n".join(rows[node.lineno - 1 : last])
    return dict(name=node.name, type=kind, line_start=node.lineno, line_end=last, signature=signature, raw_code=code, docstring=ast.get_docstring(node), parent=parent, dependencies=calls)


def _function(node: ast.FunctionDef, rows: list[str], parent: str | None) -> dict:
    calls = {_dotted(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)} - {""}
    return _row(node, rows, _signature(node), "method" if parent else "function", parent, sorted(calls))


def _tree(code: str | None) -> ast.Module | None:
    try:
        return ast.parse(code) if code is not None else None
    except (SyntaxError, ValueError, RecursionError):
        return None


def entities_of(code: str | None) -> list[dict]:
    """Top-level functions and classes with their methods, in order; calls sorted. None, and code that doesn't parse, gives none.

    Async and nested functions are left out, decorators too.
    """
    tree = _tree(code)
    out: list[dict] = []
    rows = code.split("\n") if tree else []
    for node in tree.body if tree else []:
        if isinstance(node, ast.FunctionDef):
            out.append(_function(node, rows, None))
        elif isinstance(node, ast.ClassDef):
            bases = ", ".join(_dotted(b) if isinstance(b, ast.Name | ast.Attribute) else "" for b in node.bases)
            out.append(_row(node, rows, f"class {node.name}" + (f"({bases})" if node.bases else ""), "class", None, []))
            out += [_function(m, rows, node.name) for m in node.body if isinstance(m, ast.FunctionDef)]
    return out


def tolerant_entities_of(code: str | None) -> list[dict]:
    """As entities_of; of code that doesn't parse, the functions and classes at its margin and the methods of these classes.

    A block reaches from its head to the last further indented row. What parses by itself is taken from the parser; of the rest
    the head is the signature, without documentation and calls. Blank rows and a head over several rows belong to the block.
    """
    if code is None or _tree(code) is not None:
        return entities_of(code)
    return _blocks(code.split("\n"), 0, "", None)


def _blocks(rows: list[str], first: int, margin: str, parent: str | None) -> list[dict]:
    """Entities of rows from place ``first`` on whose heads stand at a margin; parent: the class they are methods of."""
    out: list[dict] = []
    k = first
    while k < len(rows):
        m = _HEAD.match(rows[k])
        if m is None or m["margin"] != margin:
            k += 1
            continue
        end, depth = k + 1, _depth(rows[k])
        while end < len(rows) and (depth > 0 or not rows[end].strip() or len(rows[end]) - len(rows[end].lstrip()) > len(margin)):
            # A bracket left open reaches no further than the next head.
            if depth > 0 and _HEAD.match(rows[end]) and len(_HEAD.match(rows[end])["margin"]) <= len(margin):
                break
            depth += _depth(rows[end])
            end += 1
        last = end
        while last > k + 1 and not rows[last - 1].strip():
            last -= 1
        block = [r[len(margin) :] if r.startswith(margin) else r.lstrip() for r in rows[k:last]]
        found = entities_of("\n".join(block))
        kind = "class" if m["kind"] == "class" else "method" if parent else "function"
        if found:
            for e in found:
                own = e["type"] != "method"
                out.append(e | dict(line_start=e["line_start"] + k, line_end=e["line_end"] + k, type=kind if own else "method", parent=parent if own else e["parent"]))
        else:
            head = re.sub(r"\s+", " ", rows[k].strip()).rstrip(":")
            out.append(dict(name=m["name"], type=kind, line_start=k + 1, line_end=last, signature=head, raw_code="\n".join(block), docstring=None, parent=parent, dependencies=[]))
            if kind == "class" and parent is None:
                inner = next((r for r in rows[k + 1 : last] if r.strip()), "")
                deeper = inner[: len(inner) - len(inner.lstrip())]
                if len(deeper) > len(margin):
                    out += _blocks(rows[:last], k + 1, deeper, m["name"])
        k = end
    return out


def _depth(row: str) -> int:
    """Brackets that a row leaves open, texts and comments aside."""
    plain = re.sub(r"\"[^\"]*\"|'[^']*'|#.*", "", row)
    return sum(map(plain.count, "([{")) - sum(map(plain.count, ")]}"))


def imports_of(code: str | None) -> list[dict]:
    """Import records anywhere in the code: one a name, level 0 for absolute ones. Code that doesn't parse gives none."""
    tree = _tree(code)
    out = []
    for node in ast.walk(tree) if tree else []:
        if isinstance(node, ast.Import):
            out += [dict(type="import", module=a.name, name=a.name, alias=a.asname, full_name=a.asname or a.name, level=0) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [dict(type="from", module=node.module or "", name=a.name, alias=a.asname, full_name=a.asname or a.name, level=node.level) for a in node.names]
    return out


def _per_file(files: DataFrame, keep: list[str], content: str, find, schema: str) -> DataFrame:
    rows = files.select(*keep, F.col(content).alias("__code"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "__code")
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(*key, *(r[n] for n in names)) for *key, code in b.itertuples(index=False) for r in find(code)]
            yield pd.DataFrame(out, columns=[*keep, *names])

    return rows.mapInPandas(run, f"{kinds}, {schema}")


def entities(files: DataFrame, keep: list[str], content: str = "content", tolerant: bool = False) -> DataFrame:
    """keep columns and one row an entity of each file; tolerant: also of files that don't parse."""
    return _per_file(files, keep, content, tolerant_entities_of if tolerant else entities_of, ENTITY)


def imports(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    return _per_file(files, keep, content, imports_of, IMPORT)


def excluded(path: Column, parts: list[str]) -> Column:
    """Whether a path has one of the parts as a directory or file name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts]))
