"""Python code inside posts: prompts, imports, assignments, names.

The standard `ast` reads what parses, and of what does not the statements that do (islands).
Both run in Arrow UDFs over arrays of code blocks.
"""

from __future__ import annotations

import ast
import builtins
import keyword
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.rows import by_rows
from loam.functions.text import CODE_WORDS
from loam.operators import islands

PROMPT = re.compile(r"In\s*\[\d*\]:(.*)|(Out\s*\[\d*\]:)|\s*>>>(.*)|\s*\.\.\.(.*)", re.S)
IMPORTS = "array<struct<alias:string,module:string,ord:int>>"
ASSIGNS = "array<struct<variable:string,source:string,index:int,ord:int>>"
NAMES = "struct<identifiers:array<string>,assigned:array<string>,parameters:array<string>,loop_targets:array<string>>"
#: The same as Arrow has them.
IMPORTS_ARROW = pa.list_(pa.struct([("alias", pa.string()), ("module", pa.string()), ("ord", pa.int32())]))
ASSIGNS_ARROW = pa.list_(pa.struct([("variable", pa.string()), ("source", pa.string()), ("index", pa.int32()), ("ord", pa.int32())]))
NAMES_ARROW = pa.struct([(n, pa.list_(pa.string())) for n in ("identifiers", "assigned", "parameters", "loop_targets")])
#: Built-in functions whose names don't count as a post's own.
BUILTINS = frozenset(n for n in dir(builtins) if n[0].islower() and n not in ("copyright", "credits", "exit", "license", "quit", "aiter", "anext")) | {"__import__"}
FOREIGN = BUILTINS | set(keyword.kwlist)
#: Top statements, and those inside blocks whose header is lost.
Read = tuple[list[ast.stmt], list[ast.stmt]]


def without_prompts(code: str | None) -> str:
    """The input lines of an interactive session; plain code loses comments and blank lines."""
    kept: list[str] = []
    mode, session = "plain", False
    for line in (code or "").split("\n"):
        found = PROMPT.match(line)
        cell, out, shell, more = found.groups() if found else (None,) * 4
        if cell is not None:
            mode, session = "cell", True
            kept.append(cell.strip())
        elif out is not None:
            mode = "out"
        elif shell is not None:
            mode, session = "shell", True
            kept.append(shell.strip())
        elif mode == "cell":
            kept.append(line.strip())
        elif mode == "shell":
            if more is None:
                mode = "out"
            else:
                kept.append(more.strip())
        elif not session and more is None:
            kept.append(re.split(r"\s*#", line)[0].rstrip())
    return "\n".join(x for x in kept if x)


def _walk(read: Read) -> list[ast.AST]:
    """All nodes, each before those inside it, in the order of the code; without the marks of
    loading and storing."""
    top, inner = read
    stack: list[ast.AST] = sorted(top + inner, key=lambda x: -x.lineno) if inner else top[::-1]
    found = []
    while stack:
        node = stack.pop()
        found.append(node)
        at = len(stack)
        for name in node._fields:
            value = getattr(node, name, None)
            if isinstance(value, list):
                stack += [x for x in value if isinstance(x, ast.AST)]
            elif name != "ctx" and isinstance(value, ast.AST):
                stack.append(value)
        stack[at:] = stack[at:][::-1]
    return found


def _shown(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else ast.unparse(node)


def _add_imports(found: dict, read: Read, nodes: list[ast.AST] | None = None) -> None:
    stars, own = [], set()
    for node in read[0]:
        if isinstance(node, ast.Import):
            for name in node.names:
                found[name.asname or name.name, name.name] = None
                own.update([name.asname] if name.asname else [])
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for name in node.names:
                if name.name == "*":
                    stars.append(module)
                else:
                    found[name.asname or name.name, f"{module}.{name.name}"] = None
                    own.add(name.asname or name.name)
    if stars:
        nodes = _walk(read) if nodes is None else nodes
        own |= {n.name for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
        calls = dict.fromkeys(n.func.id for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name))
        found |= {(call, f"{module}.{call}"): None for module in dict.fromkeys(stars) for call in calls if call not in own}


def _outside_parentheses(text: str) -> str:
    return re.sub(r"\([^)]*(?:\)|\Z)", "", text).replace(")", "")


def _add_assignments(found: dict, nodes: list[ast.AST]) -> None:
    for node in nodes:
        if not isinstance(node, (ast.Assign, ast.AnnAssign)) or not isinstance(node.value, ast.Call):
            continue
        targets, call = node.targets if isinstance(node, ast.Assign) else [node.target], node.value
        if isinstance(call.func, ast.Attribute):
            source = f"{_outside_parentheses(_shown(call.func.value))}.{call.func.attr}"
        elif isinstance(call.func, ast.Name):
            source = call.func.id
        else:
            continue
        for target in targets:
            parts = target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target]
            for k, part in enumerate(parts):
                found[_shown(part), source, k] = None


def everything(blocks: list[str] | None, names: bool = True) -> dict:
    """imports, assigns and (if asked for) the names of each block, in one reading.

    imports: (alias, module) of top-level imports, a star giving each call that nothing else
    defines or imports. assigns: variables assigned from calls, with the called name and the
    place in a multiple target."""
    imported: dict[tuple[str, str], None] = {}
    assigned: dict[tuple[str, str, int], None] = {}
    named = []
    for block in blocks if blocks is not None else ():
        plain = without_prompts(block)
        read = islands.statements(plain)
        nodes = _walk(read)
        _add_imports(imported, read, nodes)
        _add_assignments(assigned, nodes)
        if names:
            named.append(names_of_code(block, nodes if plain == block else None))
    return {
        "imports": [{"alias": a, "module": m, "ord": k} for k, (a, m) in enumerate(imported)],
        "assigns": [{"variable": v, "source": s, "index": i, "ord": k} for k, (v, s, i) in enumerate(assigned)],
        "names": named,
    }


def imports(blocks: list[str] | None) -> list[dict]:
    """The imports of everything() alone."""
    found: dict[tuple[str, str], None] = {}
    for block in blocks if blocks is not None else ():
        _add_imports(found, islands.statements(without_prompts(block)))
    return [{"alias": a, "module": m, "ord": k} for k, (a, m) in enumerate(found)]


def assignments(blocks: list[str] | None) -> list[dict]:
    """The assigns of everything() alone."""
    found: dict[tuple[str, str, int], None] = {}
    for block in blocks if blocks is not None else ():
        _add_assignments(found, _walk(islands.statements(without_prompts(block))))
    return [{"variable": v, "source": s, "index": i, "ord": k} for k, (v, s, i) in enumerate(found)]


def _snippet_terms(code: str) -> list[str]:
    number = re.compile(r"\d+(\.\d+)?|\d{4}-\d{2}-\d{2}")
    return list(dict.fromkeys(t for t in code.split() if not number.fullmatch(t)))


OWN = re.compile(r"[a-zA-Z0-9_]+")
CODE_WORD = re.compile(r"\b(?:" + "|".join(map(re.escape, CODE_WORDS)) + r")\b")


def names_of_code(code: str | None, nodes: list[ast.AST] | None = None) -> dict:
    """Identifiers, assigned variables, parameters and tuple targets of loops; for text that
    neither parses nor has a word of code, its tokens count as the first two. nodes: all of
    the code's, where they are known."""
    code = code or ""
    own = lambda names: [n for n in dict.fromkeys(names) if OWN.fullmatch(n) and not n.isdigit()]
    if nodes is None or not CODE_WORD.search(code):
        whole = islands.parsed(code)
        if whole is None and not CODE_WORD.search(code):
            plain = own(_snippet_terms(code))
            return {"identifiers": plain, "assigned": plain, "parameters": [], "loop_targets": []}
        nodes = _walk(islands.broken(code) if whole is None else (whole, []))
    identifiers, assigned, parameters, targets = [], [], [], []
    for node in nodes:
        kind = type(node)
        if kind is ast.Name:
            identifiers.append(node.id)
        elif kind is ast.Attribute:
            identifiers.append(node.attr)
        elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            identifiers.append(node.name)
            plain = node.args.posonlyargs + node.args.args
            plain = plain[: len(plain) - len(node.args.defaults)]
            parameters += [a.arg for a in plain if a.annotation is None]
            identifiers += [a.arg for a in plain]
        elif kind is ast.For or kind is ast.AsyncFor:
            targets += [t.id for t in node.target.elts if isinstance(t, ast.Name)] if isinstance(node.target, ast.Tuple) else []
        elif kind is ast.Assign:
            for target in node.targets:
                for part in target.elts if isinstance(target, ast.Tuple) else [target]:
                    assigned.append(_shown(part))
                    if isinstance(part, ast.Subscript) and isinstance(part.value, ast.Name):
                        assigned.append(part.value.id)
    keep = lambda names, less=(): own(n for n in names if n not in FOREIGN and n not in less)
    return {"identifiers": keep(identifiers, set(targets)), "assigned": keep(assigned), "parameters": keep(parameters), "loop_targets": own(targets)}


def cleaned(code) -> Column:
    def of_rows(rows: pd.Series) -> pd.Series:
        return rows.map(without_prompts)

    return F.pandas_udf(of_rows, "string")(code)


def names(code) -> Column:
    return by_rows(names_of_code, NAMES, NAMES_ARROW, code, weight=_entries)


def _entries(found: dict) -> int:
    return sum(_entries(x) if isinstance(x, dict) else len(x) + sum(_entries(y) for y in x if isinstance(y, dict)) for x in found.values() if isinstance(x, (dict, list)))


def read(posts: DataFrame, key: str, blocks: str = "code_blocks", names: bool = False) -> DataFrame:
    """key, code: what everything() finds in a post's blocks, each read once for all of it."""
    ddl = f"struct<imports:{IMPORTS},assigns:{ASSIGNS},names:array<{NAMES}>>"
    kind = pa.struct([("imports", IMPORTS_ARROW), ("assigns", ASSIGNS_ARROW), ("names", pa.list_(NAMES_ARROW))])
    return posts.select(key, by_rows(lambda x: everything(x, names), ddl, kind, blocks, weight=_entries).alias("code"))


def import_rows(posts: DataFrame, key: str, blocks: str = "code_blocks") -> DataFrame:
    """key, alias, module, ord."""
    return _rows(imports, IMPORTS, IMPORTS_ARROW, posts, key, blocks)


def assign_rows(posts: DataFrame, key: str, blocks: str = "code_blocks") -> DataFrame:
    """key, variable, source, index, ord."""
    return _rows(assignments, ASSIGNS, ASSIGNS_ARROW, posts, key, blocks)


def _rows(function: Callable, ddl: str, kind: pa.DataType, posts: DataFrame, key: str, blocks: str) -> DataFrame:
    return posts.select(key, F.explode(by_rows(function, ddl, kind, blocks)).alias("i")).select(key, "i.*")


def alias_map(imports_: DataFrame, key: str) -> DataFrame:
    """key, alias and its distinct modules in order of appearance."""
    first = imports_.groupBy(key, "alias", "module").agg(F.min("ord").alias("ord"))
    modules = F.transform(F.array_sort(F.collect_list(F.struct("ord", "module"))), lambda x: x["module"])
    return first.groupBy(key, "alias").agg(modules.alias("modules"))
