"""Statements of Python code that does not parse as a whole.

Posts hold fragments: older syntax, prose between lines, an ellipsis, a bracket that never
closes. Brackets, strings and continuations join physical lines to logical ones, indentation
puts them under their headers, and the largest ranges that parse are kept: a block whose inside
is broken keeps its header and those statements inside that parse; only the broken
statement goes. Every step is linear in the code, once for each level of indentation.
"""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

TOKENS = re.compile(
    r"""\#[^\n]* | \"{3} | '{3} | "(?:\\.|[^"\\\n])*"? | '(?:\\.|[^'\\\n])*'? | [()\[\]{}] | \\\n
    | \n(?=[\ \t]*(?:import|def|class|return|while|try|raise|pass|break|continue|global)\b)""",
    re.X | re.S,
)
PAIRS = {")": "(", "]": "[", "}": "{"}
HEADER = re.compile(r":[ \t]*(?:#[^\n]*)?\Z")
CLAUSE = re.compile(r"(elif|else|except|finally)\b")
#: Deeper code is not read; Python itself refuses it.
DEEPEST = 100

#: Older forms and what stands for them today.
OLDER = (
    (re.compile(r"print[ \t]+(.*?),?[ \t]*\Z", re.S), r"print(\1)"),
    (re.compile(r"exec[ \t]+(.*)\Z", re.S), r"exec(\1)"),
    (re.compile(r"raise[ \t]+([\w.]+)[ \t]*,[ \t]*(.*)\Z", re.S), r"raise \1(\2)"),
    (re.compile(r"except[ \t]+([^:\n]+?)[ \t]*,[ \t]*(\w+)[ \t]*:"), r"except (\1) as \2:"),
)


class Line(NamedTuple):
    """A logical line: its indentation and its physical lines."""

    indent: int
    first: int
    last: int


def parsed(code: str) -> list[ast.stmt] | None:
    try:
        return ast.parse(code).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def joined_lines(code: str) -> list[int]:
    """For each physical line the last one that a bracket, string or backslash ties it to.

    Brackets and triple quotes that nothing closes tie nothing; a line that begins a
    statement no bracket can hold gives all open ones up.
    """
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line_of = 0
    reach = list(range(len(starts)))
    stack: list[tuple[str, int]] = []
    endless: set[str] = set()
    at = 0
    while (found := TOKENS.search(code, at)) is not None:
        token, at = found.group(), found.end()
        while line_of + 1 < len(starts) and starts[line_of + 1] <= found.start():
            line_of += 1
        if token in ('"""', "'''"):
            end = -1 if token in endless else code.find(token, at)
            if end < 0:
                endless.add(token)
                continue
            at, first = end + 3, line_of
            while line_of + 1 < len(starts) and starts[line_of + 1] <= end:
                line_of += 1
            reach[first] = max(reach[first], line_of)
        elif token in "([{":
            stack.append((token, line_of))
        elif token in PAIRS:
            if stack and stack[-1][0] == PAIRS[token]:
                first = stack.pop()[1]
                reach[first] = max(reach[first], line_of)
        elif token == "\\\n":
            reach[line_of] = max(reach[line_of], min(line_of + 1, len(starts) - 1))
        elif token == "\n":
            stack.clear()
    return reach


def logical_lines(code: str) -> tuple[list[str], list[Line]]:
    """(physical lines with blanks for leading tabs, logical lines that hold code)."""
    physical = [re.sub(r"^[ \t]+", lambda m: m.group().expandtabs(8), x) for x in code.split("\n")]
    reach, lines, at = joined_lines("\n".join(physical)), [], 0
    while at < len(physical):
        last = k = at
        while k <= last:
            last = max(last, reach[k])
            k += 1
        bare = physical[at].lstrip(" ")
        if bare and not bare.startswith("#"):
            lines.append(Line(len(physical[at]) - len(bare), at, last))
        at = last + 1
    return physical, lines


class Reader:
    def __init__(self, code: str):
        self.physical, self.lines = logical_lines(code)
        self.inner: list[ast.stmt] = []
        self.failed: set[str] = set()

    def parsed(self, text: str) -> list[ast.stmt] | None:
        """parsed(), which is not tried again on a text that failed."""
        if text in self.failed:
            return None
        tree = parsed(text)
        if tree is None:
            self.failed.add(text)
        return tree

    def text(self, first: Line, last: Line) -> str:
        """The physical lines of a range, moved left by its first line's indentation."""
        cut = first.indent
        rows = self.physical[first.first : last.last + 1]
        return "\n".join(x[min(cut, len(x) - len(x.lstrip(" "))) :] for x in rows)

    def headed(self, line: Line) -> bool:
        return HEADER.search(self.physical[line.last]) is not None

    def units(self, at: int, end: int) -> list[tuple[int, int, int]]:
        """Ranges [a, b) of lines [at, end) and the line of each that may head the others: a
        header, decorators before it, and what is indented below it; or a single line."""
        found = []
        while at < end:
            head = at
            while self.starts(head).startswith("@") and head + 1 < end and self.lines[head + 1].indent == self.lines[at].indent:
                head += 1
            b = head + 1
            if self.headed(self.lines[head]):
                while b < end and self.lines[b].indent > self.lines[head].indent:
                    b += 1
            found.append((at, head, b))
            at = b
        return found

    def starts(self, line: int) -> str:
        return self.physical[self.lines[line].first].lstrip(" ")

    def statements(self, at: int, end: int, depth: int = 0) -> list[ast.stmt]:
        if at >= end or depth > DEEPEST:
            return []
        groups: list[list[tuple[int, int, int]]] = []
        for unit in self.units(at, end):
            if groups and CLAUSE.match(self.starts(unit[0])) and self.lines[groups[-1][0][0]].indent == self.lines[unit[0]].indent:
                groups[-1].append(unit)
            else:
                groups.append([unit])
        found: list[ast.stmt] = []
        for group in groups:
            first = self.lines[group[0][0]]
            whole = self.moved(self.parsed(self.text(first, self.lines[group[-1][2] - 1])), first)
            found += whole if whole is not None else [s for unit in group for s in self.unit(*unit, depth)]
        return found

    @staticmethod
    def moved(tree: list[ast.stmt] | None, line: Line) -> list[ast.stmt] | None:
        """The statements, each with its line number in the whole code; what is inside them keeps
        its own."""
        for statement in tree or ():
            statement.lineno += line.first
        return tree

    def unit(self, a: int, h: int, b: int, depth: int) -> list[ast.stmt]:
        """What is left of a range that may not parse."""
        head = self.lines[a]
        text = self.text(head, self.lines[h])
        if not self.headed(self.lines[h]):
            return next((x for form in (text, *older(text)) if (x := self.moved(self.parsed(form), head)) is not None), [])
        body = self.statements(h + 1, b, depth + 1)
        for form in (text, *older(text)):
            if (tree := self.moved(self.parsed(opened(form)), head)) is not None and len(tree) == 1:
                holder = tree[0].handlers[0] if isinstance(tree[0], ast.Try) and tree[0].handlers else tree[0]
                if body and hasattr(holder, "body"):
                    holder.body = body
                return tree
        self.inner += body
        return []


def older(text: str) -> list[str]:
    return [new for form, now in OLDER if (new := form.sub(now, text, count=1)) != text and form.match(text)]


def opened(header: str) -> str:
    """A header as a statement of its own, with an empty block."""
    clause = CLAUSE.match(header)
    if clause is None:
        tail = "\nfinally:\n pass" if re.match(r"try\b", header) else ""
        return f"{header}\n pass{tail}"
    if clause.group() == "elif":
        return f"{header[2:]}\n pass"
    if clause.group() == "except":
        return f"try:\n pass\n{header}\n pass"
    return "if 1:\n pass"


def statements(code: str) -> tuple[list[ast.stmt], list[ast.stmt]]:
    """(top statements, statements inside blocks whose header is lost)."""
    whole = parsed(code)
    return broken(code) if whole is None else (whole, [])


def broken(code: str) -> tuple[list[ast.stmt], list[ast.stmt]]:
    """The statements of code that is known not to parse."""
    reader = Reader(code)
    return reader.statements(0, len(reader.lines)), reader.inner
