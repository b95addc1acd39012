"""Definitions and calls of a Python file as flat rows, through the standard ``ast`` module.

Only the walk happens here; keys, qualified names and signatures are Spark expressions on the rows. A row holds what names the definition
around it, so no rows have to meet.
"""

import ast
from inspect import cleandoc
from itertools import accumulate

import pandas as pd
import pyarrow as pa

# ``scope`` names the definitions around a row, the innermost last; that one begins in ``parent_line``
SCHEMA = ("path string, what string, name string, scope string, parent_line int, receiver string, bases string, "
          "docstring string, start_byte int, end_byte int, start_line int, end_line int, body_start_byte int, head string, "
          "parse_error int")
FIELDS = [(name, pa.string() if kind == "string" else pa.int32()) for name, kind in (field.split() for field in SCHEMA.split(", "))]
ROWS = 2_000   # rows of a frame: what a worker holds does not follow the number of files in a batch
DEFINITIONS = frozenset((ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))
BARE = {"ctx", "op", "ops", "id", "attr", "arg", "type_comment"}   # fields without definitions or calls in them
INSIDE = {kind: fields for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST) and kind is not ast.Constant
          if (fields := tuple(f for f in kind._fields if f not in BARE))}


def _tail_name(node):
    kind = node.__class__
    return node.id if kind is ast.Name else node.attr if kind is ast.Attribute else None


def _docstring(node):
    """As ``ast.get_docstring``; most are of one line, with nothing to clean."""
    first = node.body[0]
    if first.__class__ is not ast.Expr or first.value.__class__ is not ast.Constant or first.value.value.__class__ is not str:
        return None
    doc = first.value.value
    return cleandoc(doc) if "\n" in doc or "\t" in doc or doc[:1] == " " else doc


def _rows(path, content):
    text = content.decode("utf-8", errors="replace")
    starts = [0, *accumulate(map(len, content.splitlines(keepends=True)))]   # bytes before each line
    todo = [(ast.parse(text), "", None)]   # definitions that are still to be looked into
    while todo:
        around, scope, line = todo.pop()
        inside = [getattr(around, field) for field in INSIDE[around.__class__]]
        while inside:
            node = inside.pop()
            kind = node.__class__
            if kind is list:
                inside += node
            elif kind in DEFINITIONS:
                start, first = starts[node.lineno - 1] + node.col_offset, node.body[0]
                doc = _docstring(node)
                body = node.body[1] if doc and len(node.body) > 1 else first
                is_class = kind is ast.ClassDef
                bases = ",".join(filter(None, map(_tail_name, node.bases))) if is_class else ""
                head = None if is_class else content[start:starts[first.lineno - 1] + first.col_offset].decode("utf-8", errors="replace")
                yield (path, "class" if is_class else "def", node.name, scope, line, None, bases, doc, start,
                       starts[node.end_lineno - 1] + node.end_col_offset, node.lineno, node.end_lineno, starts[body.lineno - 1] + body.col_offset, head, 0)
                todo.append((node, f"{scope}.{node.name}" if scope else node.name, node.lineno))
            elif kind in INSIDE:
                if kind is ast.Call and (name := _tail_name(node.func)):
                    receiver = _tail_name(node.func.value) if node.func.__class__ is ast.Attribute else None
                    yield (path, "call", name, scope, line, receiver, None, None, starts[node.lineno - 1] + node.col_offset,
                           starts[node.end_lineno - 1] + node.end_col_offset, node.lineno, node.end_lineno, None, None, 0)
                for field in INSIDE[kind]:
                    inside.append(getattr(node, field))


def read_nodes(batches):
    """mapInPandas body: (path, content) to node rows, about ``ROWS`` at a time; a file that does not parse gives one error row."""
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                rows.extend(_rows(path, bytes(content)))
            except (SyntaxError, ValueError, RecursionError):
                rows.append((path, "error", *[None] * (len(FIELDS) - 3), 1))
            if len(rows) >= ROWS:
                yield _frame(rows)
                rows = []
        yield _frame(rows)


def _frame(rows):
    """Columns that Arrow holds already, so that nothing is converted on the way out."""
    columns = zip(*rows) if rows else [()] * len(FIELDS)
    return pd.DataFrame({name: pd.array(pa.array(values, kind), dtype=pd.ArrowDtype(kind)) for (name, kind), values in zip(FIELDS, columns)})
