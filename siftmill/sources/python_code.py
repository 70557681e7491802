"""Facts of Python source files, one row per fact.

Parsing is all that happens per file in Python. A fact is an import, a class,
a hint or a place that can carry one, with its place in the walk through the
file (``seq``). Resolving names, normalising types, offsets and merging are
table operations on the facts (``operators.hints``).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from siftmill.schemas import Category

_TEXT, _WHOLE, _FLAG = T.StringType(), T.LongType(), T.BooleanType()

FACTS = (
    T.StructType()
    .add("project", _TEXT)
    .add("path", _TEXT)
    .add("seq", _WHOLE)
    .add("kind", _TEXT)
    .add("name", _TEXT)
    .add("text", _TEXT)
    .add("line", _WHOLE)
    .add("col", _WHOLE)
    .add("class", _TEXT)
    .add("function", _TEXT)
    .add("category", _WHOLE)
    .add("target", _TEXT)
    .add("scope", _TEXT)
    .add("enclosing", T.ArrayType(_TEXT))
    .add("declared_global", _FLAG)
    .add("has_hint", _FLAG)
    .add("has_value", _FLAG)
    .add("target_count", _WHOLE)
    .add("statement", _WHOLE)
)
_FIELDS = [f.name for f in FACTS.fields[2:]]

# Files handed to Python at once; a file may be large.
FILES_PER_BATCH = 64


class UnsupportedHint(ValueError):
    pass


def hint_text(node: ast.expr) -> str:
    """Text of an annotation in the subset of expressions that make a type."""
    if isinstance(node, ast.BinOp):
        return f"{hint_text(node.left)} | {hint_text(node.right)}"
    if isinstance(node, ast.Subscript):
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) and node.slice.elts else [node.slice]
        return f"{hint_text(node.value)}[{', '.join(map(hint_text, inner))}]"
    if isinstance(node, ast.Attribute) and isinstance(node.value, (ast.Name, ast.Attribute)):
        return f"{hint_text(node.value)}.{node.attr}"
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.List):
        return f"[{', '.join(map(hint_text, node.elts))}]"
    if isinstance(node, ast.Starred):
        return hint_text(node.value)
    if isinstance(node, ast.Constant) and (node.value is None or node.value is ... or isinstance(node.value, bool)):
        return "..." if node.value is ... else str(node.value)
    raise UnsupportedHint(f"no type: {type(node).__name__} in line {node.lineno}")


class _Walk(ast.NodeVisitor):
    """Collects the facts of one file in source order."""

    def __init__(self, content: str) -> None:
        self.facts: list[dict] = []
        self.scopes: list[ast.AST] = []
        self.globals: dict[ast.AST, set[str]] = {}
        self.statements = 0
        self._describe_scope()
        self.lines = re.split(r"\r\n|\r|\n", content)
        self.visit(ast.parse(content))

    def generic_visit(self, node: ast.AST) -> None:
        """Go through the statements of a block; expressions hold no facts."""
        for block in ("body", "handlers", "orelse", "finalbody", "cases"):
            for statement in getattr(node, block, ()):
                self.visit(statement)

    def _enter(self, node: ast.AST) -> None:
        self.scopes.append(node)
        self._describe_scope()

    def _leave(self) -> None:
        self.scopes.pop()
        self._describe_scope()

    def _describe_scope(self) -> None:
        inner = list(reversed(self.scopes))
        classes = [s.name for s in inner if isinstance(s, ast.ClassDef)]
        functions = [s.name for s in inner if not isinstance(s, ast.ClassDef)]
        kind = "module" if not inner else "class" if isinstance(inner[0], ast.ClassDef) else "function"
        self.place = {
            "class": classes[0] if classes else None,
            "function": functions[0] if functions else None,
            "scope": kind,
            "enclosing": classes,
        }

    def add(self, kind: str, node: ast.AST, **fields) -> None:
        self.facts.append({"seq": len(self.facts), "kind": kind, "line": node.lineno, **self.place, **fields})

    def hint(self, node: ast.AST, annotation: ast.expr | None, **fields) -> None:
        try:
            text = None if annotation is None else hint_text(annotation)
            self.add("hint", node, text=text, **fields)
        except UnsupportedHint as problem:
            self.add("error", node, **{**fields, "text": str(problem)})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module is None:
            self.add("error", node, text=f"import without module in line {node.lineno}")
            return
        for alias in node.names:
            if alias.name != "*":
                self.add("from", node, name=alias.name, text=node.module)

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            if alias.asname:
                self.add("alias", node, name=alias.asname, text=alias.name)

    def visit_Global(self, node: ast.Global) -> None:
        if self.scopes:
            self.globals.setdefault(self.scopes[-1], set()).update(node.names)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("class", node, name=node.name)
        self._enter(node)
        self.generic_visit(node)
        self._leave()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self._enter(node)
        given = node.args
        parameters = [*given.posonlyargs, *given.args, given.vararg, *given.kwonlyargs, given.kwarg]
        for parameter in filter(None, parameters):
            here = {"name": parameter.arg, "category": int(Category.FUNCTION_PARAMETER)}
            if parameter.annotation is not None:
                self.hint(parameter, parameter.annotation, **here)
            self._site("param", parameter, has_hint=parameter.annotation is not None, **here)
        here = {"name": node.name, "category": int(Category.FUNCTION_RETURN)}
        self.hint(node, node.returns, **here)
        self._site("return", node, has_hint=node.returns is not None, **here)
        self.generic_visit(node)
        self._leave()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        target, category = node.target, None
        if isinstance(target, ast.Attribute):
            category, name = int(Category.CLASS_MEMBER), target.attr
        elif isinstance(target, ast.Name):
            local = Category.LOCAL_VARIABLE if self.scopes else Category.GLOBAL_VARIABLE
            category, name = int(local), target.id
        else:
            name = None
        before = self.lines[node.lineno - 1].encode()[: node.col_offset]
        self.hint(node, node.annotation, name=name, category=category, col=len(before.decode()))
        if name is not None:
            self._assignment("annassign", node, [target], node.value is not None)

    def visit_Assign(self, node: ast.Assign) -> None:
        self._assignment("assign", node, node.targets, True)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self._assignment("augassign", node, [node.target], True)

    def _assignment(self, kind: str, node: ast.AST, targets: list[ast.expr], has_value: bool) -> None:
        names, attributes, pending = [], [], list(reversed(targets))
        while pending:
            part = pending.pop()
            if isinstance(part, ast.Name):
                names.append(("name", part.id))
            elif isinstance(part, ast.Attribute):
                attributes.append(("attr", part.attr))
            else:
                pending.extend(reversed(list(ast.iter_child_nodes(part))))
        declared = set().union(*(self.globals.get(scope, ()) for scope in self.scopes))
        found = [*attributes, *names]
        for target, name in found:
            self._site(
                kind,
                node,
                name=name,
                target=target,
                declared_global=target == "name" and name in declared,
                has_hint=kind == "annassign",
                has_value=has_value,
                target_count=len(found),
                statement=self.statements,
            )
        self.statements += 1

    def _site(self, kind: str, node: ast.AST, **fields) -> None:
        fields = {"declared_global": False, "has_value": False, "target_count": 1, **fields}
        if "statement" not in fields:
            fields["statement"] = self.statements
            self.statements += 1
        self.add(f"site:{kind}", node, **fields)


def file_facts(content: str) -> list[dict]:
    """Facts of one file; a file that is no Python gives one error fact."""
    try:
        return _Walk(content).facts
    except (SyntaxError, ValueError, RecursionError) as problem:
        return [{"seq": 0, "kind": "error", "text": f"{type(problem).__name__}: {problem}"}]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), FILES_PER_BATCH):
            rows = [
                (project, path, *[fact.get(field) for field in _FIELDS])
                for project, path, content in batch.iloc[start : start + FILES_PER_BATCH].itertuples(index=False)
                for fact in file_facts(content or "")
            ]
            yield pd.DataFrame(rows, columns=FACTS.fieldNames(), dtype=object)


def source_facts(sources: DataFrame, spread: bool = False) -> DataFrame:
    """Facts of a source table (project, path, content), one file per row.

    Parsing is slow next to reading. ``spread`` deals the files out to as many
    tasks as the session uses for shuffles, for tables whose few partitions are
    small in bytes but not in work.
    """
    files = sources.select("project", "path", "content")
    if spread:
        files = files.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project", "path")
    return files.mapInPandas(_rows, FACTS)


def content_facts(sources: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Facts of every different content of a source table once; ``path`` is the content's SHA-256, project is null.

    Equal contents are combined before they are shuffled, by digest, which is
    the only time a content moves; ``wanted`` (path) restricts the digests.
    Files without content are left out.
    """
    contents = sources.where(F.col("content").isNotNull()).select(F.sha2("content", 256).alias("path"), "content")
    if wanted is not None:
        contents = contents.join(wanted, "path", "left_semi")
    single = contents.groupBy("path").agg(F.first("content").alias("content"))
    return source_facts(single.select(F.lit(None).cast("string").alias("project"), "path", "content"))


def fact_errors(facts: DataFrame, *others: str) -> DataFrame:
    """What could not be read: whole files and single hints."""
    return facts.where(F.col("kind") == "error").select(
        *others, "project", F.col("path").alias("Filename"), "line", F.col("text").alias("error")
    )
