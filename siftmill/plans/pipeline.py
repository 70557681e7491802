"""Named unifiers, chains of them, and their configuration."""

from __future__ import annotations

import inspect
import tomllib
import typing
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import PurePath

from pyspark.sql import DataFrame

from siftmill.operators import filters, reduce as reducers
from siftmill.schemas import WEIGHT
from siftmill.session import written

Unifier = Callable[..., DataFrame]

_UNIFIERS: dict[str, Unifier] = {}

# Unifiers that give the same rows whether duplicates come one by one or as a
# multiplicity, and unifiers after which no duplicates are left.
_KEEP_WEIGHTS = {"drop_test", "drop_min_threshold", "drop_mult_var"}
_LEAVE_DISTINCT = {"dedup", "keep_only_first", "unify_subty", "union"}
_COLLAPSE_WEIGHTS = _LEAVE_DISTINCT - {"union"}
# Unifiers that join what they found out about a site back to its rows.
_READ_AGAIN = {"drop_min_threshold", "drop_mult_var", "unify_subty", "union"}


def unifier(kind: str) -> Callable[[Unifier], Unifier]:
    """Register a function ``(df, **parameters) -> df`` under a kind."""

    def register(function: Unifier) -> Unifier:
        _UNIFIERS[kind] = function
        return function

    return register


def lookup(kind: str) -> Unifier:
    if kind not in _UNIFIERS:
        raise LookupError(f"unknown unifier: {kind}")
    return _UNIFIERS[kind]


@unifier("dedup")
def _dedup(df: DataFrame) -> DataFrame:
    return df.drop(WEIGHT) if WEIGHT in df.columns else reducers.dedup(df)


@unifier("drop_test")
def _drop_test(df: DataFrame, *, test_name_pat: str) -> DataFrame:
    return filters.drop_test_functions(df, test_name_pat)


@unifier("drop_min_threshold")
def _drop_min_threshold(df: DataFrame, *, min_threshold: float = reducers.MIN_THRESHOLD) -> DataFrame:
    return reducers.drop_min_threshold(df, min_threshold)


@unifier("drop_mult_var")
def _drop_mult_var(
    df: DataFrame,
    *,
    min_amount_types_to_drop: int = reducers.MIN_AMOUNT_TYPES_TO_DROP,
    count_across_modules: bool = False,
) -> DataFrame:
    return reducers.drop_mult_var(df, min_amount_types_to_drop, count_across_modules=count_across_modules)


@unifier("keep_only_first")
def _keep_only_first(df: DataFrame) -> DataFrame:
    return reducers.keep_only_first(df)


@unifier("union")
def _union(df: DataFrame, *, distinct: bool = False, include_file: bool = False) -> DataFrame:
    return reducers.union(df, distinct, include_file)


@unifier("unify_subty")
def _unify_subty(
    df: DataFrame,
    hierarchy: DataFrame,
    *,
    only_unify_if_base_was_traced: bool = False,
    include_file: bool = False,
    on_unknown: str = "error",
) -> DataFrame:
    return reducers.unify_subtypes(df, hierarchy, only_unify_if_base_was_traced, include_file, on_unknown)


def _parameters(function: Unifier) -> dict[str, inspect.Parameter]:
    """Parameters a configuration may set, by name."""
    named = list(inspect.signature(function).parameters.values())[1:]
    return {p.name: p for p in named if p.name != "hierarchy"}


def _needs_hierarchy(function: Unifier) -> bool:
    return "hierarchy" in inspect.signature(function).parameters


@dataclass(frozen=True)
class Step:
    """One unifier with its parameters, checked against what the unifier takes."""

    kind: str
    parameters: Mapping[str, object] = field(default_factory=dict)
    name: str | None = None

    def __post_init__(self) -> None:
        function = lookup(self.kind)
        known = _parameters(function)
        for key in self.parameters:
            if key not in known:
                raise ValueError(f"unifier {self.name or self.kind}: unknown key {key}")
        for key, parameter in known.items():
            if key not in self.parameters and parameter.default is inspect.Parameter.empty:
                if parameter.kind is not inspect.Parameter.VAR_KEYWORD:
                    raise ValueError(f"unifier {self.name or self.kind}: {key} is missing")
        hints = typing.get_type_hints(function)
        for key, value in self.parameters.items():
            wanted = hints.get(key)
            accepted = (int, float) if wanted is float else wanted
            if wanted in (bool, int, float, str):
                is_wrong_bool = isinstance(value, bool) and wanted is not bool
                if is_wrong_bool or not isinstance(value, accepted):
                    raise ValueError(f"unifier {self.name or self.kind}: {key} must be {wanted.__name__}")

    def effective(self) -> dict[str, object]:
        """Parameters including defaults."""
        defaults = {
            k: p.default for k, p in _parameters(lookup(self.kind)).items() if p.default is not inspect.Parameter.empty
        }
        return {**defaults, **self.parameters}

    def apply(self, df: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
        function = lookup(self.kind)
        if not _needs_hierarchy(function):
            return function(df, **self.parameters)
        if hierarchy is None:
            raise ValueError(f"unifier {self.name or self.kind} needs a type hierarchy")
        return function(df, hierarchy, **self.parameters)


@dataclass
class Chain:
    """Unifiers applied one after the other, as one lazy plan unless asked to write steps."""

    steps: list[Step] = field(default_factory=list)

    def append(self, kind: str, **parameters: object) -> Chain:
        self.steps.append(Step(kind, parameters))
        return self

    def __call__(self, df: DataFrame, hierarchy: DataFrame | None = None, compacted: bool = True, written_steps: bool = False) -> DataFrame:
        """Apply the steps. ``compacted=False`` applies them just as they stand.

        Otherwise duplicates are brought to multiplicities as soon as that
        changes nothing, and a ``dedup`` of distinct rows is left out.

        With ``written_steps``, compacted rows are a written table wherever a
        step reads them more than once: the observations are scanned once,
        however long the chain is, and building the chain runs these steps.
        """
        if not compacted:
            return reduce(lambda frame, step: step.apply(frame, hierarchy), self.steps, df)
        distinct = False
        for place, step in enumerate(self.steps):
            if not distinct and WEIGHT not in df.columns and self._may_compact(place):
                df = reducers.compact(df)
            if step.kind == "dedup" and distinct:
                continue
            if written_steps and step.kind in _READ_AGAIN and (distinct or WEIGHT in df.columns):
                df = written(df, f"chain-{place}")
            df = step.apply(df, hierarchy)
            distinct = step.kind in _LEAVE_DISTINCT or (distinct and step.kind in _KEEP_WEIGHTS)
        return df

    def _may_compact(self, place: int) -> bool:
        if self.steps[place].kind == "drop_test":
            return False
        for step in self.steps[place:]:
            if step.kind in _COLLAPSE_WEIGHTS:
                return True
            if step.kind not in _KEEP_WEIGHTS:
                return False
        return False


@dataclass(frozen=True)
class ProjectSettings:
    project: str
    proj_path: str
    stdlib_path: str
    venv_path: str
    benchmark_performance: bool = False

    def __post_init__(self) -> None:
        for name in ("venv_path", "stdlib_path"):
            if PurePath(getattr(self, name)).is_relative_to(PurePath(self.proj_path)):
                raise ValueError(f"{name} may not lie inside the project")


@dataclass(frozen=True)
class Configuration:
    """Unifiers by name, and optionally the settings of the project."""

    unifiers: Mapping[str, Step]
    settings: ProjectSettings | None = None

    @classmethod
    def from_records(cls, records: Iterable[Mapping[str, object]], settings: ProjectSettings | None = None):
        steps: dict[str, Step] = {}
        for record in records:
            rest = dict(record)
            try:
                name, kind = rest.pop("name"), rest.pop("kind")
            except KeyError as missing:
                raise ValueError(f"a unifier needs {missing}") from None
            steps[name] = Step(kind, rest, name)
        return cls(steps, settings)

    @classmethod
    def from_toml(cls, text: str, section: str = "project") -> Configuration:
        """Read ``[[unifier]]`` tables and the settings in ``[section]``."""
        data = tomllib.loads(text)
        unknown = set(data) - {"unifier", section}
        if unknown:
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        settings = None
        if section in data:
            try:
                settings = ProjectSettings(**data[section])
            except TypeError as problem:
                raise ValueError(str(problem)) from None
        return cls.from_records(data.get("unifier", []), settings)

    def chain(self, names: Sequence[str] | None = None) -> Chain:
        """Chain of the named unifiers in the order given, of all without names."""
        if names is None:
            return Chain(list(self.unifiers.values()))
        missing = [name for name in names if name not in self.unifiers]
        if missing:
            raise LookupError(f"no unifier of this name: {missing}")
        return Chain([self.unifiers[name] for name in names])
