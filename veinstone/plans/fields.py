"""A registry of field extractors, record hooks and display fields, so that rules are put in and replaced without patches.

A rule set is a value: `with_field`, `with_hook` and `replaced` give new ones, and two sets can be used side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as S

Extractor = Callable[[DataFrame], Column]
Step = Callable[[Column], Column]


@dataclass(frozen=True)
class Rules:
    """fields: name -> extractor and the steps that change its values; hooks run on whole tables, in order; strategies
    are named functions such as the identifier and the title, which extractors look up when they are applied."""

    fields: dict[str, tuple[Extractor, tuple[Step, ...]]] = field(default_factory=dict)
    hooks: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    strategies: dict[str, Callable[..., Column]] = field(default_factory=lambda: {"identifier": S.ascii_identifier, "title": S.title})

    def with_field(self, name: str, extractor: Extractor | str, *steps: Step) -> "Rules":
        """A field from an extractor or a column's name; of two rules for one field the later one counts."""
        made = (lambda df, c=extractor: F.col(c)) if isinstance(extractor, str) else extractor
        return replace(self, fields={**self.fields, name: (made, steps)})

    def with_hook(self, hook: Callable[[DataFrame], DataFrame]) -> "Rules":
        return replace(self, hooks=(*self.hooks, hook))

    def replaced(self, **strategies: Callable[..., Column]) -> "Rules":
        """Other functions under known names; an unknown name is an error."""
        if unknown := strategies.keys() - self.strategies.keys():
            raise KeyError(f"no strategy {sorted(unknown)}")
        return replace(self, strategies=self.strategies | strategies)

    def apply(self, records: DataFrame) -> DataFrame:
        """The records with all fields, then the hooks' result. Fields see the records' own columns, not each other."""
        columns = {}
        for name, (extractor, steps) in self.fields.items():
            value = extractor(records)
            for step in steps:
                value = step(value)
            columns[name] = value
        out = records.withColumns(columns) if columns else records
        for hook in self.hooks:
            out = hook(out)
        return out


@dataclass(frozen=True)
class Shown:
    """A display field: its label, the value (a column's name or a function), how lists are joined, and where it is shown."""

    label: str
    value: str | Callable[[], Column]
    separator: str = ", "
    compact: bool = False
    only_if: Callable[[], Column] | None = None
    markup: bool = False


def display(docs: DataFrame, shown: list[Shown], compact: bool = False) -> DataFrame:
    """One text column for each field, named by its label; the compact view has the compact ones only. Tags go unless
    the field keeps its markup; a field whose condition does not hold is null."""
    out = []
    for s in shown:
        if compact and not s.compact:
            continue
        c = F.col(s.value) if isinstance(s.value, str) else s.value()
        if docs.select(c.alias("c")).schema["c"].dataType.typeName() == "array":
            c = F.nullif(F.array_join(F.filter(c, lambda v: v != ""), s.separator), F.lit(""))
        c = c if s.markup else S.strip_tags(c.cast("string"))
        out.append((F.when(s.only_if(), c) if s.only_if else c).alias(s.label))
    return docs.select(*(c for c in ("id",) if c in docs.columns), *out)
