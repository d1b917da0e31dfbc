"""A small language of column specifications, and condition vectors made by it.

``library_size:log1p:zscore`` is a numerical column with transforms; ``batch:onehot``
and ``batch:groupmean(n_genes:log1p, n_counts)`` are categorical ones.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import no_column

TRANSFORMS = ("log1p", "zscore")


@dataclass(frozen=True)
class NumericalSpec:
    source: str
    transforms: tuple[str, ...] = ()


@dataclass(frozen=True)
class CategoricalSpec:
    source: str
    encoding: str
    value_col: str | None = None
    value_transforms: tuple[str, ...] = ()


@dataclass(frozen=True)
class ConditionColumn:
    """One encoded column: where its values stand in the vector, and what they need."""

    name: str
    kind: str
    source: str
    offset: int
    dim: int
    transforms: tuple[str, ...] = ()
    stats: dict[str, float] = field(default_factory=dict)
    encoding: str | None = None
    categories: tuple[str, ...] = ()
    value_col: str | None = None
    value_transforms: tuple[str, ...] = ()
    mean_table: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class ConditionSchema:
    columns: tuple[ConditionColumn, ...]
    n_cond: int
    batch_key: str | None = None

    def save(self, path: str | Path) -> None:
        data = {"condition_columns": [asdict(c) for c in self.columns], "n_cond": self.n_cond, "batch_key": self.batch_key}
        Path(path).write_text(json.dumps(data, indent=2))

    @classmethod
    def load(cls, path: str | Path) -> ConditionSchema:
        data = json.loads(Path(path).read_text())
        for key in ("condition_columns", "n_cond"):
            if key not in data:
                raise ValueError(f"the schema has no {key!r}")
        columns = [{k: tuple(v) if isinstance(v, list) else v for k, v in c.items()} for c in data["condition_columns"]]
        return cls(tuple(ConditionColumn(**c) for c in columns), int(data["n_cond"]), data.get("batch_key"))


def _checked(transforms: list[str]) -> tuple[str, ...]:
    for t in transforms:
        if t not in TRANSFORMS:
            raise ValueError(f"Unknown transform {t!r}; there are {', '.join(TRANSFORMS)}")
    if "log1p" in transforms and "zscore" in transforms and transforms.index("zscore") < transforms.index("log1p"):
        raise ValueError("log1p must come before zscore")
    return tuple(transforms)


def parse_numerical(spec: str) -> NumericalSpec:
    source, *transforms = [p.strip() for p in spec.split(":")]
    return NumericalSpec(source, _checked(transforms))


def parse_categorical(spec: str) -> list[CategoricalSpec]:
    """One specification, or one for each value column of ``groupmean(...)``."""
    source, colon, encoding = (p.strip() for p in spec.partition(":"))
    if not colon:
        raise ValueError(f"no encoding in {spec!r}")
    if encoding == "onehot":
        return [CategoricalSpec(source, "onehot")]
    if encoding.startswith("groupmean(") and encoding.endswith(")"):
        values = [parse_numerical(v) for v in encoding[len("groupmean(") : -1].split(",") if v.strip()]
        return [CategoricalSpec(source, "groupmean", v.source, v.transforms) for v in values]
    raise ValueError(f"Unknown encoding {encoding!r}")


def _transformed(value: Column, transforms: tuple[str, ...], stats: dict[str, float]) -> Column:
    for t in transforms:
        value = F.log1p(value) if t == "log1p" else (value - F.lit(stats["mean"])) / F.lit(stats["std"])
    return value


def _fit(cells: DataFrame, needed: list[tuple[str, tuple[str, ...]]]) -> list[dict[str, float]]:
    """The stats of all transformed columns, in one aggregation."""
    aggs = []
    for k, (source, transforms) in enumerate(needed):
        x = F.col(f"`{source}`").cast("double")
        aggs.append(F.min(x).alias(f"low{k}"))
        y = F.when(x > -1, F.log1p(x)) if "log1p" in transforms else x
        aggs += [F.avg(y).alias(f"mean{k}"), F.stddev_pop(y).alias(f"std{k}")]
    row = cells.agg(*aggs).first() if aggs else None
    out = []
    for k, (source, transforms) in enumerate(needed):
        if "log1p" in transforms and row[f"low{k}"] is not None and row[f"low{k}"] < 0:
            raise ValueError(f"log1p of negative values in {source!r}")
        if "zscore" not in transforms:
            out.append({})
            continue
        if not row[f"std{k}"]:
            raise ValueError(f"the standard deviation of {source!r} is 0")
        out.append({"mean": float(row[f"mean{k}"]), "std": float(row[f"std{k}"])})
    return out


def build_schema(
    cells: DataFrame, numerical: list[NumericalSpec], categorical: list[CategoricalSpec],
    categories: dict[str, list] | None = None, batch_key: str | None = None,
) -> ConditionSchema:
    """Fit the columns: one aggregation for all stats, one for each categorical column.

    Categories are sorted as what they are, then become text; ``categories`` names
    those of a column beyond what its cells have.
    """
    for c in [*[s.source for s in numerical], *[s.source for s in categorical], *[s.value_col for s in categorical if s.value_col]]:
        if c not in cells.columns:
            raise no_column(c, "cells", cells)
    means = [s for s in categorical if s.encoding == "groupmean"]
    stats = _fit(cells, [(s.source, s.transforms) for s in numerical] + [(s.value_col, s.value_transforms) for s in means])
    columns, offset = [], 0
    for s, st in zip(numerical, stats, strict=False):
        columns.append(ConditionColumn("_".join([s.source, *s.transforms]), "numerical", s.source, offset, 1, s.transforms, st))
        offset += 1
    of_mean = dict(zip([id(s) for s in means], stats[len(numerical) :], strict=True))
    for s in categorical:
        if s.encoding == "onehot":
            found = (categories or {}).get(s.source)
            if found is None:
                found = [r[0] for r in cells.select(F.col(f"`{s.source}`")).distinct().collect() if r[0] is not None]
            names = tuple(str(v) for v in sorted(found))
            columns.append(ConditionColumn(f"{s.source}_onehot", "categorical", s.source, offset, len(names), encoding="onehot", categories=names))
            offset += len(names)
        else:
            value = _transformed(F.col(f"`{s.value_col}`").cast("double"), s.value_transforms, of_mean[id(s)])
            table = cells.groupBy(F.col(f"`{s.source}`").cast("string").alias("g")).agg(F.avg(value).alias("m")).collect()
            columns.append(
                ConditionColumn(
                    f"{s.source}_groupmean_{s.value_col}", "categorical", s.source, offset, 1, encoding="groupmean",
                    value_col=s.value_col, value_transforms=s.value_transforms,
                    mean_table={r.g: float(r.m) for r in sorted(table, key=lambda r: str(r.g)) if r.g is not None},
                )
            )
            offset += 1
    return ConditionSchema(tuple(columns), offset, batch_key)


def check_categories(cells: DataFrame, schema: ConditionSchema) -> None:
    """Raise where a categorical column has values that the schema doesn't know."""
    for c in schema.columns:
        if c.kind != "categorical":
            continue
        known = list(c.categories) if c.encoding == "onehot" else list(c.mean_table)
        text = F.coalesce(F.col(f"`{c.source}`").cast("string"), F.lit("None"))
        bad = cells.select(text.alias("v")).where(~F.col("v").isin(known)).distinct().limit(5).collect()
        if bad:
            raise ValueError(f"Unknown categories in {c.source!r}: {sorted(r.v for r in bad)}")


def condition_vector(schema: ConditionSchema) -> Column:
    """The vector of a cell, as one array expression without any join."""
    if not schema.n_cond:
        return F.array().cast("array<float>")
    parts: list[Column] = []
    for c in schema.columns:
        source = F.col(f"`{c.source}`")
        if c.kind == "numerical":
            parts.append(F.array(_transformed(source.cast("double"), c.transforms, c.stats).cast("float")))
        elif c.encoding == "onehot":
            # a constant array that is looked up, so that thousands of categories are no larger a plan
            place = F.coalesce(F.array_position(F.lit(list(c.categories)), source.cast("string")), F.lit(0)) if c.categories else F.lit(0)
            parts.append(_one_of(place, len(c.categories)))
        else:
            table = F.map_from_arrays(F.lit(list(c.mean_table)), F.lit([float(v) for v in c.mean_table.values()])) if c.mean_table else None
            mean = F.lit(None) if table is None else F.try_element_at(table, source.cast("string"))
            parts.append(F.array(mean.cast("float")))
    return F.concat(*parts)


def _one_of(place: Column, n: int) -> Column:
    """``n`` zeros, with a one at ``place`` (from 1; 0: nowhere)."""
    if not n:
        return F.array().cast("array<float>")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i == place).cast("float"))


def label_index(cells: DataFrame, label: str) -> DataFrame:
    """(label, idx): the values of a column in their order, as text."""
    values = cells.select(F.col(f"`{label}`").alias("v")).where("v is not null").distinct()
    idx = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("v")) - 1
    return values.select(F.col("v").cast("string").alias("label"), idx.cast("long").alias("idx"))
