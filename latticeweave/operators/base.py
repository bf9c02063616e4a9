"""What operators share: validated configuration, species channels, dense rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, InputError, UnsupportedPeriodicityError


def require(ok: bool, message: str, path: str) -> None:
    if not ok:
        raise ConfigurationError(message, path)


def type_index(z: Column, species: tuple[int, ...]) -> Column:
    """Index of an atomic number in the declared order; undeclared numbers fail."""
    found = F.array_position(F.array(*[F.lit(s) for s in species]), z)
    return F.when(found > 0, found - 1).otherwise(F.raise_error(F.concat(F.lit("undeclared atomic number "), z.cast("string")))).cast("int")


def cosine_cutoff(r: Column, cutoff: float) -> Column:
    import math

    return 0.5 * (F.cos(r * (math.pi / cutoff)) + 1)


@dataclass(frozen=True)
class Operator:
    """plan() gives long rows (keys, feature, value), zeros left out; compute() gives (keys, features array)."""

    #: structure, atom or pair
    level = "atom"
    periodic_only = False

    @property
    def width(self) -> int:
        return len(self.labels())

    def labels(self) -> list[str]:
        raise NotImplementedError

    def plan(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        raise NotImplementedError

    def configuration(self) -> dict:
        return {"schema_version": 1, "descriptor": type(self).__name__, "parameters": asdict(self)}

    def check(self, structures: DataFrame) -> None:
        if self.periodic_only and structures.where(~F.col("periodic")).limit(1).count():
            raise UnsupportedPeriodicityError(f"{type(self).__name__} takes periodic structures only", "structures.periodic")

    def compute(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        self.check(structures)
        keys = ["structure_id"] if self.level == "structure" else ["structure_id", "atom_index"]
        every = structures.select("structure_id") if self.level == "structure" else atoms.select(*keys)
        cells = self.plan(structures, atoms).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda k: F.coalesce(F.element_at(F.col("m"), k), F.lit(0.0)))
        return every.join(cells, keys, "left").select(*keys, dense.alias("features"))

    def sparse(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """compute()'s rows with the positions and values of what is not zero, positions ascending."""
        cells = F.transform("features", lambda v, k: F.struct(k.alias("position"), v.alias("value")))
        found = self.compute(structures, atoms).withColumn("cells", F.filter(cells, lambda c: c["value"] != 0))
        return found.select(*[c for c in found.columns if c not in ("features", "cells")], F.lit(self.width).alias("width"), F.col("cells.position").alias("positions"), F.col("cells.value").alias("values"))


def as_float32(computed: DataFrame) -> DataFrame:
    """Single-precision features or values; other columns stay."""
    return computed.withColumns({c: F.col(c).cast("array<float>") for c in ("features", "values") if c in computed.columns})


__all__ = ["ConfigurationError", "InputError", "Operator", "as_float32", "cosine_cutoff", "require", "type_index"]
