"""Operators by name: metadata without a session, construction from a name or a stored configuration."""

from __future__ import annotations

from dataclasses import MISSING, fields

from .errors import ConfigurationError
from .operators import bessel, cluster, local, longrange, neural, pairs, rotational, symmetry, tensors, turbo
from .operators.base import Operator

OPERATORS: dict[str, type[Operator]] = {
    c.__name__: c
    for c in (
        bessel.C00PSMLFF, cluster.ACE, longrange.LodeSphericalExpansion, symmetry.ACSF, symmetry.EAD, pairs.AtomicComposition, pairs.CoulombMatrix, pairs.EwaldSumMatrix, pairs.NeighborList,
        pairs.SineMatrix, pairs.SortedDistances, tensors.LMBTR, tensors.MBTR, tensors.ValleOganov, local.MTP, local.SO3, local.SOAP,
        local.SoapPowerSpectrum, local.SoapRadialSpectrum, local.SphericalExpansion, local.SphericalExpansionByPair, neural.NEP,
        rotational.LBispectrum, rotational.SNAP, rotational.SO4, turbo.SOAPTurbo,
    )
}


#: Operators that also give energies and forces, by predict().
PREDICTORS = {"NEP": neural.NEP}


def get_descriptor(name: str) -> type[Operator]:
    if name not in OPERATORS:
        raise ConfigurationError(f"unknown operator {name}", "descriptor", known=sorted(OPERATORS))
    return OPERATORS[name]


def describe_descriptor(name: str) -> dict:
    """Name, summary, whether periodic structures are needed, and parameters with their defaults."""
    found = get_descriptor(name)
    parameters = {f.name: {"required": True} if f.default is MISSING else {"required": False, "default": f.default} for f in fields(found)}
    return {"name": name, "summary": (found.__doc__ or "").strip(), "periodic_only": found.periodic_only, "parameters": parameters}


def list_descriptors(detailed: bool = False) -> list:
    return [describe_descriptor(n) if detailed else n for n in sorted(OPERATORS)]


def create_descriptor(name: str, **parameters) -> Operator:
    found = get_descriptor(name)
    unknown = sorted(set(parameters) - {f.name for f in fields(found)})
    if unknown:
        raise ConfigurationError(f"unknown parameters {', '.join(unknown)}", f"parameters.{unknown[0]}")
    missing = [f.name for f in fields(found) if f.default is MISSING and f.name not in parameters]
    if missing:
        raise ConfigurationError(f"missing parameters {', '.join(missing)}", f"parameters.{missing[0]}")
    return found(**parameters)


def from_configuration(configuration: dict) -> Operator:
    """From what configuration() gave, also when it went through JSON (lists become tuples)."""
    freeze = lambda v: tuple(map(freeze, v)) if isinstance(v, (list, tuple)) else v
    if configuration.get("schema_version") != 1:
        raise ConfigurationError("unknown schema version", "schema_version")
    return create_descriptor(configuration["descriptor"], **{k: freeze(v) for k, v in configuration["parameters"].items()})
