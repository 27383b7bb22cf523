"""Registered queries: each operator on the driver's tables, with its SQL twin."""

from __future__ import annotations

from . import evaluation, features, forests, models, network, ontology, orthogroups, sampling, sources, studies

MODULES = [network, features, sources, ontology, orthogroups, sampling, evaluation, models, forests, studies]


def queries() -> dict:
    return {name: spec[0] for module in MODULES for name, spec in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: spec[1] for module in MODULES for name, spec in module.QUERIES.items() if spec[1]}
