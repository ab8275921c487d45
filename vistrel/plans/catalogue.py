"""All registered queries over the reference's own operators, with their oracles."""

from __future__ import annotations

from vistrel.plans import experiments, files, identities, pools, retrievals, sampling, tables
from vistrel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "experiments", "files", "identities", "pools", "retrievals", "sampling", "tables"]
