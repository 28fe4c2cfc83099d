"""Every registered query of the library outside the training-data subpackage."""

from __future__ import annotations

from tessera.plans import models, null_keys, posterior, relational, scoring, text
from tessera.plans.registry import Registry

REGISTRY = Registry()
for part in (text, scoring, posterior, relational, null_keys, models):
    for name, run in part.REG.queries.items():
        REGISTRY.add(name, run, part.REG.oracles.get(name))

#: The query that entry() runs: agreement of three labellers, as one aggregate over one join.
FLAGSHIP = "agreement_funnel"
