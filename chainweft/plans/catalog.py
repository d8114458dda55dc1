"""All queries of the core and their SQL twins."""

from chainweft.plans import chain_problems, ledger, models

MODULES = [chain_problems, ledger, models]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
