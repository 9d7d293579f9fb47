"""All registered queries."""

from tallyquill.plans import documents, files, inventory, streams, vectors

MODULES = (inventory, documents, vectors, files, streams)

QUERIES = {name: query for module in MODULES for name, query in module.register.queries.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.register.oracles.items()}
