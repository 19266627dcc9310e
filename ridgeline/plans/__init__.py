"""The registered queries and their SQL twins."""


def all_queries():
    """(queries by name, SQL by name) of every module of this package."""
    from ridgeline.plans import catalog

    return catalog.QUERIES, catalog.ORACLES
