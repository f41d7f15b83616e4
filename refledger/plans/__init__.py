"""Bindings of the operators to the test tables, one registered query per operator."""


def all_queries() -> None:
    """Import every module that registers queries."""
    from refledger.plans import (  # noqa: F401
        q_builds,
        q_contracts,
        q_facets,
        q_history,
        q_lines,
        q_lookup,
        q_mining,
        q_reconcile,
        q_rules,
        q_sources,
        q_text,
    )
