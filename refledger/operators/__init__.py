"""DataFrame operators: histories, lookups, facets, mining, reconciliation, rules, lines, contracts."""
