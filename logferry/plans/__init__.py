"""Complete queries: the log-domain views over the given tables, the registered queries and the cycle."""

from importlib import import_module

# Importing a module registers its queries.
QUERY_MODULES = [
    import_module(f"logferry.plans.{name}")
    for name in ("file_queries", "text_queries", "batch_queries", "state_queries", "rule_queries", "audit_queries", "stream_queries")
]
