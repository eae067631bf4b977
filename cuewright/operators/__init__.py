"""DataFrame-to-DataFrame operators, keyed by ``run_id``."""
