"""Star schema, aggregate tables, reports, ledger and loads."""
