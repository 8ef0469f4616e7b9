"""ledgerloom: personal-finance ledger analytics as Spark jobs."""
