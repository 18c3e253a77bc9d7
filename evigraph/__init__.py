"""Graph-snapshot, span and ledger analytics as Spark DataFrame operators."""
