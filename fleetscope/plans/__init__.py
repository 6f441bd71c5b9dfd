"""Query catalog: every registered query as a Spark plan plus its SQL oracle."""
