"""ledgerlark: a Spark-first analytics engine for AI-agent usage and cost."""
