"""stakeweave: a Spark-first analytics engine for shareholding networks."""
