"""linkweave: heterogeneous-network analytics and link recommendation, declared as Spark plans."""
