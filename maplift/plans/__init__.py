"""Query plans: the compiler, the registered queries and their oracles."""
