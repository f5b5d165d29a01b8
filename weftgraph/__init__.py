"""Knowledge-graph analytics as lazy PySpark DataFrame operators."""
