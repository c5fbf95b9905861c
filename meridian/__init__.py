"""Emergency-response, graph, geometry, text and allocation analytics as PySpark DataFrame operators."""
