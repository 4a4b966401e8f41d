"""netloom: circuit-drawing and netlist analytics as Spark DataFrame jobs."""
