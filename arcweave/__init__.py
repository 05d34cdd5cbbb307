"""arcweave: irregular-graph, dataflow and corpus analytics expressed as Spark DataFrame plans."""

__all__ = ["runtime", "schema"]
