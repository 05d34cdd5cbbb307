"""Graph and dataflow operators."""
