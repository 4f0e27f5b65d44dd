"""Column and DataFrame building blocks used by the operators."""
