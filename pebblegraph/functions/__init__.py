"""Column expressions: activations, linear maps, aggregators."""
