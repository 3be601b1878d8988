"""Column functions: guarded arithmetic, inputs of metrics, texts and boxes."""
