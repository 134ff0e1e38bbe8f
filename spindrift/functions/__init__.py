"""Column functions: text parsing, spans, arrays, scores."""
