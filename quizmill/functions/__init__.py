"""Column functions: times, texts and closed domains."""
