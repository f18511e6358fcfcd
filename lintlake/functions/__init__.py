"""Column builders: text helpers, regex dialect, running folds over arrays."""
