"""sources of the question-corpus engine."""
