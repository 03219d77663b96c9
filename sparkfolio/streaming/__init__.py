"""streaming of the question-corpus engine."""
