"""operators of the question-corpus engine."""
