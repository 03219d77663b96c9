"""functions of the question-corpus engine."""
