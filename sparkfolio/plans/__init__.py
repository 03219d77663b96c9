"""plans of the question-corpus engine."""
