"""Sparkfolio: question-corpus structuring, curation and assembly as Spark DataFrame operators."""
