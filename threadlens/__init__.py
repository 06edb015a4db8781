"""threadlens: community question-and-answer analytics as Spark DataFrame jobs."""
