"""quizlens: a Spark-first engine for auditing multiple-choice corpora."""
