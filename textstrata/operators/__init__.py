"""DataFrame operators: search, corpus, structure, redaction, gates, evaluation, mutation plans."""
