"""DataFrame -> DataFrame operators: prompts, enrichment, rules, summaries, questions."""
