"""Training-data operators: search, personal data, tokens, quality, packing,
near-duplicates, toxicity, language-model scores and page rendering."""
