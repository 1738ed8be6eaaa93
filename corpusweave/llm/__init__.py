"""Training-data operators: dedup, quality, language, sharding, tokens, licences, chat."""
