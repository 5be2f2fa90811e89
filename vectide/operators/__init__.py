"""Table operators: unions, ordinals, search, codebooks, batches and tensor conventions."""
