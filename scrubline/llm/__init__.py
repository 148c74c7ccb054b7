"""Training-data pipeline operators: language ID, deduplication, page
extraction, quality scoring, mixing, chat rendering and tokenization.
Nothing outside this subpackage imports it."""
