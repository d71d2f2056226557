"""Training-data operators: sharding, BPE, search, chat, joins, URLs, LM, WARC, mixing, quality."""
