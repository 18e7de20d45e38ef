"""Operators for preparing training data: tokens, quality, language, neighbours, mixing, near and exact copies, shards."""
