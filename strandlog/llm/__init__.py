"""Operators that prepare training data: quality, copies, shards, tokens, packs, licences."""
