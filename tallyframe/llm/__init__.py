"""Operators that prepare training text: packing, extraction, archives, quality, duplicates, chats, personal data, benchmarks."""
