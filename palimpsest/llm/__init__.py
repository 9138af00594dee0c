"""Operators for building training corpora; nothing outside this folder depends on it."""
