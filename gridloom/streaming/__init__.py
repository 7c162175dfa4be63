"""Structured Streaming forms of the yearly generators: roll-ups, carried state, lock-step joins."""
