"""Structured Streaming: message sources, append, upsert, replay-safe de-duplication."""
