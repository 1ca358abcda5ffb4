"""Streaming twins of the reading-log queries. They agree with the batch ones on the same events."""
