"""siftwell."""
