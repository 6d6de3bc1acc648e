"""No streaming operators: the engine's inputs are daily batches, and nothing it computes has event-time semantics."""
