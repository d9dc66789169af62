"""Live views: deltas between two states, and Structured Streaming drivers."""
