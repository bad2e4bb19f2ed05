"""Structured Streaming counterparts of the stateless operators, and windowed means of arriving flux."""
