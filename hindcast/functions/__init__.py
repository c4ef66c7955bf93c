"""Column expressions (no actions, no UDFs): JSON, time, identity, metrics."""
