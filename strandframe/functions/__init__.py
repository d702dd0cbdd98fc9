"""Column-level functions: DNA strings, hashing, statistics, containers."""
