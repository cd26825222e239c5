"""Compositions of operators, and the views they run on in checks and benchmarks."""
