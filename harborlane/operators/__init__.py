"""The jobs, one module per job family."""
