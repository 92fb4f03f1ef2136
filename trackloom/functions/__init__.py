"""Column expressions and numpy kernels; nothing in here runs a job."""
