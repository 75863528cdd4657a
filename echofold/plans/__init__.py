"""How plans are run: session set-up, staging of intermediate tables, whole pipelines."""
