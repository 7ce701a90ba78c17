"""Target tables: catalog steps, aligned writes and chunk sizing."""
