"""Read and write sets, windows, incremental maintenance, and the set forms of the server components."""
