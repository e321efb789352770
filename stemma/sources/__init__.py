"""Reading and writing of batch files, code maps and payloads."""
