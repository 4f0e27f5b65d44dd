"""The batch operators over tables that grow, with Structured Streaming."""
