"""Records and logs as they arrive: validated, quarantined, and merged into a store by Structured Streaming."""
