"""memlake: capture, deduplicate, search and report conversational memories on Spark."""
