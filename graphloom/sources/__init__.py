"""Sources and sinks: files, Turtle, JSON, registries."""
