"""Sources and sinks: panels, fundamentals, stores."""
