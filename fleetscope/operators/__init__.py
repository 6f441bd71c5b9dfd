"""DataFrame-in / DataFrame-out operators of the telemetry engine."""
