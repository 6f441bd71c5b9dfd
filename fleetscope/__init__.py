"""fleetscope: fleet-wide server telemetry analytics as Spark DataFrame operators.

Periodic samples of cumulative counters and streams of diagnostic events are
turned into reset-safe deltas, rates and latencies, rolled up over time,
checked against thresholds and baselines, and retained -- for every server of
a fleet in one distributed job.
"""

__version__ = "0.1.0"
