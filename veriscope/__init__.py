"""Citation-fidelity analytics as DataFrame-to-DataFrame stages on Spark."""
