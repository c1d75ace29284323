"""Review analytics written as DataFrame-to-DataFrame functions for Spark."""
