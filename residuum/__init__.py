"""Structural analytics and answer scoring as Spark DataFrame jobs."""
