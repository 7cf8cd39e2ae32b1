"""Runnable jobs: ``python -m jobs.NAME --help``."""
