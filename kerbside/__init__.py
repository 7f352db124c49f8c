"""Kerbside: roadside survey analytics and corpus preparation as plain Spark jobs."""
