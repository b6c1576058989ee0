"""Two-date change analytics and its evidence trail as PySpark jobs."""
