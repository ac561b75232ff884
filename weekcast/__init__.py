"""Weekly-demand panels, walk-forward forecasts and vendor comparisons as Spark jobs."""
