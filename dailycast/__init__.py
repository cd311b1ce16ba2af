"""dailycast: retail daily-sales features, training and recursive forecasts on Spark."""

__version__ = "0.1.0"
