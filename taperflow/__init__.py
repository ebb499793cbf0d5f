"""taperflow: decline forecasting, scoring and evaluation of monthly series on Spark."""

__version__ = "0.1.0"
