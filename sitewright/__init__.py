"""Site-survey spatial analytics on Spark."""
