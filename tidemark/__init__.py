"""Price-history analytics on Spark: plain DataFrame -> DataFrame operators over observations of scheduled events."""
