"""evflow: DataFrame operators for event data and for training-data corpora."""
