"""Order-book analytics on PySpark: features, labels, splits, windows, models and metrics as DataFrame plans."""
