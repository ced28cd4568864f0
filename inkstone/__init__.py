"""Chinese prose checking and normalisation on Spark."""
