"""pulsegrid: calibrated, multi-channel sampled signals and their events as Spark DataFrames."""
