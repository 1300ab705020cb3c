"""Ticklane: time-ordered panel analytics on Spark DataFrames."""
