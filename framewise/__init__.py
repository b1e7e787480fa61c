"""Detection analytics on Spark: tables of boxes in video frames in, tracks, zones and reports out."""
