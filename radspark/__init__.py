"""radspark: radius aggregation, concentration labels and cell clusters for 2-D points as Spark plans."""
