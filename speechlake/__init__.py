"""speechlake: a PySpark-native analytics engine for time-aligned transcripts."""
