"""palaver: a PySpark-native analytics engine for long multi-speaker transcripts."""
