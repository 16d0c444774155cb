"""pluvion: Spark-first operators for gauge networks, gridded rainfall and training-data text."""
