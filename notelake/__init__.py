"""notelake: Spark-native search and analytics over collections of notes."""
