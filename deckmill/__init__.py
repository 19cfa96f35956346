"""deckmill: a Spark-native engine for slide-deck evidence, scoring and ranking."""
