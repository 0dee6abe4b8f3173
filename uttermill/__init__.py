"""uttermill: Spark-first analytics over recordings, utterances, trials, vectors and time intervals."""

__version__ = "0.1.0"
