"""Speech-transcription analytics on Spark DataFrames."""
