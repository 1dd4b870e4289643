"""kikiwake: homophone-confusion analytics and text-data processing on Spark DataFrames."""
