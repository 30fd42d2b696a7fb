"""earshot: keyword-spotting corpus, mining, scoring and detection jobs on Spark."""
