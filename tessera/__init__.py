"""Set-at-a-time analytics over code and text repositories, expressed as Spark DataFrame plans."""
