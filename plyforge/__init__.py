"""plyforge: analytics over ordered-sequence records, expressed as Spark DataFrame plans."""
